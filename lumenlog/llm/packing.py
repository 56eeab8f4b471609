"""Packing of token sequences into windows by the sum-of-squares rule."""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import bpe
from lumenlog.llm.common import lean, release, worker_state

WINDOW = 2048
END_ID = 1
#: Words that a generation of the cache holds.
CACHED = 100_000
ID_BYTES = 4
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit bytes, by the tokenizers library, asked once for each word it forgets not.

    Texts are normalized and split as the file says. A new word's entry is an empty buffer until ``settle`` asks for
    all new words together, so each word of a text is looked up once. Words are kept in two generations: a full young
    one becomes the old one.
    """

    def __init__(self, spec: str, limit: int = CACHED) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        d = json.loads(spec)
        self.splitter, self.symbols = bpe.Splitter(d), dict(enumerate(bpe.byte_symbols()))
        bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
        self.model = Tokenizer.from_str(json.dumps(d | bare))
        self.model.no_truncation()
        self.model.no_padding()
        suffix = d["model"].get("end_of_word_suffix")
        self.last = np.zeros(1 + max(d["model"]["vocab"].values(), default=0), bool)
        if suffix:
            self.last[[i for t, i in d["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.old: dict[str | int, bytes] = {}
        self.new: dict[str, bytearray] = {}
        self.limit = limit

    def __missing__(self, word: str | int) -> bytes | bytearray:
        ids = self.old.get(word)
        if ids is None:
            if isinstance(word, int):  # a special token
                ids = np.array([word], "<u4").tobytes()
            else:
                ids = self.new[word] = bytearray()
        self[word] = ids
        return ids

    def stated(self, word: str) -> str:
        """The word in symbols for bytes, none of which is white space."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin1").translate(self.symbols)

    def ask(self, words: list[str]) -> list[bytes]:
        """Ids of each word: one question, if the ids that end a word part the answer into as many words."""
        stated = list(map(self.stated, words))
        ids = np.array(self.model.encode_batch_fast([" ".join(stated)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(stated, add_special_tokens=False)]
        raw, ends = ids.tobytes(), (ends * ID_BYTES).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def settle(self) -> None:
        """Fill the buffers of new words."""
        words = list(self.new)
        for lo in range(0, len(words), 2048):
            part = words[lo : lo + 2048]
            for word, ids in zip(part, self.ask(part), strict=True):
                self.new[word][:] = ids
                self[word] = ids
        self.new = {}
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def looked_up(self, text: str) -> list[bytes | bytearray]:
        return list(map(self.__getitem__, self.splitter.parts(text)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order; a long one is taken in chunks."""
        short = [self.looked_up(t) if len(t) <= bpe.CHUNK else None for t in texts]
        self.settle()
        for text, found in zip(texts, short, strict=True):
            yield b"".join(found if found is not None else self.of_chunks(text))

    def of_chunks(self, text: str) -> Iterator[bytes]:
        for chunk in bpe.chunks(text):
            found = self.looked_up(chunk)
            self.settle()
            yield b"".join(found)


def word_ids(spec: str) -> WordIds:
    return worker_state(("words", zlib.crc32(spec.encode())), lambda: WordIds(spec))


class SumOfSquares:
    """Online packing: level[h] counts the windows filled up to h; an item goes where the sum of their squares ends least.

    Going to level h changes the sum by 2 (level[h+s] - level[h]) + 2, filling a window up by 1 - 2 level[h], opening
    a new one by 2 level[s] + 1. Ties go to the fullest window, and to an open one before a new one.
    """

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, deque] = {}

    def place(self, size: int) -> int:
        """The level to place an item of size 1..window-1 at; 0 opens a window."""
        level = self.level
        h = np.flatnonzero(level[1 : self.window - size + 1]) + 1
        if not len(h):
            return 0
        change = 2 * (level[h + size] - level[h]) + 2
        change[h + size == self.window] -= 1
        best = len(h) - 1 - int(np.argmin(change[::-1]))
        return int(h[best]) if change[best] <= 2 * level[size] + 1 else 0

    def add(self, item: tuple, size: int) -> list | None:
        """Place an item; gives the items of its window if that is now full."""
        h = self.place(size)
        if h:
            self.level[h] -= 1
            window = self.open[h].popleft()
        else:
            window = []
        window.append(item)
        if h + size == self.window:
            return window
        self.level[h + size] += 1
        self.open.setdefault(h + size, deque()).append(window)
        return None

    def rest(self) -> Iterator[list]:
        for h in sorted(self.open, reverse=True):
            yield from self.open[h]


def pieces(docs: Iterator[tuple[object, bytes]], window: int = WINDOW) -> Iterator[list[tuple]]:
    """Windows of one partition; each a list of (doc_id, start, ids bytes, doc_tokens).

    A document's full windows stand alone; what remains of it is placed by the sum-of-squares rule. Windows still
    open at the end are laid end to end and cut anew, and what is left after the last full one goes to sequences
    whose lengths are powers of two, so nothing is padded.
    """
    packer = SumOfSquares(window)
    for doc, ids in docs:
        total = len(ids) // ID_BYTES
        whole = total - total % window
        for s in range(0, whole, window):
            yield [(doc, s, ids[s * ID_BYTES : (s + window) * ID_BYTES], total)]
        if whole < total:
            full = packer.add((doc, whole, ids[whole * ID_BYTES :], total), total - whole)
            if full:
                yield full
    left = deque(x for w in packer.rest() for x in w)
    tokens = sum(len(x[2]) // ID_BYTES for x in left)
    while tokens:
        room = min(window, 1 << (tokens.bit_length() - 1))
        tokens -= room
        out = []
        while room:
            doc, start, ids, total = left.popleft()
            n = min(room, len(ids) // ID_BYTES)
            out.append((doc, start, ids[: n * ID_BYTES], total))
            if n * ID_BYTES < len(ids):
                left.appendleft((doc, start + n, ids[n * ID_BYTES :], total))
            room -= n
        yield out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each input partition is packed by itself, in the order it is read and without a shuffle; a lost task is packed
    anew alike. sequence_id holds the partition in its upper bits. A null or empty text is its end id alone. Null ids
    and repeated rows are packed like others; other columns are ignored; an empty table gives no rows. Held in memory:
    a batch of documents and the open windows, of which there is a small number for each of the window's levels.
    ``window`` must be a power of two.
    """
    spec = lean(docs.sparkSession).sparkContext.broadcast(bpe.read_spec(path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = word_ids(spec.value), np.array([END_ID], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40

        def encoded() -> Iterator[tuple[object, bytes]]:
            for b in batches:
                for lo in range(0, b.num_rows, 500):
                    part = b.slice(lo, 500)
                    for doc, ids in zip(part.column(0).to_pylist(), model.encode(part.column(1).to_pylist()), strict=True):
                        yield doc, ids + end

        rows: list[tuple] = []
        for k, placed in enumerate(pieces(encoded(), window)):
            offset = 0
            for doc, start, ids, total in placed:
                n = len(ids) // ID_BYTES
                rows.append((doc, start, n, zlib.crc32(ids), total, first + k, offset))
                offset += n
            if len(rows) >= 5000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)
        model.clear()  # the next task learns its words anew, and an idle worker holds none
        model.old = {}
        release()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(of, SCHEMA)
