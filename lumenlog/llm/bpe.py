"""BPE encoding and decoding by a tokenization automaton.

Merges are compiled one after another: each adds a gadget to a deterministic automaton over token arcs whose accepted
paths are exactly the correct tokenizations. A state is the token read last. The gadget of merge (u, v):

- splits the state after u off and cuts its arc v (u followed by v is now always merged),
- adds arc uv wherever arc u could be taken, leading to a copy of the state after v as it is at that moment.

A full table would hold nearly every pair of tokens, so rows are kept as what the gadgets say: where a state was copied
from and when, and which arcs were cut and when. ``arc`` reads a transition by walking back through the gadgets, and a
bounded table keeps the transitions that were asked for. As every prefix of a word has one correct tokenization, one
state is live at each place of the word, and a scan from left to right reaches them all.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import lean, worker_state

#: Words kept in each of the two generations of the cache, and transitions kept in the table.
CACHED_WORDS = 250_000
CACHED_ARCS = 1_000_000
#: Bytes of text after which a batch of results is sent on.
BATCH_BYTES = 2 << 20
#: Characters of a long text that are split into words at once.
CHUNK = 1 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Automaton:
    """Compiled merges: ``encode(symbols)`` gives token ids, ``labels[id]`` the label of an arc."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        size = max(vocab.values(), default=-1) + 1
        self.size, self.labels = size, {i: t for t, i in vocab.items()}
        self.left, self.right, self.born = [0] * size, [0] * size, [0] * size
        self.cut: dict[int, int] = {}
        self.dead: set[int] = set()
        for rank, merge in enumerate(merges, 1):
            u, v = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(vocab[u], vocab[v], vocab[u + v], rank)
        self.trie: dict = {}
        for token, i in vocab.items():
            if i in self.dead:
                continue
            symbols = [*token.removesuffix(suffix)] if suffix and token.endswith(suffix) else [*token]
            if suffix and token.endswith(suffix) and symbols:
                symbols[-1] += suffix
            node = self.trie
            for s in symbols:
                node = node.setdefault(s, {})
            node[None] = i
        self.table: dict[int, bool] = {}

    def _gadget(self, u: int, v: int, uv: int, when: int) -> None:
        if self.born[uv] or when <= max(self.born[u], self.born[v]):
            raise ValueError("merges must build each token once, from tokens built before")
        if u in self.dead or v in self.dead or not self._walk(u, v, when):
            self.dead.add(uv)  # u is never followed by v, so no path gets the arc
            self.born[uv] = when
            return
        self.left[uv], self.right[uv], self.born[uv] = u, v, when
        self.cut[u * self.size + v] = when
        if u == v:  # the split state has lost arc u, and so gets no arc uu: pairs merge from the left
            self.cut[u * self.size + uv] = when

    def arc(self, a: int, b: int) -> bool:
        """Whether token b may follow token a once all gadgets are in place."""
        key = a * self.size + b
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= CACHED_ARCS:
                self.table.clear()
            known = self.table[key] = self._walk(a, b, len(self.born) + 1)
        return known

    def _walk(self, a: int, b: int, now: int) -> bool:
        size, born, cut = self.size, self.born, self.cut
        while True:
            when = cut.get(a * size + b)
            if when is not None and when < now:
                return False
            if born[a] > born[b]:
                now, a = born[a], self.right[a]
            elif born[b]:
                now, b = born[b], self.left[b]
            else:
                return True

    def encode(self, symbols: list[str]) -> list[int]:
        """Ids of a word given as symbols, the last one bearing the end mark."""
        n = len(symbols)
        state, came = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            last, node = state[j], self.trie
            if j and last < 0:
                continue
            for i in range(j, n):
                node = node.get(symbols[i])
                if node is None:
                    break
                token = node.get(None)
                if token is not None and state[i + 1] < 0 and (not j or self.arc(last, token)):
                    state[i + 1], came[i + 1] = token, j
        out, i = [], n
        while i:
            out.append(state[i])
            i = came[i]
        return out[::-1]


class Words(dict):
    """Word -> ids. Two generations: when the young one is full it becomes the old one, so frequent words stay."""

    def __init__(self, automaton: Automaton, suffix: str, limit: int = CACHED_WORDS) -> None:
        super().__init__()
        self.automaton, self.suffix, self.limit, self.old, self.bytes = automaton, suffix, limit, {}, byte_symbols()

    def __missing__(self, word: str | int) -> tuple[int, ...]:
        if isinstance(word, int):  # a special token
            return (word,)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            symbols = [self.bytes[b] for b in word.encode()]
            symbols[-1] += self.suffix
            ids = tuple(self.automaton.encode(symbols))
        self[word] = ids
        return ids


class Splitter:
    """A tokenizer file's normalizer, special tokens and pre-tokenizer, for the kinds of step named in ``check``."""

    def __init__(self, d: dict) -> None:
        self.check(d)
        pattern = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space as Unicode has it, which leaves the separators U+001C to U+001F to the symbols.
        self.any = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.ascii, self.latin = (self.plain(pattern, size) for size in (128, 256))
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def plain(pattern: str, size: int) -> re.Pattern:
        """The pattern for texts of code points below 128 or 256 alone, its classes spelt out."""
        of = lambda kind: "".join(re.escape(chr(c)) for c in range(size) if unicodedata.category(chr(c))[0] == kind)
        spaces = r"\s" if size == 128 else r"\s\x85\xa0"
        return re.compile(pattern.replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N")).replace(r"[^\s", f"[^{spaces}"), re.ASCII)

    @staticmethod
    def check(d: dict) -> None:
        steps = [x["type"] for x in d["normalizer"]["normalizers"]]
        pre = d["pre_tokenizer"]["pretokenizers"]
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in d["added_tokens"])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or d["decoder"] or not plain:
            raise ValueError("this tokenizer file has steps other than those supported")

    def pre_split(self, text: str) -> list[str]:
        """Normalized words. Sigma is lowered by itself, as the rule for a final sigma looks at neighbours."""
        if text.isascii():
            return self.ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any.findall(text)
        return self.latin.findall(text)

    def parts(self, text: str) -> list[str | int]:
        """Normalized words, and the ids of special tokens, in order."""
        if self.cut is None or self.cut.search(text) is None:
            return self.pre_split(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self.pre_split(part)
        return out


def chunks(text: str, size: int | None = None) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut before a space, which no word or special token reaches over."""
    lo, size = 0, size or CHUNK
    while len(text) - lo > size:
        hi = text.find(" ", lo + size)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


class Tokenizer(Splitter):
    """A whole tokenizer file: the splitter before the automaton of its BPE model."""

    def __init__(self, spec: str, limit: int = CACHED_WORDS) -> None:
        d = json.loads(spec)
        super().__init__(d)
        model, suffix = d["model"], d["model"].get("end_of_word_suffix") or ""
        self.automaton = Automaton(model["vocab"], model["merges"], suffix)
        self.words = Words(self.automaton, suffix, limit)
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}

    def encode(self, text: str) -> list[int]:
        words, out = self.words, []
        for chunk in chunks(text):
            out += chain.from_iterable([words[w] for w in self.parts(chunk)])
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by a space."""
        return " ".join([self.labels[i] for i in ids])


def tokenizer(spec: str) -> Tokenizer:
    """The compiled tokenizer of this worker process; compiled once for each file."""
    return worker_state(("bpe", hashlib.sha256(spec.encode()).hexdigest()), lambda: Tokenizer(spec))


def read_spec(path: str | None = None) -> str:
    """Text of a tokenizer file, read where the job starts and then broadcast: a few MB, whatever the input."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids array<int>, decoded string.

    ids: the whole text's token ids; decoded: the ids' labels joined by a space. Null or empty text: no ids and an
    empty string. Null ids and repeated rows are kept as they are; other columns are ignored; an empty table gives an
    empty result. No shuffle: each batch of rows is encoded where it is read.
    """
    spec = lean(docs.sparkSession).sparkContext.broadcast(read_spec(path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec.value)
        for b in batches:
            lo, size, ids, texts = 0, 0, [], []
            for i, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                ids.append(t.encode(text))
                texts.append(t.decode(ids[-1]))
                size += len(text)
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                    )
                    lo, size, ids, texts = i + 1, 0, [], []

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "doc_id long, ids array<int>, decoded string")
