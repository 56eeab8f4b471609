"""Language-model scores by a hidden Markov model, beside an add-one unigram base.

Tokens are lower-cased (A-Z) words between ASCII white space, then one end. The most frequent words are symbols of
their own; any other word is emitted in two steps, its shape class by the state and the word within the class by its
count plus one. Counts cover all training documents. Baum-Welch expectations are summed over partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import crc_mod, lean, materialize, text_bytes

#: Hidden states; words with a symbol of their own; words whose counts every task knows (the rest are joined).
STATES, SYMBOLS, KNOWN = 8, 16_384, 131_072
#: Baum-Welch passes from random parameters: SHARES of them over one share each of all training documents, so that
#: each document is seen once, counts of earlier shares fading by FADE; then FULL passes over all of them.
SHARES, FULL, FADE = 12, 2, 0.6
#: Random starts, and the shares that each of them sees before the likeliest of them goes on.
STARTS, TRIED = 4, 6
#: Tokens of a training segment, and segments handled at once. A later segment starts from the states' shares.
SEGMENT, AT_ONCE = 128, 1024
#: Positions of a segment between two rescalings.
RESCALE = 6
#: Weight of the overall symbol shares in each state's emissions.
PRIOR = 20.0
SEED = 2
#: Distinct words a task counts before it passes partial counts on.
COUNTED = 400_000
#: Documents and tokens that one forward pass handles side by side.
DOCS_AT_ONCE, TOKENS_AT_ONCE = 4096, 2_000_000
END = b""
CLASSES = 512


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def shape(word: bytes) -> int:
    """One of 512 classes: plain ASCII or not, length up to 16 bytes, last byte modulo 16."""
    return (0 if word.isascii() else 256) + (min(len(word), 16) - 1) * 16 + word[-1] % 16


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n long) over all documents; the empty word stands for the ends. docs: (text binary)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                seen.update(tokens(text.as_py()))
                seen[END] += 1
                if len(seen) >= COUNTED:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(of, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above a count threshold that leaves ``most`` of them at most, most frequent first."""
    level = F.floor(F.log("n") * 256)
    sizes = sorted(((r.level, r.k) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for at, k in sizes:
        total += k
        if total > most:
            break
        least = at
    if least is None:
        return []
    return sorted(((bytes(r.word), r.n) for r in counts.where(level >= least).collect()), key=lambda x: (-x[1], x[0]))


@dataclass
class Lexicon:
    """What tasks need to know of the counts: bounded by KNOWN, SYMBOLS and CLASSES."""

    words: list[bytes]  # the known ones without the end, most frequent first
    counts: np.ndarray  # theirs
    end_count: int
    total: int  # tokens in training
    distinct: int
    class_mass: np.ndarray  # of each class: sum of count + 1 over its words without a symbol, and 1 for unseen ones
    symbols: int  # words with a symbol of their own

    @property
    def size(self) -> int:
        return 1 + self.symbols + CLASSES

    def shares(self) -> np.ndarray:
        """Overall share of each symbol: end, words, classes."""
        p = np.concatenate(([self.end_count + 1], self.counts[: self.symbols] + 1, self.class_mass)).astype(float)
        return p / p.sum()


def lexicon(counts: DataFrame) -> Lexicon:
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("e")).first()
    known = [(w, n) for w, n in frequent(counts, KNOWN) if w != END]
    words, freq = [w for w, _ in known], np.array([n for _, n in known], np.int64)
    symbols = min(SYMBOLS, len(words))
    last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int") % 16
    ascii_only = F.length("word") == F.length(F.col("word").cast("string"))
    klass = F.when(ascii_only, 0).otherwise(256) + (F.least(F.length("word"), F.lit(16)) - 1) * 16 + last
    mass = np.ones(CLASSES, np.int64)
    for r in counts.where(F.col("word") != END).groupBy(klass.alias("c")).agg(F.sum(F.col("n") + 1).alias("m")).collect():
        mass[r.c] += r.m
    for w, n in known[:symbols]:
        mass[shape(w)] -= n + 1
    return Lexicon(words, freq, sums.e or 0, sums.n or 0, sums.v or 0, mass, symbols)


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Documents as symbols, and the words that only the full counts know.

    docs: (doc_id, held_out, text binary). Returns (row long, doc_id, held_out, n_tokens, n_known, base, inner,
    symbols binary, word, n): a row with symbols for each document, and one with word and n for each of its distinct
    words beyond the known ones. base and inner sum log10(count + 1) over the known tokens, and the log10 share within
    their class over those without a symbol.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        rank = {w: i for i, w in enumerate(x.words)}
        log_count = np.log10(x.counts + 1.0)
        klass = np.array([shape(w) for w in x.words], np.int64)
        symbol = np.where(np.arange(len(klass)) < x.symbols, np.arange(1, len(klass) + 1), 1 + x.symbols + klass).astype(np.uint16)
        inner = np.where(np.arange(len(klass)) < x.symbols, 0.0, log_count - np.log10(x.class_mass[klass] if len(klass) else 1.0))
        end, row = np.log10(x.end_count + 1.0), TaskContext.get().partitionId() << 36
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b, out = whole.slice(lo, 500), [[] for _ in range(10)]
                for doc, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    found = tokens(text.as_py())
                    at = np.array([rank.get(w, -1) for w in found], np.int64)
                    rare, far = at < 0, Counter()
                    syms = np.zeros(len(found) + 1, np.uint16)
                    if rare.any():
                        far = Counter(found[i] for i in np.flatnonzero(rare).tolist())
                        syms[:-1][rare] = [1 + x.symbols + shape(found[i]) for i in np.flatnonzero(rare).tolist()]
                    near = at[~rare]
                    syms[:-1][~rare] = symbol[near]
                    known = len(near) + (x.end_count > 0)
                    add(out, row, doc, held, len(syms), known, log_count[near].sum() + end, inner[near].sum(), syms.tobytes(), None, None)
                    for w, n in far.items():
                        add(out, row, None, None, None, None, None, None, None, w, n)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES, strict=True)], NAMES)

    def add(out: list[list], *values: object) -> None:
        for c, v in zip(out, values, strict=True):
            c.append(v)

    return docs.select("doc_id", "held_out", "text").mapInArrow(of, ENCODED)


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, symbols binary, word binary, n long"
NAMES = [c.split()[0] for c in ENCODED.split(", ")]
TYPES = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]] for c in ENCODED.split(", ")]


@dataclass
class Hmm:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states), each column a distribution

    @staticmethod
    def random(shares: np.ndarray, seed: int = SEED) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = shares[:, None] * np.exp(rng.normal(0, 0.5, (len(shares), STATES)))
        step = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return Hmm(np.full(STATES, 1 / STATES), step, emit / emit.sum(axis=0))

    def counts(self, segments: list[tuple[np.ndarray, bool]]) -> np.ndarray:
        """Expected counts (rows: start, steps by origin, emissions by symbol; columns: states) of some segments.

        The longest come first, so that those alive are always a prefix.
        """
        size, one = len(self.emit), np.ones(STATES)
        sizes = np.array([len(s) for s, _ in segments])
        order = np.argsort(-sizes, kind="stable")
        flat, sizes = np.concatenate([segments[i][0] for i in order]), sizes[order]
        first, source = np.array([f for _, f in segments])[order], np.cumsum(sizes) - sizes
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        begin = np.concatenate(([0], np.cumsum(live)))
        sym = np.empty(int(begin[-1]), np.int64)  # position by position
        for t, n in enumerate(live):
            sym[begin[t] : begin[t + 1]] = flat[source[:n] + t]
        emit, scale = self.emit[sym], {}
        alpha, share = np.empty_like(emit), np.linalg.matrix_power(self.step, 64)[0]
        alpha[: live[0]] = np.where(first[:, None], self.start, share) * emit[: live[0]]
        for t in range(1, len(live)):
            at = (alpha[begin[t - 1] : begin[t - 1] + live[t]] @ self.step) * emit[begin[t] : begin[t + 1]]
            if t % RESCALE == 0:
                scale[t] = 1 / (at @ one)
                at *= scale[t][:, None]
            alpha[begin[t] : begin[t + 1]] = at
        out, steps, beta = np.zeros((1 + STATES + size, STATES)), np.zeros((STATES, STATES)), np.empty((0, STATES))
        for t in range(len(live) - 1, -1, -1):
            here, ended = slice(begin[t], begin[t + 1]), alpha[begin[t] + len(beta) : begin[t + 1]] @ one
            beta = np.concatenate((beta, np.repeat(1 / ended[:, None], STATES, axis=1)))
            into = emit[here] * beta
            if t in scale:
                into *= scale[t][:, None]
            alpha[here] *= beta
            if t:
                steps += alpha[begin[t - 1] : begin[t - 1] + live[t]].T @ into
                beta = into @ self.step.T
        out[0] = alpha[: live[0]][first].sum(axis=0)
        out[1 : 1 + STATES] = steps * self.step
        for s in range(STATES):
            out[1 + STATES :, s] = np.bincount(sym, alpha[:, s], minlength=size)
        return out

    @staticmethod
    def fitted(counts: np.ndarray, shares: np.ndarray) -> Hmm:
        start, step, emit = counts[0] + 1, counts[1 : 1 + STATES] + 1, counts[1 + STATES :] + PRIOR * shares[:, None]
        return Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10_likelihoods(self, docs: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each sequence by the scaled forward recursion, side by side."""
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        flat, sizes = np.concatenate([docs[i] for i in order]).astype(np.int64), sizes[order]
        begin = np.cumsum(sizes) - sizes
        logs, at = np.zeros(len(docs)), None
        for t in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            e = self.emit[flat[begin[:live] + t]]
            at = (self.start if at is None else at[:live] @ self.step) * e
            scale = at.sum(axis=1)
            at /= scale[:, None]
            logs[:live] += np.log10(scale)
        out = np.empty(len(docs))
        out[order] = logs
        return out


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, bool]]]:
    held: list[tuple[np.ndarray, bool]] = []
    for b in batches:
        for row in b.column(0):
            s = np.frombuffer(row.as_py(), np.uint16)
            for lo in range(0, len(s), SEGMENT):
                held.append((s[lo : lo + SEGMENT], lo == 0))
                if len(held) == AT_ONCE:
                    yield held
                    held = []
    if held:
        yield held


def expected_counts(coded: DataFrame, model: Hmm) -> np.ndarray:
    """Expected counts of all sequences, as Hmm.counts has them; summed in each task, then over the tasks."""
    size, names = 1 + STATES + len(model.emit), [f"s{k}" for k in range(STATES)]
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, STATES))
        for s in segments(batches):
            total += shared.value.counts(s)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(STATES))], ["at", *names])

    rows = coded.select("symbols").mapInArrow(expect, ", ".join(["at long", *(f"{k} double" for k in names)]))
    total = np.zeros((size, STATES))
    for r in rows.groupBy("at").agg(*(F.sum(k).alias(k) for k in names)).collect():
        total[r[0]] = r[1:]
    shared.unpersist()
    return total


def train(coded: DataFrame, lex: Lexicon) -> Hmm:
    """Baum-Welch. coded: (row, doc_id, symbols) of the training documents, written down once.

    A start decides which states stand for what, and no pass undoes it. So STARTS of them see the first TRIED shares,
    and the one goes on that gives the last share, which none has seen, the greatest likelihood.

    A share is chosen by a hash of id and symbols: it grows with the corpus, at every size alike, holds an even part of
    many copies, and is the same however the table is cut into files. Its rows are read by fewer tasks, as each task
    sends a table of counts.
    """
    shares, share = lex.shares(), F.pmod(F.xxhash64("symbols", "doc_id"), F.lit(SHARES))
    tasks = max(1, coded.rdd.getNumPartitions() // 4)

    def passes(model: Hmm, kept: np.ndarray | float, which: range) -> tuple[Hmm, np.ndarray | float]:
        for k in which:
            kept = FADE * kept + expected_counts(coded.where(share == k).coalesce(tasks), model)
            model = Hmm.fitted(kept, shares)
        return model, kept

    tried = [passes(Hmm.random(shares, SEED + s), 0.0, range(TRIED)) for s in range(STARTS)]
    likely = [forward(coded.where(share == SHARES - 1), m).agg(F.sum("path")).first()[0] or 0.0 for m, _ in tried]
    model, _ = passes(*tried[int(np.argmax(likely))], range(TRIED, SHARES))
    for _ in range(FULL):
        model = Hmm.fitted(expected_counts(coded, model), shares)
    return model


def forward(coded: DataFrame, model: Hmm) -> DataFrame:
    """(row, path double): log10 probability of each document's symbols."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, docs, size = [], [], 0
        for b in batches:
            for row, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.append(row)
                docs.append(np.frombuffer(s.as_py(), np.uint16))
                size += len(docs[-1])
                if len(docs) == DOCS_AT_ONCE or size >= TOKENS_AT_ONCE:
                    yield scored(rows, docs)
                    rows, docs, size = [], [], 0
        if docs:
            yield scored(rows, docs)

    def scored(rows: list, docs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(shared.value.log10_likelihoods(docs))], ["row", "path"])

    return coded.select("row", "symbols").mapInArrow(of, "row long, path double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(id as text) modulo 7 is not 2 (a null id is learnt from) and scores all. A null
    or empty text is its end alone. Repeated rows count and return again; other columns are ignored; without training
    documents every count is 0; an empty table gives an empty result. score is the log10 probability of the tokens:
    that of the symbols under the HMM plus, for words without a symbol, that of the word within its class.
    """
    held = F.coalesce(crc_mod(id_col, 7) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text_bytes(text_col).alias("text"))
    lean(docs.sparkSession)
    counts = materialize(word_counts(rows.where("not held_out")), "word-counts")
    lex = lexicon(counts)
    coded = materialize(encode(rows, lex), "hmm-symbols")
    whole = coded.where("symbols is not null")
    model = train(whole.where("not held_out").select("row", "doc_id", "symbols"), lex)

    mass = F.array(*[F.lit(float(m)) for m in lex.class_mass])
    last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int") % 16
    ascii_only = F.length("word") == F.length(F.col("word").cast("string"))
    klass = F.when(ascii_only, 0).otherwise(256) + (F.least(F.length("word"), F.lit(16)) - 1) * 16 + last
    times, c = F.col("times"), F.coalesce("n", F.lit(0))
    far = coded.where("word is not null").select("row", "word", F.col("n").alias("times")).join(counts, "word", "left")
    far = far.groupBy("row").agg(
        F.sum(F.when(c > 0, times).otherwise(0)).alias("far_known"),
        F.sum(times * F.log10(c + 1)).alias("far_base"),
        F.sum(times * (F.log10(c + 1) - F.log10(F.element_at(mass, klass + 1)))).alias("far_inner"),
    )
    out = whole.drop("symbols", "word", "n").join(forward(whole, model), "row").join(far, "row", "left")
    zero = F.lit(0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", zero)).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("far_base", zero) - F.col("n_tokens") * F.lit(float(np.log10(lex.total + lex.distinct + 1)))).alias("base_score"),
        (F.col("path") + F.col("inner") + F.coalesce("far_inner", zero)).alias("score"),
    )
