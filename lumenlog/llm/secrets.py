"""Secrets: fixed patterns, and strings that a random-character Markov model explains better than one of identifiers.

DataFrame functions alone: places of matches come from the lengths of the pieces between them, scores from an array
that holds a log-likelihood ratio for each pair of characters.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order, their patterns, the group whose length counts, and the least length.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same matches, less those that fail for their length, where a pattern can tell: it then meets no others.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
#: A cheap test that is true wherever a match of the kind can count.
MAY = {"assign": r"""[pPsStTaA](?i:assw(?:or)?d|ecret|oken|pi_?key)["']?\x20*[:=]""", "access": LONG["access"], "hex": r"[0-9a-f]{24}"}
#: Strings of at least LEAST characters of this set are compared; one is a secret from a ratio of e^MARGIN on.
CANDIDATE, LEAST, MARGIN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 20, 9.0
#: Documents (chosen by a hash of their ids) that the two models learn from.
TRAIN_ROWS = 400
#: Digests of each of them that stand for random strings.
DIGESTS = 20
CHARS = 128
SPAN = "array<struct<start:int,end:int,text:string>>"
MARK = "[secret]"
#: Code points of the pieces that a text is cut into to take gaps out of it.
PIECE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each number the merge, from 0 on, of those before it.

    The array is cut into blocks of about the root of its size, blocks are merged as wholes, and a number merges only
    those of its own block. (A fold with an array as its state would copy the array at every step.)
    """
    total = lambda part: F.aggregate(part, F.lit(0), merge)

    def within(blocks: Column, wholes: Column) -> Column:
        before = F.transform(wholes, lambda _, k: total(F.slice(wholes, 1, k)))
        return F.flatten(F.zip_with(blocks, before, lambda block, start: F.transform(block, lambda _, k: merge(start, total(F.slice(block, 1, k))))))

    def of(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda k: F.slice(x, k * size + 1, size))
        return let(blocks, lambda y: let(F.transform(y, total), lambda wholes: within(y, wholes)))

    return F.when(F.size(numbers) > 0, let(numbers, of)).otherwise(F.array().cast("array<int>"))


def plus(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(text: Column, pattern: str, may: str) -> Column:
    """All leftmost, non-overlapping matches with their places in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    both = F.zip_with(before, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("text")))

    def placed(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["text"].alias("text"))

    spans = let(both, lambda xs: F.zip_with(xs, running(F.transform(xs, lambda x: x["gap"] + x["size"]), plus), placed))
    return F.when(text.rlike(may), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    def counts(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
        return lambda s: F.length(F.regexp_extract(s["text"], pattern, group)) >= least

    return {kind: F.filter(matches(text, LONG.get(kind, pattern), MAY[kind]), counts(pattern, group, least)) for kind, pattern, group, least in KINDS}


def sampled(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    total = docs.count()
    chosen = docs if total <= rows else docs.where((F.abs(F.xxhash64(id_col)) % 1_000_000) < max(1, int(1_000_000 * rows / total)))
    return chosen.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def labelled_strings(sample: DataFrame) -> DataFrame:
    """(random boolean, string): per document, salted digests in four spellings; and its words too short for a candidate,
    alone and joined in pairs, a number, and a rule of one repeated sign.
    """
    digest = F.sha2(F.coalesce(F.col("id"), F.lit("")), 256)

    def spellings(k: Column) -> Column:
        salted = F.sha2(F.concat_ws(" ", "id", k.cast("string")), 256)
        b64 = F.regexp_replace(F.base64(F.unhex(salted)), r"\s", "")
        return F.array(F.substring(salted, 1, 40), F.upper(F.substring(salted, 1, 40)), b64, F.translate(b64, "+/", "-_"))

    random = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(DIGESTS)), spellings))
    words = F.filter(F.split("text", r"[^A-Za-z0-9+/_=-]+"), lambda w: w.rlike(f"^[A-Za-z][A-Za-z0-9+/_=-]{{3,{LEAST - 2}}}$") & ~w.rlike("[0-9]{4}"))
    after = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(words, after, lambda a, b: F.concat_ws("_", a, F.coalesce(b, F.lit("id"))))
    kebab = F.zip_with(words, after, lambda a, b: F.concat_ws("-", F.lower(a), F.coalesce(b, F.lit("id"))))
    camel = F.zip_with(words, after, lambda a, b: F.concat(F.lower(a), F.initcap(F.coalesce(b, F.lit("id")))))
    path = F.zip_with(words, after, lambda a, b: F.concat(F.lit("/"), F.lower(a), F.lit("/"), F.coalesce(b, F.lit("id"))))
    number = F.conv(F.substring(digest, 1, 15), 16, 10)
    rule = F.repeat(F.substring(F.lit("-=_+/"), (F.ascii(digest) % 5 + 1).cast("int"), F.lit(1)), 30)
    plain = F.concat(words, pairs, kebab, camel, path, F.array(number, rule))
    plain = sample.select(F.lit(False).alias("random"), F.explode(plain).alias("string"))
    return sample.select(F.lit(True).alias("random"), F.explode(random).alias("string")).unionByName(plain)


def codes(string: Column) -> Column:
    return F.transform(F.split(string, ""), lambda c: F.ascii(c))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> list[float]:
    """Log-likelihood ratios of random to identifier, for pairs (before, after): entry 128 * before + after.

    The labelled samples are made, not given: salted digests stand for random strings, the texts' own words for
    identifiers, from about ``rows`` documents (bound: a classifier's training rows), chosen by a hash of their ids.
    The two chains' transition counts are one grouped count; each gets half a count more per character of the set, so
    that pairs which neither has seen decide little. At most 2 * 128 * 128 numbers reach the driver.
    """
    strings = labelled_strings(sampled(docs, id_col, text_col, rows)).where("length(string) > 1").withColumn("c", codes(F.col("string")))
    after = F.slice("c", 2, F.size("c") - 1)
    pair = F.zip_with(F.slice("c", 1, F.size("c") - 1), after, lambda a, b: a * CHARS + b)
    counts = strings.select("random", F.explode(pair).alias("pair")).groupBy("random", "pair").count().collect()
    n = np.zeros((2, CHARS, CHARS))
    for r in counts:
        if r.pair < CHARS * CHARS:
            n[int(r.random), r.pair // CHARS, r.pair % CHARS] += r["count"]
    n += 0.5
    p = n / n.sum(axis=2, keepdims=True)
    return np.log(p[1] / p[0]).ravel().round(6).tolist()


def ratio(string: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of the candidate set, summed over its pairs."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    c = codes(string)
    pairs = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(table, a * CHARS + b + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def with_model_spans(text: Column, base: Column, model: list[float]) -> Column:
    """The base spans and the candidates over the margin that lie within none of them, in order."""
    found = F.filter(matches(text, CANDIDATE, CANDIDATE), lambda s: ratio(s["text"], model) >= MARGIN)

    def kept(spans: Column) -> Column:
        far = running(F.transform(spans, lambda s: F.when(s["rank"] < len(KINDS), s["end"]).otherwise(0)), larger)
        met = F.filter(F.arrays_zip(spans.alias("s"), far.alias("far")), lambda x: (x["s"]["rank"] < len(KINDS)) | (x["s"]["end"] > x["far"]))
        return F.transform(met, lambda x: x["s"])

    return F.when(F.size(found) > 0, let(F.array_sort(F.concat(base, ranked(found, len(KINDS), "markov"))), kept)).otherwise(base)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """All columns of ``docs``, then base and spans (or as named): arrays of (start, rank, end, kind), by start, then kind.

    base holds the fixed patterns' spans, spans those and the model's (kind markov). Places are code points, end
    exclusive. Null text: empty. Columns of these names are replaced; every row returns once, whatever its id.
    The model is learnt from ``docs`` unless given. No shuffle: each text is searched where it is read.
    """
    model = train(docs, id_col, text_col) if model is None else model
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = base_spans(text)
    base = F.array_sort(F.concat(*[ranked(kinds[k], i, k) for i, (k, *_) in enumerate(KINDS)]))
    return docs.withColumn(names[0], base).withColumn(names[1], with_model_spans(text, F.col(f"`{names[0]}`"), model))


def taken(pieces: Column, gap: Column) -> Column:
    """The text of a gap (start, end), out of pieces of PIECE code points; beyond the text there is none."""
    first = F.floor(gap["start"] / PIECE).cast("int")
    count = F.least(F.ceil(gap["end"] / PIECE).cast("int"), F.size(pieces)) - first
    some = F.when(count > 0, F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(0))), "")).otherwise("")
    return F.substring(some, gap["start"] - first * PIECE + 1, gap["end"] - gap["start"])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """The columns of ``docs``, each span of the text replaced by a mark; overlapping spans share one. Null stays null."""
    base, all_spans = "+".join([*docs.columns, "base"]), "+".join([*docs.columns, "spans"])  # names that no column has
    found = find_secrets(docs, id_col, text_col, model, (base, all_spans))
    text, spans = F.col(text_col), F.col(f"`{all_spans}`")

    def gaps_of(spans: Column) -> Column:
        gap = lambda s, at: F.when(s["start"] >= at, F.struct(at.alias("start"), s["start"].alias("end")))
        tail = F.struct(F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"])).alias("start"), F.lit(2**31 - 1).alias("end"))
        return F.concat(F.array_compact(F.zip_with(spans, running(F.transform(spans, lambda s: s["end"]), larger), gap)), F.array(tail))

    # A piece is a few code points of the text, so that a gap is taken from its own pieces and not from the text's start.
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = let(pieces, lambda p: F.array_join(F.transform(let(spans, gaps_of), lambda g: taken(p, g)), MARK))
    return found.withColumn(text_col, F.when(text.isNotNull() & (F.size(spans) > 0), clean).otherwise(text)).select(*docs.columns)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col(id_col).cast("long").alias("doc_id"), *[count(k) for k, *_ in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )
