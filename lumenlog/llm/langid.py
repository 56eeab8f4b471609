"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

Text gives a likelihood per language from byte trigrams, and one of being in none of them: trigrams of independent
bytes as frequent as in the labelled rows, or any trigram alike. A declared language is evidence through a confusion table
that is itself counted. Hosts have priors smoothed towards their suffix's, which are smoothed towards the whole
corpus's; all three come from grouped sums of the posteriors that text and declaration give.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import HUB, HUBS, SALTS, forget, lean, materialize, release, text_bytes

BITS = 16
#: Labelled rows that the text model learns from at most, chosen by a hash of their texts, as many of each language as
#: it has or as its even part; and languages whose counts a task holds before it passes them on.
TRAIN_ROWS, HELD = 20_000, 64
#: Trigrams overlap and repeat, so a text counts as TEMPER of their number, and as CAP independent ones at most.
TEMPER, CAP = 0.25, 400.0
#: Rows' worth of the level above in a smoothed prior, and of a plain guess in the confusion table.
SMOOTHING = 20.0
#: A row is accepted from this posterior on, if its text holds at least one letter.
ACCEPT = 0.5
#: Share of each language's trigrams that are not in its labelled rows, the same for all, however many rows they have.
UNSEEN = 0.01
#: Share of texts in no known language, before their text is seen.
FOREIGN = 0.01
#: Hosts up to which their priors are broadcast; beyond, they are joined by a shuffle that deals hot hosts over parts.
BROADCAST_HOSTS = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def folded(text: bytes) -> np.ndarray:
    """Bytes of a whole text; signs and digits count as spaces, runs of them as one."""
    return np.frombuffer(b" " + b" ".join(text.translate(_LOWER).split()) + b" ", np.uint8)


def slots(text: bytes) -> np.ndarray:
    """Hash slots of the byte trigrams of a whole text."""
    return slots_of(folded(text))


def slots_of(b: np.ndarray) -> np.ndarray:
    if len(b) < 3:
        return np.zeros(0, np.int64)
    b = b.astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # (2^BITS, languages): log share of each slot

    letters: np.ndarray  # (256): share of each byte

    def evidence(self, text: bytes) -> list[float]:
        """Tempered log likelihood per language; empty without a letter."""
        return self.weighed(text)[0].tolist()

    def weighed(self, text: bytes) -> tuple[np.ndarray, float]:
        """The evidence, and the tempered log likelihood of a text in none of the languages."""
        b = folded(text)
        at = slots_of(b)
        if not len(at):
            return np.zeros(0), 0.0
        p = self.letters[b]
        other = np.log(0.5 * p[:-2] * p[1:-1] * p[2:] + 0.5 / (1 << BITS)).mean()
        times = min(CAP, TEMPER * len(at))
        return self.logs[at].mean(axis=0, dtype=np.float64) * times, float(other) * times


def even_part(counts: list[int], rows: int) -> float:
    """The most rows a language may give so that all together give ``rows``; no less than one row."""
    left, sizes = float(rows), sorted(counts)
    for i, n in enumerate(sizes):
        if n * (len(sizes) - i) > left:
            return max(1.0, left / (len(sizes) - i))
        left -= n
    return float(max(sizes, default=1))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> TextModel:
    """Slot counts of every language, over at most about ``rows`` labelled rows; 2^BITS numbers per language reach the driver."""
    lean(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & F.col(text_col).isNotNull())
    names = labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()
    languages = sorted(r.lang for r in names)
    if sum(r["count"] for r in names) > rows:
        most = even_part([r["count"] for r in names], rows)
        rates = docs.sparkSession.createDataFrame([(r.lang, int(1_000_000 * min(1.0, most / r["count"]))) for r in names], "`+lang` string, `+rate` long")
        drawn = F.abs(F.xxhash64(text_col)) % 1_000_000 < F.col("+rate")
        labelled = labelled.join(F.broadcast(rates), F.col(lang_col) == F.col("+lang")).where(drawn)
    number = {name: k for k, name in enumerate(languages)}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen, letters = {}, np.zeros(256, np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if number[lang] not in seen:
                    if len(seen) == HELD:
                        yield from map(found, seen, seen.values())
                        seen.clear()
                    seen[number[lang]] = np.zeros(1 << BITS, np.int64)
                plain = folded(text.as_py())
                seen[number[lang]] += np.bincount(slots_of(plain), minlength=1 << BITS)
                letters += np.bincount(plain, minlength=256)
        yield from map(found, [*seen, -1], [*seen.values(), letters])
        seen.clear()
        release()

    def found(lang: int, n: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang)), pa.array(at), pa.array(n[at])], ["lang", "slot", "n"])

    counts = labelled.select(F.col(lang_col).alias("lang"), text_bytes(text_col).alias("text")).mapInArrow(of, "lang long, slot long, n long")
    n, letters = np.zeros((1 << BITS, max(1, len(languages)))), np.ones(256)
    for r in counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas().itertuples():
        if r.lang < 0:
            letters[r.slot] += r.n
        else:
            n[r.slot, r.lang] += r.n
    shares = (1 - UNSEEN) * n / np.maximum(1, n.sum(axis=0)) + UNSEEN / (1 << BITS)
    return TextModel(languages, np.log(shares).astype(np.float32), letters / letters.sum())


def softmax(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max())
    return p / p.sum()


def alone_of(e: np.ndarray, other: float) -> np.ndarray:
    """Posteriors of the languages by text alone; what they lack of one is that of none of them."""
    return softmax(np.append(e, other + np.log(FOREIGN)))[:-1]


def sums(rows: DataFrame, keys: list[str], n: int, of: str) -> DataFrame:
    """Grouped sums of the entries of an array; a hot key is summed up where its rows are read first."""
    out = rows.groupBy(*keys).agg(*[F.sum(F.element_at(of, k + 1)).alias(f"_{k}") for k in range(n)])
    return out.select(*keys, F.array(*[F.col(f"_{k}") for k in range(n)]).alias(of))


def smoothed(counts: np.ndarray, above: np.ndarray) -> np.ndarray:
    return (counts + SMOOTHING * above) / (counts.sum() + SMOOTHING)


def confusion(by_kind: dict[str, list[float]], names: list[str]) -> dict[str, np.ndarray]:
    """log P(declaration | language) for each declaration: counted, smoothed by a guess."""
    n, kinds = len(names), [*names, "other", "none"]
    table = np.array([by_kind.get(k, [0.0] * n) for k in kinds])
    guess = np.array([[0.6 if k == m else 0.25 if k == "none" else 0.05 if k == "other" else 0.1 / n for m in names] for k in kinds])
    table = np.log((table + SMOOTHING * guess / guess.sum(axis=0)) / (table.sum(axis=0) + SMOOTHING))
    return dict(zip(kinds, table, strict=True))


def identify(rows: DataFrame, model: TextModel, text: Column, declared: Column, suffix: Column, host: Column) -> DataFrame:
    """All columns of ``rows``, then language, posterior double, text_language, accepted (these names are replaced).

    declared, suffix and host are string columns; null means no such evidence, and rows without a host share one.
    language is the best of the model's, null if it has none; a row is accepted if its text holds a letter and its
    posterior, beside all other languages and none of them, is at least ACCEPT. Null or empty texts, repeated rows and empty tables all give their rows back. The
    priors of a row leave out what the row itself gave.
    """
    spark, names, n = lean(rows.sparkSession), model.languages, len(model.languages)
    new = ["language", "posterior", "text_language", "accepted"]
    kind = "language string, posterior double, text_language string, accepted boolean"
    shared = spark.sparkContext.broadcast(model)
    named = F.array(*map(F.lit, names)) if n else F.array().cast("array<string>")
    said = F.when(declared.isNull() | (declared == ""), "none").when(F.array_contains(named, F.lower(declared)), F.lower(declared)).otherwise("other")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))

    @F.pandas_udf("array<double>")
    def alone(part: pd.Series) -> pd.Series:
        forget()
        found = map(shared.value.weighed, part)
        return pd.Series([alone_of(e, other).tolist() if len(e) and n else None for e, other in found], dtype=object)

    key = [said.alias("d"), F.coalesce(suffix, F.lit("")).alias("s"), F.coalesce(host, F.lit("")).alias("h")]
    # a filter on ``own`` before the sums would go below its column, and each text would be weighed twice
    seen = rows.select(*key, alone(raw).alias("own"))
    groups = materialize(sums(seen, ["d", "s", "h"], n, "own").where("own[0] is not null") if n else seen.where("false"), "language-sums")
    tables = confusion({r.d: r.own for r in sums(groups, ["d"], n, "own").collect()} if n else {}, names)
    hosts, suffixes = (sums(groups, k, n, "own") if n else groups.select(*k, "own") for k in (["s", "h"], ["s"]))
    whole = smoothed(sum((np.array(r.own) for r in sums(groups.withColumn("all", F.lit(1)), ["all"], n, "own").collect()), np.zeros(n)), np.full(n, 1 / max(1, n))) if n else np.zeros(0)
    priors = hosts.withColumnRenamed("own", "of_host").join(suffixes.withColumnRenamed("own", "of_suffix"), "s")

    @F.pandas_udf(kind)
    def fuse(texts: pd.Series, kinds: pd.Series, of_host: pd.Series, of_suffix: pd.Series) -> pd.DataFrame:
        forget()
        out = []
        for t, d, by_host, by_suffix in zip(texts, kinds, of_host, of_suffix, strict=True):
            e, other = shared.value.weighed(t)
            own = alone_of(e, other) if len(e) and n else np.zeros(n)
            levels = [np.maximum(np.array(x) - own, 0) if x is not None else np.zeros(n) for x in (by_suffix, by_host)]
            post = np.log(smoothed(levels[1], smoothed(levels[0], whole))) + tables.get(d, 0.0) + (e if len(e) else 0.0)
            if len(e) and n:  # a declaration tells nothing of whether a text is in none of the languages
                post = softmax(np.append(post, other + np.log(FOREIGN) + np.log(np.exp(tables.get(d, np.zeros(n))).mean())))[:-1]
            else:
                post = softmax(post) if n else post
            best = int(post.argmax()) if n else -1
            out.append((names[best] if n else None, float(post[best]) if n else 0.0, names[int(e.argmax())] if len(e) and n else None, bool(len(e) and n and post[best] >= ACCEPT)))
        return pd.DataFrame(out, columns=new)

    inner = {k: "+".join([*rows.columns, k]) for k in ("d", "s", "h", "fused")}  # names that no column has
    d, s, h, fused = (F.col(f"`{c}`") for c in inner.values())
    base = rows.withColumns(dict(zip(inner.values(), [said, F.coalesce(suffix, F.lit("")), F.coalesce(host, F.lit(""))])))
    priors = priors.select(F.col("s").alias(inner["s"]), F.col("h").alias(inner["h"]), F.col("of_host").alias("+" + inner["h"]), F.col("of_suffix").alias("+" + inner["s"]))
    few = priors.count() <= BROADCAST_HOSTS
    joined = base.join(F.broadcast(priors), [inner["s"], inner["h"]], "left") if few else dealt(base, priors, [inner["s"], inner["h"]], "+" + inner["h"])
    out = joined.withColumn(inner["fused"], fuse(raw, d, F.col(f"`+{inner['h']}`"), F.col(f"`+{inner['s']}`")))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in new], *[fused[c].alias(c) for c in new])


def dealt(rows: DataFrame, priors: DataFrame, key: list[str], weight: str) -> DataFrame:
    """rows with the priors of their host, the rows of a hot host dealt over SALTS parts by a hash of the whole row.

    A host's posteriors sum up to about its rows; one with over a HUBS-th of all is hot, so fewer than HUBS hosts are
    broadcast, and their priors sent to each part.
    """
    salt, hot = "+".join([*rows.columns, "salt"]), "+".join([*rows.columns, "hot"])  # names that no column has
    size = F.aggregate(f"`{weight}`", F.lit(0.0), lambda a, x: a + x)
    least = max(HUB, (priors.agg(F.sum(size)).first()[0] or 0) / HUBS)
    hubs = F.broadcast(priors.where(size > least).select(*key, F.lit(True).alias(hot)))
    hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    part = F.when(F.col(f"`{hot}`"), F.pmod(F.xxhash64(*hashed), F.lit(SALTS))).otherwise(0)
    every = F.when(size > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(hubs, key, "left").withColumn(salt, part.cast("int")).drop(hot).join(priors.withColumn(salt, F.explode(every)), [*key, salt], "left").drop(salt)


def identify_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """Documents: no declaration and no address; the source stands for the host."""
    none = F.lit(None).cast("string")
    return identify(docs, model, F.col("text"), none, none, F.col("source"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Raw pages: text between tags, the html element's lang, the address's host and its last label."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"<[^>]*>|&#?\w+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return identify(pages, model, text, declared, F.substring_index(host, ".", -1), host)
