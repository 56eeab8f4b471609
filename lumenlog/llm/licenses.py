"""License scans by diagonal voting: word k-grams of texts joined to their places in templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import lean, text_bytes

#: Words of a gram, and how far apart (words inserted or left out) diagonals of one span may lie.
GRAM, DRIFT = 4, 3
#: Part of a template's words that a span must hold, in order, to count.
COVER = 0.75

#: The base phrases and their labels, as the contract states them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and sentences of well-known licenses, as published, with the label each stands for.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def gram_hashes(hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Rolling hash of each ``size`` words that stand together, as signed 64-bit numbers."""
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size if len(out) else 0):
        out = out * _BASE + hashes[k : k + len(out)]
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def word_hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in found], np.uint64)


def template_places() -> list[tuple[int, int, int]]:
    """(gram, template, place) of every gram of every template: a few hundred rows, whatever the corpus."""
    out = []
    for t, (_, text) in enumerate(TEMPLATES):
        grams = gram_hashes(word_hashes(words(text.encode())))
        out += [(int(g), t, i) for i, g in enumerate(grams)]
    return out


def base_places(found: list[bytes], phrase: list[bytes]) -> list[int]:
    n, out = len(phrase), []
    last = phrase[-1]
    at = -1
    try:
        while True:
            at = found.index(last, at + 1)
            if at >= n - 1 and found[at - n + 1 : at + 1] == phrase:
                out.append(at - n + 1)
    except ValueError:
        return out


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: row, doc_id, n_words, n_base, first_word, last_word, base (bit k: label k was found), grams."""
    phrases = [(p.encode().split(), 1 << k) for k, p in enumerate(PHRASES)]
    names = ["n_words", "n_base", "first_word", "last_word", "base"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b, out, grams = whole.slice(lo, 500), [], []
                for text in b.column(2):
                    found, at, bits = words(text.as_py()), [], 0
                    for phrase, bit in phrases:
                        hit = base_places(found, phrase)
                        at += hit
                        bits |= bit * bool(hit)
                    out.append((len(found), len(at), min(at, default=None), max(at, default=None), bits))
                    grams.append(gram_hashes(word_hashes(found)))
                ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, lists], ["row", "doc_id", *names, "grams"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(of, ", ".join(f"{n} long" for n in ("row", "doc_id", *names)) + ", grams array<bigint>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII; null text: empty. Base: all
    places where a phrase's words stand consecutively. Every k-gram of a text votes, for each template place it
    equals, for the diagonal text place minus template place; diagonals within DRIFT of each other are one span; a
    span counts if the template words under its matching grams make up COVER of the template. spans: array of (label,
    start, end, cover), words from 0, end exclusive. score: the best cover, at least 0.5 with a base place. Null ids
    and repeated rows return as they are; other columns are ignored; an empty table gives an empty result.
    """
    spark = lean(docs.sparkSession)
    places = F.broadcast(spark.createDataFrame(template_places(), "gram long, template int, place int"))
    sizes = [len(words(t.encode())) for _, t in TEMPLATES]
    if max(sizes) > 64:
        raise ValueError("a template has over 64 words, the bits of a long")
    doc = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    keep = [F.max(c).alias(c) for c in doc]
    votes = prepared(docs, id_col, text_col).select("row", *doc, F.posexplode_outer("grams").alias("at", "gram")).join(places, "gram", "left")
    diagonals = votes.groupBy("row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        *keep, F.min("at").alias("lo"), F.max("at").alias("hi"), F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= DRIFT, 0).otherwise(1)
    # A document without any vote has one row, without a template, that goes along; so texts are read once.
    spans = diagonals.withColumn("gap", gap).withColumn("span", F.sum("gap").over(order))
    spans = spans.groupBy("row", "template", "span").agg(*keep, F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("bits").alias("bits"))
    covered = F.col("bits")
    for k in range(1, GRAM):
        covered = covered.bitwiseOR(F.shiftleft("bits", k))
    at = F.col("template") + 1
    cover = F.bit_count(covered) / F.element_at(F.array(*map(F.lit, sizes)), at)
    label = F.element_at(F.array(*[F.lit(name) for name, _ in TEMPLATES]), at)
    found = F.struct(label.alias("label"), F.col("lo").cast("long").alias("start"), (F.col("hi") + GRAM).cast("long").alias("end"), cover.alias("cover"))
    hits = spans.withColumn("found", F.when(cover >= COVER, found)).select("row", *doc, "found")
    whole = hits.groupBy("row").agg(*keep, F.array_sort(F.collect_list("found")).alias("spans"))
    base = F.array_compact(F.array(*[F.when(F.col("base").bitwiseAND(1 << k) != 0, F.lit(name)) for k, name in enumerate(PHRASES.values())]))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    return whole.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        "spans",
    )
