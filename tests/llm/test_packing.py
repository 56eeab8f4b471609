import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumenlog.llm import packing

SCHEMA = "doc_id long, text string, start string, offset int"


def test_pieces_hold_every_id_once_without_padding(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta!", "gämma", "x<|endoftext|>y", "\x1c!", "deltaepsilonzeta"]
    texts = [None, "", "\n"] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 400, 3000]))) for _ in range(120)] + ["dup dup"] * 30 + ["long word " * 20_000]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack(docs).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for placed in by_seq.values():
        at = 0
        for r in sorted(placed, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_rule_places_where_the_sum_of_squares_ends_least():
    rng, packer, window = random.Random(1), packing.SumOfSquares(64), 64
    for k in range(2000):
        size, level = rng.randint(1, 63), packer.level.copy()
        h = packer.place(size)
        costs = {}
        for at in [0, *(h for h in range(1, window - size + 1) if level[h])]:
            after = level.copy()
            if at:
                after[at] -= 1
            if at + size < window:
                after[at + size] += 1
            costs[at] = int((after[1:window] ** 2).sum())
        assert costs[h] == min(costs.values())
        packer.add((k, 0, b"", 0), size)


def test_whole_documents_are_mostly_kept_together():
    rng = random.Random(2)
    docs = [(i, b"abcd" * rng.randint(1, 900)) for i in range(5000)]
    cut = sum(len(w) for w in packing.pieces(iter(docs), 1024)) - len(docs)
    assert cut < 0.2 * len(docs)  # cutting at every window end would cut over 2000


def test_empty_and_null_ids(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b", "", 1), (None, None, "", 1), (3, "a b", "", 1), (3, "a b", "", 1)], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == [("3", 3), ("3", 3), ("None", 1), ("None", 3)]


def test_cached_ids_are_the_library_s():
    rng, spec = random.Random(8), packing.bpe.read_spec()
    model, mine = Tokenizer.from_str(spec), packing.WordIds(spec, limit=40)
    odd = "".join(map(chr, range(128, 256)))

    for k in range(60):
        letters = "aabhost'<|>.! \n\t\x1céΣİ日😀0" + "́" if k % 2 else "aBs't \x1c0" + odd
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(["", "a<|endoftext|>B", " x"]) for _ in range(20)]
        want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(i, "<u4").tolist() for i in mine.encode(texts)] == want
    assert list(mine.encode([])) == [] and list(mine.encode(["", " "])) == [b"", b""]


def test_long_texts_are_taken_in_chunks(monkeypatch):
    spec = packing.bpe.read_spec()
    model, mine = Tokenizer.from_str(spec), packing.WordIds(spec)
    monkeypatch.setattr(packing.bpe, "CHUNK", 50)
    texts = ["", "short one", "Some words, É́ and\u00a0more <|endoftext|> " * 9, "x" * 200, "a " * 200 + "b" * 99 + " c", "tail"]
    assert [np.frombuffer(i, "<u4").tolist() for i in mine.encode(texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [packing.bpe.tokenizer(spec).encode(t) for t in texts] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
