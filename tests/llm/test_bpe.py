import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenlog.llm import bpe

ODD = [
    None, "", " \n\t", "Hello, world!", "<|endoftext|>A<|startoftext|> b<|endoftext|>", "aaaaaaaaa hahahaha !!!!!!!",
    "É é ΑΣ ΟΔΥΣΣΕΥΣ İstanbul K ẞ", "a\x1cb \x85  x y ​", "日本語 ٣½² 😀👨‍👩‍👧", "it's they'll I'd ''s x'tt", "</w> the</w>",
]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_random_texts(theirs):
    rng, t = random.Random(4), bpe.tokenizer(bpe.read_spec())
    letters = "aabbhostner'<|>.!? \n\x1céßΣσ½日😀0Z_" + "́"
    for k in range(4000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 20)))
        s = rng.choice("ahot!") * rng.randint(1, 25) if k % 5 == 0 else s
        want = theirs.encode(s, add_special_tokens=False).ids
        assert t.encode(s) == want, repr(s)
        assert t.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_gadgets_against_plain_merging():
    rng = random.Random(9)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        while len(merges) < 14:
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab and len(u + v) < 9:
                merges.append([u, v])
                vocab[u + v] = len(vocab)
        auto = bpe.Automaton(vocab, merges, "")
        for _ in range(150):
            word = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 16))]
            parts = list(word)
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == u and parts[i + 1] == v:
                        parts[i : i + 2] = [u + v]
                    i += 1
            assert [auto.labels[i] for i in auto.encode(word)] == parts


def test_operator_and_query_columns(spark, theirs, tmp_path):
    from lumenlog.llm.queries import op8_bpe

    texts = [*ODD, "word " * 40_000, "x" * 30_000, ODD[3]]
    rows = [(i, t, [1]) for i, t in enumerate(texts)] + [(None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode_decode(docs).collect()}
    sums = {r.doc_id: r for r in op8_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(sums) == len(rows)
    for i, text, _ in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].decoded) == (ids, decoded)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(sums[i]) == (i, len(ids), sha(" ".join(map(str, ids))), sha(decoded))
    assert bpe.encode_decode(docs.limit(0)).count() == 0


def test_cache_turns_over(theirs):
    t = bpe.Tokenizer(bpe.read_spec(), limit=5)
    text = "one two three four five six seven eight one two nine ten one"
    for _ in range(3):
        assert t.encode(text) == theirs.encode(text, add_special_tokens=False).ids
        assert len(t.words) <= 5
