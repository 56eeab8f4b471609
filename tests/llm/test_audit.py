import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from lumenlog.llm import audit
from lumenlog.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest int"


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(classes):
    """Every prefix of edits of every state, as whole strings. classes: (initial, doomed, truncated)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(cells):
        while True:
            more = dict(cells)
            for state, (cost, edits) in cells.items():
                for r in "ua":
                    to = step.get((state, r))
                    if to:
                        more[to] = min(more.get(to, (cost + 2, edits + "I")), (cost + 2, edits + "I"))
            if more == cells:
                return cells
            cells = more

    cells = inserted({"": (0, "")})
    for initial, doomed, cut in classes:
        new = {}

        def put(to, value, new=new):
            new[to] = min(new.get(to, value), value)

        for state, (cost, edits) in cells.items():
            put(state, (cost + 3, edits + "D"))
            if not doomed:
                if (state, initial) in step:
                    put(step[state, initial], (cost + cut, edits + "K"))
                for r in "ua":
                    if (state, r) in step:
                        put(step[state, r], (cost + 2 + cut, edits + "R"))
        cells = inserted(new)
    return min(cells[s] for s in ("", "a") if s in cells)


def brute(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for conv, turn, role, text in damage(rows):
        convs[conv].append((turn, role, text))
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}\0{r[1]}\0{r[2]}".encode()).digest()))
        turns, seen, classes, found = [r[0] for r in own if r[0] is not None], set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            blank, repeated = not bare, bool(bare) and (role, text) in seen
            cut = bool(bare) and not repeated and bare[-1] not in ".!?"
            seen.add((role, text))
            found = [a + b for a, b in zip(found, (blank, repeated, cut), strict=True)]
            classes.append((role[:1], blank or repeated, cut))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, edits = cheapest(classes)
        n, rest, lines = len(edits) - edits.count("D"), iter(own), []
        roles = (["s"] if n % 2 else []) + ["user", "assistant"] * (n // 2)
        for e in edits:
            _, role, text = next(rest) if e != "I" else (0, "", "")
            if e != "D":
                want = roles[len(lines)]
                assert e != "K" or role[:1] == want[0]
                lines.append((role if e == "K" else want) + ":" + text)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *found, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def answers(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted([tuple(r) for r in df.select(*names).collect()], key=str)


def make(seed=1, convs=150):
    rng, rows = random.Random(seed), []
    texts = ["Hi.", "Hi", "So?\n", "é!", "end. \x0b\x0c", "", " \t", None, "a ", "x. ", "long " * 3000 + "."]
    for conv in [*range(convs), None]:
        turn = 0
        for _ in range(rng.choice([1, 2, 3, 5, 8, 30])):
            turn += rng.choice([0, 1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn] * 15 + [None]), role, rng.choice(texts) if rng.random() < 0.5 else f"T{rng.randint(0, 99)}.", "x", 1))
    return rows


def test_query_rows_against_brute_force(spark):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    assert answers(audit.repaired(audit.damaged(df.repartition(5)), df)) == brute(rows)


def test_short_sequences_all(spark):
    """All sequences of up to four rows of every class."""
    classes = [(r, d, t) for r in "suat" for d, t in ((False, False), (False, True), (True, False))]
    for n in range(4):
        for seq in product(classes, repeat=n):
            own = audit.Audit()
            for c in seq:
                own.add(*c)
            assert own.end() == cheapest(seq), seq


@pytest.mark.parametrize("modulus", [3, (1 << 61) - 1])
def test_long_sequences_settle_and_survive_collisions(monkeypatch, modulus):
    monkeypatch.setattr(audit, "MODULUS", modulus)
    monkeypatch.setattr(audit, "SETTLE", 7)
    rng = random.Random(2)
    for _ in range(60):
        seq = [(rng.choice("suuaat"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(50, 400))]
        own = audit.Audit()
        for c in seq:
            own.add(*c)
        assert own.end() == cheapest(seq)


def test_prefixes_of_a_long_conversation_are_given_up():
    own = audit.Audit()
    for k in range(20_000):
        own.add("suat"[k % 4], k % 7 == 0, k % 5 == 0)
    assert max(c[1].depth for c in own.cells if c) - sum(map(len, own.settled)) < 2 * audit.SETTLE + 10


def test_repaired_rows_are_what_the_digest_says(spark):
    rows = make(4, 40)
    hurt = audit.damaged(spark.createDataFrame(rows, SCHEMA))
    found = audit.audits(hurt)
    lines = {}
    for r in sorted(audit.repair(hurt, found).collect(), key=lambda r: (str(r.conv_id), r.at)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in audit.repaired_digests(hurt, found).collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
    assert audit.repair(hurt, found).where("edit = 'D'").count() == 0


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert audit.repaired(audit.damaged(none), none).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    only = spark.createDataFrame([(gone, 0, "user", "Hi.", "x", 1)], SCHEMA)
    assert answers(audit.repaired(audit.damaged(only), only)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_on_a_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(QUERIES["op11_audit"](spark, sf)) == brute(rows)
