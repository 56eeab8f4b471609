"""Cheapest repairs of conversations: a dynamic programme whose edit prefixes are persistent linked nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import forget, lean, materialize

# Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: Characters that count as blank; ends of whole sentences.
BLANKS, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", (".", "!", "?")
LEGAL = {"su", "ua", "au"}
#: States of the wanted order of roles, (s?(ua)+)?: nothing yet, after s, after u, after a. The first and last may end.
START, S, U, A = range(4)
#: Where each state goes with a role's initial.
STEPS = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
NEXT = {START: U, S: U, U: A, A: U}
BASE, MODULUS = 257, (1 << 61) - 1
#: Rows after which the part that all prefixes share is written down and its nodes are given up.
SETTLE = 512


class Node:
    """A prefix of edits: its last edit, and its ancestors 1, 2, 4, ... edits before, the first of them its parent.

    Prefixes share what they have in common. hash: of all edits from the first one on, so two prefixes of a length
    differ if their hashes differ; if the hashes are equal, that is verified.
    """

    __slots__ = ("edit", "depth", "hash", "up")

    def __init__(self, edit: str = "", parent: Node | None = None) -> None:
        self.edit, self.up = edit, []
        if parent is None:
            self.depth = self.hash = 0
            return
        self.depth, self.hash = parent.depth + 1, (parent.hash * BASE + ord(edit)) % MODULUS
        while parent is not None:
            self.up.append(parent)
            k = len(self.up) - 1
            parent = parent.up[k] if k < len(parent.up) else None

    def at(self, depth: int) -> Node:
        """The ancestor of that depth, by steps of powers of two."""
        node, rest = self, self.depth - depth
        while rest:
            k = rest.bit_length() - 1
            node, rest = node.up[k], rest - (1 << k)
        return node

    def text(self) -> str:
        """The edits since the root."""
        edits, node = [], self
        while node.up:
            edits.append(node.edit)
            node = node.up[0]
        return "".join(reversed(edits))


def same(a: Node, b: Node) -> bool:
    """Whether two prefixes of a length are alike, edit by edit until they meet in a node."""
    while a is not b:
        if a.edit != b.edit or not a.up:
            return False
        a, b = a.up[0], b.up[0]
    return True


def before(a: Node, b: Node) -> bool:
    """Whether a's edits come before b's in ASCII order, by the longest common prefix: halving steps to the last place
    where hashes differ. Equal hashes are verified; where one misleads, the edits are compared in full."""
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if x is y or x.hash == y.hash:
        return a.depth < b.depth if same(x, y) else a.text() < b.text()
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and k < len(y.up) and x.up[k] is not y.up[k] and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    return x.edit < y.edit if same(x.up[0], y.up[0]) else a.text() < b.text()


Cell = tuple[int, Node]


def best(options: list[tuple[int, Node, str]]) -> Cell | None:
    """The cheapest of (cost, prefix, edit to add or none), of equal ones the least in ASCII order.

    Two prefixes of a state, rows read and a cost never begin one another: what the longer one adds would be inserts,
    which cost. So the order of prefixes is that of all their continuations.
    """
    if not options:
        return None
    least, found = min(o[0] for o in options), None
    for cost, prefix, edit in options:
        if cost == least:
            node = Node(edit, prefix) if edit else prefix
            if found is None or before(node, found):
                found = node
    return least, found


class Audit:
    """The cheapest edits of a conversation, its rows added in order."""

    def __init__(self) -> None:
        self.cells: list[Cell | None] = [(0, Node()), None, None, None]
        self.settled, self.rows = [], 0
        self.insert()

    def insert(self) -> None:
        """Insertions after the rows read; more than two in a row would come back to a state at a cost."""
        c = self.cells
        come = [(c[k][0] + INSERT, c[k][1], "I") for k in (START, S, A) if c[k]]
        c[U] = best(come + ([(*c[U], "")] if c[U] else []))
        c[A] = best([(c[U][0] + INSERT, c[U][1], "I")] + ([(*c[A], "")] if c[A] else []))

    def add(self, initial: str, doomed: bool, truncated: bool) -> None:
        """doomed: it must be deleted."""
        to: list[list[tuple[int, Node, str]]] = [[], [], [], []]
        for state, cell in enumerate(self.cells):
            if cell is None:
                continue
            cost, prefix = cell
            to[state].append((cost + DELETE, prefix, "D"))
            if not doomed:
                extra = TRUNCATED if truncated else 0
                to[NEXT[state]].append((cost + REROLE + extra, prefix, "R"))
                if (state, initial) in STEPS:
                    to[STEPS[state, initial]].append((cost + KEEP + extra, prefix, "K"))
        self.cells = [best(options) for options in to]
        # What follows costs, after a, no more than after s, and no more than 3 over what it costs from the start,
        # where alone an s may follow: that row is deleted. So dearer cells than these can neither win nor tie.
        self.insert()
        for state, over in ((START, DELETE), (S, 0)):
            if self.cells[state] and self.cells[state][0] > self.cells[A][0] + over:
                self.cells[state] = None
        self.rows += 1
        if self.rows % SETTLE == 0:
            self.settle()

    def settle(self) -> None:
        """Write down what all prefixes share, and go on from its last node as the root; so memory is in proportion to
        the edits (a character each) and to what is still open."""
        heads = [c[1] for c in self.cells if c]
        depth = min(h.depth for h in heads)
        meet = [h.at(depth) for h in heads]
        while any(m is not meet[0] for m in meet):
            meet = [m.up[0] for m in meet]
        self.settled.append(meet[0].text())
        root = Node()
        root.depth, root.hash, root.edit = meet[0].depth, meet[0].hash, meet[0].edit
        anew = {meet[0]: root}

        def copy(node: Node) -> Node:
            path = []
            while node not in anew:
                path.append(node)
                node = node.up[0]
            for n in reversed(path):
                anew[n] = Node(n.edit, anew[n.up[0]])
            return anew[path[0]] if path else anew[node]

        self.cells = [c and (c[0], copy(c[1])) for c in self.cells]

    def end(self) -> tuple[int, str]:
        """Cost and edits."""
        cost, node = best([(*c, "") for c in (self.cells[START], self.cells[A]) if c])
        return cost, "".join(self.settled) + node.text()


@dataclass
class Summary:
    """What is found in a conversation, its rows given in order."""

    audit: Audit = field(default_factory=Audit)
    seen: set[bytes] = field(default_factory=set)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first: int | None = None
    last: int | None = None
    role: str | None = None

    def add(self, turn: int | None, initial: str, blank: bool, ended: bool, digest: bytes) -> None:
        repeated, cut = not blank and digest in self.seen, not blank and not ended
        cut = cut and not repeated
        self.seen.add(digest)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + cut
        self.illegal += self.role is not None and self.role + initial not in LEGAL
        self.role = initial
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.audit.add(initial, blank or repeated, cut)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return min(gaps, 2**63 - 1), self.blank, self.duplicate, self.truncated, self.illegal, *self.audit.end()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
FOUND = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string"
SENT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])


def ordered(rows: DataFrame, *first: str) -> DataFrame:
    """A conversation's rows in one task, in order, streamed: turn (nulls first), then role, text's digest and copy."""
    by = [F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "digest", "copy"]
    return rows.repartition("conv_id").sortWithinPartitions(*by)


def prepared(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, digest): nulls of role and text are one space; copy: a column of the input that
    orders equal rows, or 0; digest: of role and text."""
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    copy = F.col("copy") if "copy" in conversations.columns else F.lit(0)
    digest = F.unhex(F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(v.alias(c) for c, v in named.items()), copy.alias("copy"))
    return rows.withColumn("digest", digest)


def audits(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    conversations: conv_id, turn, role, text, and copy if equal rows have an order; other columns are ignored. every:
    conv_ids that return even without rows (zeros and an empty audit). A null conv_id is a conversation too; a null
    role or text counts as one space, an empty role has an empty initial. Rows of one turn go by role and digest.
    What is shuffled of a row are flags and a digest, not its text. A task reads its conversations row by row and
    keeps of each an edit's letter and a digest per row. gaps stops at the largest long.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    rows = prepared(conversations).select(
        "conv_id", "turn", "role", "digest", "copy", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), last.isin(*ENDS).alias("ended")
    )
    if every is not None:
        named = every.select(F.col("conv_id").cast("long")).distinct()
        rows = rows.unionByName(named, allowMissingColumns=True)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out, conv, found = [], None, None
        for b in batches:
            for k, turn, digest, initial, blank, ended in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if found is None or k != conv:
                    if found is not None:
                        out.append((conv, *found.row()))
                    conv, found = k, Summary()
                if digest is not None:
                    found.add(turn, initial, blank, ended, digest)
            if out:
                yield sent(out, SENT)
                out = []
        if found is not None:
            yield sent([(conv, *found.row())], SENT)

    lean(conversations.sparkSession)
    return ordered(rows).select("conv_id", "turn", "digest", "initial", "blank", "ended").mapInArrow(of, FOUND)


def sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def edited(rows: Iterable[tuple], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row that a conversation has after its edits. rows: (role, text) in order.

    How many rows there will be tells their roles: an odd number begins with s.
    """
    rows, place = iter(rows), -((len(audit) - audit.count("D")) % 2)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        yield edit, role if edit == "K" else ("user", "assistant")[place % 2], text
        place += 1


def streamed(conversations: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """Each conversation's row of ``found`` (names in all), followed by the conversation's rows."""
    blank = F.lit(None)
    heads = found.select(F.lit(0).alias("kind"), "conv_id", blank.cast("long").alias("turn"), blank.cast("string").alias("role"), blank.cast("string").alias("text"), blank.cast("int").alias("copy"), blank.cast("binary").alias("digest"), *names)
    rows = prepared(conversations).select(F.lit(1).alias("kind"), "conv_id", "turn", "role", "text", F.col("copy").cast("int").alias("copy"), "digest")
    both = heads.unionByName(rows, allowMissingColumns=True)
    return ordered(both, "kind").select("kind", "conv_id", "role", "text", *names)


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """(head, rows) of each conversation of a sorted stream; rows are read as they are asked for."""
    flow = (r for b in batches for r in pa.Table.from_batches([b]).to_pylist())
    held: list[dict] = [r for r in [next(flow, None)] if r is not None]

    def rows() -> Iterator[tuple[str, str]]:
        for r in flow:
            if r["kind"] == 0:
                held.append(r)
                return
            yield r["role"], r["text"]

    while held:
        own = rows()
        yield held.pop(), own
        for _ in own:
            pass


LINES = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def repair(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """The rows after their edits: conv_id, at (from 0), edit (K, R, I), role, text. found: conv_id and audit of each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out = []
        for head, rows in conversations_of(batches):
            for at, line in enumerate(edited(rows, head["audit"])):
                out.append((head["conv_id"], at, *line))
                if len(out) == 1000:
                    yield sent(out, LINES)
                    out = []
        if out:
            yield sent(out, LINES)

    return streamed(conversations, found, ["audit"]).mapInArrow(of, "conv_id long, at long, edit string, role string, text string")


def repaired_digests(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """All columns of ``found`` (as audits() has them) and repaired_sha256: of the repaired rows, role:text joined by
    newlines. A conversation is read in order in one task, as the hash must be, and none of its texts is kept."""
    schema = SENT.append(pa.field("repaired_sha256", pa.string()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out = []
        for head, rows in conversations_of(batches):
            digest = hashlib.sha256()
            for at, (_, role, text) in enumerate(edited(rows, head["audit"])):
                digest.update(("\n" * (at > 0) + role + ":" + text).encode())
            out.append((*(head[c] for c in SENT.names), digest.hexdigest()))
            if len(out) == 500:
                yield sent(out, schema)
                out = []
        if out:
            yield sent(out, schema)

    return streamed(conversations, found, [*COUNTS, "audit"]).mapInArrow(of, FOUND + ", repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage that op11 repairs, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes
    its sentence ends, 3 repeats it, 4 makes its role user. Nulls count as one space. Returns conv_id, turn, role, text, copy."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def repaired(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """audits() and repaired_sha256, in one. The audits are written down between the two passes over the rows."""
    return repaired_digests(conversations, materialize(audits(conversations, every), "audits"))
