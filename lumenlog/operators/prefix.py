"""Running values over a key in two passes: within blocks of a key's rows, and over the blocks' summaries.

A window over a key puts all its rows into one task. Here rows are cut into blocks that follow their order, so that a
task holds one block of a key; what goes through a window over the whole key is one summary row per block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A block holds the rows of 2^16 values of the order key's last number.
BITS = 16
#: What frames of a block reach up to: the row, all rows of the row's order key, the row before.
FRAMES = {"row": (Window.unboundedPreceding, Window.currentRow), "ties": (Window.unboundedPreceding, Window.currentRow), "before": (Window.unboundedPreceding, -1)}


def block_of(rows: DataFrame, seq: str = "seq", bits: int = BITS) -> Column:
    """A column that never falls as ``seq`` rises, and is alike for few rows.

    seq: a number, or a struct that ends in one, as the scans give it: (file, block start, row).
    """
    kind = rows.schema[seq].dataType
    if not isinstance(kind, StructType):
        return F.shiftright(F.col(seq).cast("long"), bits)
    *outer, last = kind.names
    return F.struct(*(F.col(f"{seq}.{c}").alias(c) for c in outer), F.shiftright(F.col(f"{seq}.{last}").cast("long"), bits).alias(last))


@dataclass(frozen=True)
class Running:
    """A running value. kind: sum, min, max, or last (the last that is not null)."""

    name: str
    value: Column
    kind: str = "sum"

    def over(self, column: Column, window) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, True)}[self.kind](column).over(window)

    def joined(self, earlier: Column, own: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(earlier, F.lit(0)) + F.coalesce(own, F.lit(0))
        return F.coalesce(own, earlier) if self.kind == "last" else (F.least if self.kind == "min" else F.greatest)(earlier, own)

    def summed(self, order: list[str]) -> Column:
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value)


def running(rows: DataFrame, key: list[str], wanted: list[Running], order: list[str] | None = None, frame: str = "row", seq: str = "seq", bits: int = BITS) -> DataFrame:
    """``rows`` and the wanted running values over ``key`` by ``order`` (seq, and columns that part equal seqs).

    frame: up to the row itself (row), up to all rows of its order key (ties), or up to the row before it (before).
    The key's columns must not be null. Block summaries are summed in each task before they are shuffled.
    """
    order = order or [seq]
    blocks = [*key, "block"]
    rows = rows.withColumn("block", block_of(rows, seq, bits))
    whole = rows.groupBy(*blocks).agg(*(w.summed(order).alias(w.name) for w in wanted))
    over_blocks = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.select(*blocks, *(w.over(F.col(w.name), over_blocks).alias(f"earlier_{w.name}") for w in wanted))
    within = Window.partitionBy(*blocks).orderBy(*order)
    within = within.rangeBetween(*FRAMES[frame]) if frame == "ties" else within.rowsBetween(*FRAMES[frame])
    met = rows.join(earlier, blocks)
    return met.withColumns({w.name: w.joined(F.col(f"earlier_{w.name}"), w.over(w.value, within)) for w in wanted}).drop("block", *(f"earlier_{w.name}" for w in wanted))
