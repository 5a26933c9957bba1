"""Interval sets: tables of closed ``[first, last]`` intervals of positions, one set per key.

Bits use half-open intervals ``[first, last)``: pass ``half_open=True``.  A set in normal form is sorted,
disjoint and has no two intervals that touch; the operators give that form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bucket in range joins.
BUCKET = 4096


def normalised(a: Column, b: Column) -> Column:
    """The interval between any two ends."""
    return F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))


def union(table: DataFrame, keys: list[str], half_open: bool = False) -> DataFrame:
    """All intervals of each set in normal form; those that overlap or touch become one."""
    kept = table.where("first < last" if half_open else "first <= last")
    order = Window.partitionBy(*keys).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    touch = before if half_open else before + 1
    new = F.when(before.isNull() | (F.col("first") > touch), 1).otherwise(0)
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = kept.select(*keys, "first", "last", new.alias("new")).withColumn("island", island)
    return numbered.groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def _sweep(a: DataFrame, b: DataFrame, keys: list[str], half_open: bool, kept: str) -> DataFrame:
    """One sweep over the ends of both sets, no join of intervals with intervals; ``kept`` says which stretches stay."""
    one = 0 if half_open else 1

    def ends(t: DataFrame, mine: str, other: str) -> DataFrame:
        t = union(t, keys, half_open)
        step = lambda at, d: t.select(*keys, at.alias("at"), F.lit(d).alias(mine), F.lit(0).alias(other))
        return step(F.col("first"), 1).unionByName(step(F.col("last") + one, -1))

    steps = ends(a, "in_a", "in_b").unionByName(ends(b, "in_b", "in_a")).groupBy(*keys, "at").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    order = Window.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select(*keys, "at", F.lead("at").over(order).alias("next"), F.sum("in_a").over(so_far).alias("in_a"), F.sum("in_b").over(so_far).alias("in_b"))
    left = swept.where(f"next IS NOT NULL AND {kept}")
    return union(left.select(*keys, F.col("at").alias("first"), (F.col("next") - one).alias("last")), keys, half_open)


def difference(a: DataFrame, b: DataFrame, keys: list[str], half_open: bool = False) -> DataFrame:
    """What is in ``a`` and not in ``b``."""
    return _sweep(a, b, keys, half_open, "in_a > 0 AND in_b = 0")


def intersection(a: DataFrame, b: DataFrame, keys: list[str], half_open: bool = False) -> DataFrame:
    """What both sets have."""
    return _sweep(a, b, keys, half_open, "in_a > 0 AND in_b > 0")


def stats(table: DataFrame, keys: list[str], half_open: bool = False) -> DataFrame:
    """Per set in normal form: least and greatest position, positions, intervals.  Sets without intervals have no row."""
    size = F.col("last") - F.col("first") + (0 if half_open else 1)
    top = F.max("last") - (1 if half_open else 0)
    return table.groupBy(*keys).agg(F.min("first").alias("lowest"), top.alias("highest"), F.sum(size).alias("positions"), F.count(F.lit(1)).alias("segments"))


def enumerate_positions(table: DataFrame, keys: list[str]) -> DataFrame:
    """One row per selected position."""
    return table.where("first <= last").select(*keys, F.explode(F.sequence("first", "last")).alias("pos"))


def slice_positions(table: DataFrame, keys: list[str], start: int, length: int) -> DataFrame:
    """The ``start``-th to ``start + length - 1``-th selected positions of sets in normal form, as intervals; a negative start is trimmed."""
    end = start + length
    start = max(start, 0)
    order = Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(order), F.lit(0))
    placed = table.withColumn("before", before)
    first = F.greatest(F.col("first"), F.col("first") + start - F.col("before"))
    last = F.least(F.col("last"), F.col("first") + end - 1 - F.col("before"))
    return placed.select(*keys, first.alias("first"), last.alias("last")).where("first <= last")


def members(points: DataFrame, table: DataFrame, keys: list[str], pos: str = "pos", half_open: bool = False, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``points`` whose position is selected.

    Intervals are in normal form, so a point lies in one at most; both sides meet by bucket of positions,
    which makes the range condition an equality join with a residual filter.
    """
    last = F.col("last") - (1 if half_open else 0)
    cover = table.where("first < last" if half_open else "first <= last").select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("first").alias("_first"), last.alias("_last")
    )
    by = lambda c: F.expr(f"floor({c} / {bucket})")
    cover = cover.withColumn("_bucket", F.explode(F.sequence(by("_first"), by("_last"))))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys], F.expr(f"floor({pos} / {bucket})") == F.col("_bucket"))
    return points.join(cover, same & F.col(pos).between(F.col("_first"), F.col("_last")), "left_semi")


def contains(segments: Column, pos: Column) -> Column:
    """Membership in an array of closed intervals, without a join."""
    return F.exists(segments, lambda s: pos.between(s["first"], s["last"]))


def toggle(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Each change ``(first, last, tail)`` removes its interval if its tail is selected, else adds it; one change per key."""
    tails = changes.select(*keys, F.col("tail").alias("pos")).distinct()
    on = members(tails, current, keys).select(*keys).distinct()
    remove, add = changes.join(on, keys, "left_semi"), changes.join(on, keys, "left_anti")
    ends = [*keys, "first", "last"]
    return union(difference(current, remove.select(*ends), keys).unionByName(add.select(*ends)), keys)


def insert_space(table: DataFrame, keys: list[str], at: Column, length: Column) -> DataFrame:
    """Make room for ``length`` new positions before ``at``: later intervals move, one around ``at`` is split."""
    parts = F.when(
        (F.col("first") < at) & (F.col("last") >= at),
        F.array(F.struct(F.col("first"), (at - 1).alias("last")), F.struct((at + length).alias("first"), (F.col("last") + length).alias("last"))),
    ).otherwise(
        F.array(F.when(F.col("first") >= at, F.struct((F.col("first") + length).alias("first"), (F.col("last") + length).alias("last"))).otherwise(F.struct("first", "last")))
    )
    return table.select(*keys, F.explode(parts).alias("s")).select(*keys, "s.first", "s.last")


def remove_space(table: DataFrame, keys: list[str], at: int, length: int) -> DataFrame:
    """Take positions ``at`` to ``at + length - 1`` away: what lay on them goes, later intervals move down."""
    gone, ends = at + length, [*keys, "first", "last"]
    low = table.select(*keys, "first", F.least("last", F.lit(at - 1)).alias("last"))
    high = table.select(*keys, (F.greatest("first", F.lit(gone)) - length).alias("first"), (F.col("last") - length).alias("last")).where(F.col("last") >= at)
    return union(low.where("first <= last").select(*ends).unionByName(high.select(*ends)), keys)


def shift_left(bit_from: Column, bit_to: Column, by: Column) -> Column:
    """A half-open interval moved down; null if its end falls below zero."""
    return F.when(bit_to >= by, F.struct(F.greatest(bit_from - by, F.lit(0)).alias("bit_from"), (bit_to - by).alias("bit_to")))


def last_change(table: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Single-selection mode: of each set only its latest interval."""
    ends = F.max_by(F.struct("first", "last"), seq).alias("s")
    return table.groupBy(*keys).agg(ends).select(*keys, "s.first", "s.last")


def coalesced_changes(events: DataFrame, keys: list[str]) -> DataFrame:
    """One change per gesture: the hull of its changes, and how many there were."""
    return events.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("changes"))


def changed_range(old_first: Column, old_last: Column, new_first: Column, new_last: Column) -> Column:
    """Hull of an interval before and after."""
    return F.struct(F.least(old_first, new_first).alias("first"), F.greatest(old_last, new_last).alias("last"))


def cell_index(row: Column, col: Column, width: int) -> Column:
    """Position of a table cell; column 0 holds addresses and has none (-2)."""
    return F.when(col == 0, F.lit(-2).cast("long")).otherwise(row.cast("long") * width + (col - 1))


def index_cell(pos: Column, width: int) -> Column:
    return F.struct(F.call_function("div", pos.cast("long"), F.lit(width).cast("long")).alias("row"), (F.pmod(pos, F.lit(width)) + 1).alias("col"))


def summary(segments: Column, positions: Column) -> Column:
    """``empty``, ``n bytes`` for one interval, ``n segs`` for more."""
    return F.when(segments == 0, F.lit("empty")).when(segments == 1, F.format_string("%d bytes", positions)).otherwise(F.format_string("%d segs", segments))


def expression_intervals(definitions: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals whose ends are named values: ``definitions(first_name, last_name)`` with ``values(name, value)`` per key."""
    first = values.select(*keys, F.col("name").alias("first_name"), F.col("value").alias("first"))
    last = values.select(*keys, F.col("name").alias("last_name"), F.col("value").alias("last"))
    return definitions.join(first, [*keys, "first_name"]).join(last, [*keys, "last_name"]).select(*keys, "first", "last")


def as_closed(bits: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open bit intervals ``(bit_from, bit_to)`` as closed ones, in which every operator here works; empty ones go."""
    return bits.where("bit_from < bit_to").select(*keys, F.col("bit_from").alias("first"), (F.col("bit_to") - 1).alias("last"))


def as_half_open(table: DataFrame, keys: list[str]) -> DataFrame:
    """Closed intervals as half-open bit intervals."""
    return table.select(*keys, F.col("first").alias("bit_from"), (F.col("last") + 1).alias("bit_to"))


def cleared(table: DataFrame) -> DataFrame:
    """The empty selection, with the table's columns."""
    return table.where(F.lit(False))


def is_empty(keys_table: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """For every key whether its selection is empty."""
    some = table.select(*keys).distinct().withColumn("some", F.lit(True))
    return keys_table.select(*keys).distinct().join(some, keys, "left").select(*keys, F.col("some").isNull().alias("empty"))


def anchor_and_lead(gestures: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Where the latest gesture ``(anchor, lead)`` began and where it is, and the interval between."""
    last = gestures.groupBy(*keys).agg(F.max_by(F.struct("anchor", "lead"), seq).alias("s")).select(*keys, "s.anchor", "s.lead")
    return last.withColumn("first", F.least("anchor", "lead")).withColumn("last", F.greatest("anchor", "lead"))


def swapped(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What a change of a selection's model has to redraw: the hull of both selections of each key."""
    return coalesced_changes(old.select(*keys, "first", "last").unionByName(new.select(*keys, "first", "last")), keys).drop("changes")


def single(first: Column, last: Column) -> Column:
    """The selection of one interval: its segments, from ends in either order."""
    return F.array(F.struct(F.least(first, last).alias("first"), F.greatest(first, last).alias("last")))


def address_interval(start: Column, length: Column) -> Column:
    """The interval that an address's start and length, given as text or numbers, name; null if they name none."""
    a, n = start.try_cast("long"), length.try_cast("long")
    return F.when((a >= 0) & (n > 0), F.struct(a.alias("first"), (a + n - 1).alias("last")))
