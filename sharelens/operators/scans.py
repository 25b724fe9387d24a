"""Running sums, look-backs and exact ranks over all rows, without a task that holds them all.

Rows are put in ranges of their order, one for each task, and kept so. What a range
adds up to is a row; the sums of the ranges before it are joined back, and within
its range each row is then counted on. Many small groups lie in one range, a
large group in many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.shared import saved

#: Numbers that are unfolded from one row together.
CHUNK = 1 << 16
#: A sketch of a group's values errs by up to one in ACCURACY of their ranks; values are kept up to SPREAD around a wanted rank.
ACCURACY, SPREAD = 4000, 2 / 4000
#: The bounds of so many groups are sent to all tasks.
FEW_GROUPS = 10_000


def matched(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """`left` joined with `right` on `columns`, of which nulls are equal."""
    names = {c: f"_right_{c}" for c in columns}
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`df` in ranges of (by, order), with the number of its range as `_part`. It is written, as a second look may cut ranges elsewhere."""
    return saved(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def offsets(parts: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """(by, _part, <name>, <name>_before, <name>_all): sums of each range, of the ranges before it and of all, within each group."""
    each = parts.groupBy(*by, "_part").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    group = Window.partitionBy(*(by or [F.lit(0)]))  # a row for each range of a group
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    more = {f"{n}_before": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in sums}
    return each.withColumns(more | {f"{n}_all": F.sum(n).over(group) for n in sums})


def with_running(df: DataFrame, by: list[str], order: list[str], **sums: Column) -> DataFrame:
    """`df` with running sums over `order` within the groups of `by`, each up to its row as <name>, and that of its group as <name>_all."""
    parts = ranges(df, by, order)
    found = offsets(parts, by, **sums)
    on = [*by, "_part"]
    rows = matched(parts, found.drop(*sums), on)
    upto = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.col(f"{n}_before") + F.sum(c).over(upto) for n, c in sums.items()})
    return rows.drop("_part", *[f"{n}_before" for n in sums])


def with_previous(df: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """`df` with the `values` of the row before it in `order` within its group, null for the first."""
    parts = ranges(df, by, order)
    own = F.struct(*[c.alias(n) for n, c in values.items()])
    last = parts.groupBy(*by, "_part").agg(F.max_by(own, F.struct(*order)).alias("_last"))
    group = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part")
    edge = last.select(*by, "_part", F.lag("_last").over(group).alias("_edge"))
    on = [*by, "_part"]
    rows = matched(parts, edge, on)
    rows = rows.withColumn("_before", F.coalesce(F.lag(own).over(Window.partitionBy(*on).orderBy(*order)), "_edge"))
    return rows.withColumns({n: F.col(f"_before.{n}") for n in values}).drop("_before", "_edge", "_part")


def exact_percentiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, <name>): the interpolated values at `shares` (0 to 1) of n - 1 of each group's sorted values; null for groups without any.

    In a group of over 10 * ACCURACY values, a sketch says between which values each wanted rank
    lies; those between are kept, the others only counted by the gap they lie in. Equal
    values are one row with their number before anything is ordered. Ranges of values are counted, and only
    those that hold a wanted rank are looked into. Should a sketch have missed a rank, all values of its group are kept.
    """
    columns = {c: f"_by{i}" for i, c in enumerate(by)}
    keys = list(columns.values())
    rows = df.select(*[F.col(c).alias(k) for c, k in columns.items()], F.col(value).cast("double").alias("_value"))
    around = [min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-SPREAD, SPREAD)]
    groups = rows.groupBy(*keys).agg(F.count("_value").alias("_total"), F.percentile_approx("_value", around, ACCURACY).alias("_bounds"))
    groups = saved(groups.withColumn("_bounds", F.when(F.col("_total") > 10 * ACCURACY, F.col("_bounds"))))
    values, known = rows.where("_value IS NOT NULL"), groups.where("_bounds IS NOT NULL").select(*keys, "_bounds")
    known = F.broadcast(known) if known.count() <= FEW_GROUPS else known
    told = matched(values, known, keys, "left") if keys else values.crossJoin(F.broadcast(groups.select("_bounds")))
    v, ends = F.col("_value"), [(F.get("_bounds", F.lit(2 * i)), F.get("_bounds", F.lit(2 * i + 1))) for i in range(len(shares))]
    kept = F.col("_bounds").isNull() | reduce(lambda x, y: x | y, [(v >= lo) & (v <= hi) for lo, hi in ends])
    below = F.greatest(*[F.when(v > hi, hi) for _, hi in ends], F.lit(None).cast("double"))  # a gap comes after the value it begins with, the first one has none
    found = saved(_at_ranks(told.select(*keys, F.when(kept, v).otherwise(below).alias("_value"), (~kept).alias("_gap")), keys, shares))
    missed = found.where("_missed").select(*keys, "_missed").distinct()
    if not missed.isEmpty():
        missed = missed.select(*keys)
        whole = (matched(values, missed, keys, "left_semi") if keys else values).withColumn("_gap", F.lit(False))
        rest = matched(found, missed, keys, "left_anti") if keys else found.limit(0)
        found = rest.unionByName(_at_ranks(whole, keys, shares))
    pick = [F.max(F.when(F.col("_name") == n, F.col("_found"))).alias(n) for n in shares]
    found = found.groupBy(*keys).agg(*pick) if keys else found.agg(*pick)
    groups = groups.select(*keys, "_total")
    out = matched(groups, found, keys, "left") if keys else groups.crossJoin(F.broadcast(found))
    return out.select(*[F.col(k).alias(c) for c, k in columns.items()], *[F.col(f"`{n}`") for n in shares])


def _at_ranks(rows: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, _name, _found, _missed): the values at `shares` of the `rows` (keys, _value, _gap) of each group, and whether a gap, whose rows come after their _value, holds one."""
    order = ["_value", "_gap"]
    counted = rows.groupBy(*keys, *order).agg(F.count("*").alias("_n"))
    parts = ranges(counted, keys, order)
    found = offsets(parts, keys, _n=F.col("_n")).withColumnsRenamed({"_n": "_size", "_n_before": "_start"})
    at = F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("_n_all") - 1) * float(p)).alias("at")) for n, p in shares.items()])
    wanted = found.select(*keys, "_part", "_start", "_size", F.explode(at).alias("_w"))
    wanted = wanted.select(*keys, "_part", "_start", "_size", F.col("_w.name").alias("_name"), F.col("_w.at").alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    wanted = wanted.where((high >= F.col("_start")) & (low < F.col("_start") + F.col("_size")))
    wanted = saved(wanted.groupBy(*keys, "_part", "_start").agg(F.collect_list(F.struct("_name", "_at")).alias("_asked")))
    on = [*keys, "_part"]
    rows = matched(parts, wanted, on)
    upto = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.col("_start") + F.sum("_n").over(upto)).withColumn("_begin", F.col("_end") - F.col("_n"))
    rows = rows.select(*keys, *order, "_begin", "_end", F.explode("_asked").alias("_a")).select("*", "_a._name", "_a._at")
    holds = lambda rank: (rank >= F.col("_begin")) & (rank < F.col("_end"))
    rows = rows.where(holds(low) | holds(high))
    ends = rows.groupBy(*keys, "_name", "_at").agg(
        F.max(F.when(holds(low), F.col("_value"))).alias("_low"), F.max(F.when(holds(high), F.col("_value"))).alias("_high"), F.max("_gap").alias("_missed")
    )
    part = F.col("_at") - low
    at_rank = F.when(low == high, F.col("_low")).otherwise((1 - part) * F.col("_low") + part * F.col("_high"))
    return ends.select(*keys, "_name", at_rank.alias("_found"), "_missed")


def unfolded(df: DataFrame, name: str, first: Column, last: Column, deal: bool = False) -> DataFrame:
    """`df` with a row for each whole number `name` from `first` to `last`, none if `last` is less.

    Numbers are unfolded in chunks, so that no row holds a long list; `deal` also
    deals chunks out over the tasks, for few rows with many numbers each.
    """
    rows = df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).where("_first <= _last")
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.expr(f"_first div {CHUNK}"), F.expr(f"_last div {CHUNK}"))))
    if deal:
        rows = rows.repartition("_chunk", "_first", "_last")
    inside = F.sequence(F.greatest("_first", F.col("_chunk") * CHUNK), F.least("_last", (F.col("_chunk") + 1) * CHUNK - 1))
    return rows.withColumn(name, F.explode(inside)).drop("_first", "_last", "_chunk")
