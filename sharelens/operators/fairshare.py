"""Sharing policies: keys and weights, promised and observed shares, quotas, picks, phases, slow samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import exact_percentiles, with_previous, with_running

# Policy names, the quota cycle in microseconds, constants of the rescaling rule.
POLICIES = ["fifo", "user-fair", "job-fair", "size-fair"]
QUOTA_POLICIES = ["size-fair", "job-fair", "user-fair", "user-size-fair", "user-job-fair"]
CYCLE_US, FEW_OPS, FEW_OPS_SCALE = 30, 20, 0.0002
#: Draws of one candidate set that one task answers.
DRAWS = 1 << 16


def policy_key_weight(jobs: DataFrame, policy: str) -> DataFrame:
    """adds `key` and `weight`; null under fifo. A user counts once, whatever the number of its jobs."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}: one of {', '.join(POLICIES)}")
    if policy == "fifo":
        return jobs.withColumns({"key": F.lit(None).cast("long"), "weight": F.lit(None).cast("int")})
    key = F.col("uid" if policy == "user-fair" else "jobid").cast("long")
    return jobs.withColumns({"key": key, "weight": F.col("nnode").cast("int") if policy == "size-fair" else F.lit(1)})


def with_totals(df: DataFrame, sets: list[str], **totals: Column) -> DataFrame:
    """`df` with totals of each of its `sets`, or, without sets, of all rows: these are one row, which is broadcast, so no task holds all rows."""
    if sets:
        return df.withColumns({name: total.over(Window.partitionBy(*sets)) for name, total in totals.items()})
    return df.crossJoin(F.broadcast(df.agg(*[total.alias(name) for name, total in totals.items()])))


def promised_share(active: DataFrame, sets: list[str]) -> DataFrame:
    """adds `promised`, the weight of a key over that of all keys active in its set (`sets`)."""
    return active.withColumn("promised", F.col("weight") / F.sum("weight").over(Window.partitionBy(*sets)))


def cumulative_probability(jobs: DataFrame, weight: Column | None = None, sets: list[str] = ()) -> DataFrame:
    """adds `upto`, the running share of nodes in registration order (`seq`), 1 at the end; a set may be of any size."""
    w = F.col("nnode") if weight is None else weight
    rows = with_running(jobs, list(sets), ["seq"], _upto=w)
    return rows.withColumn("upto", F.col("_upto") / F.col("_upto_all")).drop("_upto", "_upto_all")


def global_scale(job_ops: DataFrame, n_servers: int, sets: list[str] = ()) -> DataFrame:
    """adds `scale` to (jobid, nnode, ops): how far a job lies behind its node share, at most n_servers; very few ops get a fixed small one."""
    rows = with_totals(job_ops, list(sets), _ops=F.sum("ops"), _nodes=F.sum("nnode"))
    ops = F.col("ops") + 1
    scale = F.least(F.col("nnode") * F.col("_ops") / (ops * F.col("_nodes")), F.lit(float(n_servers)))
    return rows.withColumn("scale", F.when(ops < FEW_OPS, FEW_OPS_SCALE).otherwise(scale)).drop("_ops", "_nodes")


def apply_scale(jobs: DataFrame, scale: DataFrame) -> DataFrame:
    """Adds `scale`, 1 for jobs without one."""
    return jobs.join(scale.select("jobid", "scale"), "jobid", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def rescaled_probability(jobs: DataFrame, scale: DataFrame) -> DataFrame:
    """F5"""
    return cumulative_probability(apply_scale(jobs, scale), F.col("nnode") * F.col("scale"))


def weighted_pick(candidates: DataFrame, draws: DataFrame, group: str = "decision_id", order: str = "seq") -> DataFrame:
    """`draws` (group, r and whatever else) with `picked`: the first candidate of the draw's group whose running weight exceeds `r`, else the last.

    A group may have many draws. They are merged with the running weights in
    one order, in which the next weight after a draw is the one that exceeds it. The
    draws of a group with more than DRAWS are dealt over several tasks, each with a
    copy of its candidates. Draws without a group of candidates give nothing.
    """
    by = Window.partitionBy(group)
    upto = by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = candidates.withColumns({"_upto": F.sum("weight").over(upto), "_last": F.max(F.struct(order, "key")).over(by)["key"]})
    copies = draws.groupBy(group).agg(F.ceil(F.count("*") / DRAWS).cast("int").alias("_copies")).where("_copies > 1")
    own = F.struct(*[F.col(f"`{c}`") for c in draws.columns])
    salt = F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_copies")).cast("int"))
    asked = draws.join(copies, group, "left").select(group, salt.alias("_salt"), F.col("r").cast("double").alias("_at"), F.lit(1).alias("_kind"), own.alias("_draw"))
    copy = F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    ends = ends.join(copies, group, "left").select(group, copy.alias("_salt"), F.col("_upto").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.struct("key", "_last", order).alias("_end"))
    both = asked.unionByName(ends, allowMissingColumns=True)
    # From the largest weight down, draws before the ends they equal: the last end before a draw is the least one beyond it.
    down = Window.partitionBy(group, "_salt").orderBy(F.desc("_at"), F.desc("_kind"), F.desc(F.col(f"_end.{order}")))
    over = F.last("_end", True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    final = F.first("_end", True).over(Window.partitionBy(group, "_salt"))
    rows = both.withColumns({"_over": over, "_final": final}).where("_kind = 1 AND _final IS NOT NULL")
    return rows.select("_draw.*", F.coalesce("_over.key", "_final._last").alias("picked"))


def time_quota(jobs: DataFrame, policy: str, cycle_us: float = CYCLE_US, normalized: bool = False) -> DataFrame:
    """adds `quota_us`. Composite policies divide as written, so that quotas needn't sum to the cycle; `normalized` makes them."""
    if policy not in QUOTA_POLICIES:
        raise ValueError(f"no quota for policy {policy!r}")
    w = F.col("nnode") if policy in ("size-fair", "user-size-fair") else F.lit(1)
    if policy in ("job-fair", "user-fair", "size-fair"):
        return with_totals(jobs, [], _all=F.sum(w)).withColumn("quota_us", cycle_us * w / F.col("_all")).drop("_all")
    rows = jobs.withColumn("_part", w / F.sum(w).over(Window.partitionBy("uid")))
    return with_totals(rows, [], _all=F.sum("_part")).withColumn("quota_us", cycle_us * (F.col("_part") if normalized else w) / F.col("_all")).drop("_part", "_all")


def share_report(counts: DataFrame, sets: list[str]) -> DataFrame:
    """F8: (sets, key, weight, n) with the observed share of n, the promised one, their difference and ratio. One row a key: a set is small."""
    by = Window.partitionBy(*sets)
    rows = promised_share(counts, sets).withColumn("observed", F.col("n") / F.sum("n").over(by))
    return rows.withColumns({"gap": F.col("observed") - F.col("promised"), "ratio": F.col("observed") / F.col("promised")})


def oldest_requests(requests: DataFrame, by: str = "jobid") -> DataFrame:
    """The request that waits longest in each group; ties by req_id."""
    return requests.groupBy(by).agg(F.min(F.struct("t_queued", "req_id")).alias("m")).select(by, "m.t_queued", "m.req_id")


def dispatch_choice(requests: DataFrame, picks: DataFrame, by: str = "jobid") -> DataFrame:
    """For each pick (pick_id, jobid) the picked job's oldest request, else the oldest of all."""
    oldest = oldest_requests(requests, by)
    overall = requests.agg(F.min(F.struct("t_queued", "req_id"))["req_id"].alias("overall"))
    return picks.join(oldest.select(by, "req_id"), by, "left").crossJoin(F.broadcast(overall)).select("pick_id", by, F.coalesce("req_id", "overall").alias("req_id"))


def phase_medians(slices: DataFrame, trim: tuple[int, int] = (0, 0), group: list[str] = (), pool: str = "tag") -> DataFrame:
    """seconds (group, t, tag, mbps) classed by the set of active tags: median of each tag in each set.

    `pool` may name another column of the slices, such as the promised share; tags of one value are then pooled.

    `trim` drops seconds at both ends of every run of seconds with one set.
    Seconds are put in order in ranges, so that a group may be of any length; a
    run of seconds with one set is one task's.
    """
    group = list(group)
    sets = slices.where("mbps > 0").groupBy(*group, "t").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("active"))
    sets = with_previous(sets, group, ["t"], _was=F.col("active"))
    starts = F.when(F.col("_was") == F.col("active"), 0).otherwise(1)
    sets = with_running(sets, group, ["t"], phase=starts).drop("_was", "phase_all")
    run = Window.partitionBy(*group, "phase")
    sets = sets.withColumns({"at": F.row_number().over(run.orderBy("t")), "size": F.count("*").over(run)})
    sets = sets.where((F.col("at") > trim[0]) & (F.col("at") <= F.col("size") - trim[1]))
    rows, by = sets.join(slices.where("mbps > 0"), [*group, "t"]), [*group, "active", pool]
    seconds = rows.groupBy(*by).agg(F.count("*").alias("seconds"))
    return exact_percentiles(rows, "mbps", by, {"median": 0.5}).join(seconds, by).select(*by, "median", "seconds")


def scaling_efficiency(scaling: DataFrame) -> DataFrame:
    """throughput over nodes times the one-node FIFO read."""
    one = scaling.where("nodes = 1 AND policy = 'FIFO' AND direction = 'read'").agg(F.max("mbps").alias("one"))
    return scaling.crossJoin(F.broadcast(one)).withColumn("efficiency", F.col("mbps") / (F.col("nodes") * F.col("one"))).drop("one")


def slow_samples(samples: DataFrame, metric: str, k: float = 1.0) -> DataFrame:
    """rows whose metric exceeds the mean by more than k sample standard deviations."""
    limits = samples.agg((F.avg(metric) + k * F.coalesce(F.stddev_samp(metric), F.lit(0.0))).alias("_limit"))
    return samples.crossJoin(F.broadcast(limits)).where(F.col(metric) > F.col("_limit")).drop("_limit")


def slow_targets(target_io: DataFrame, threshold_ms: float = 1000.0) -> DataFrame:
    """(sample, targets): the sorted targets whose slowest write took longer, for each sample that has any."""
    slow = target_io.where(F.col("max_write_ms") > threshold_ms)
    return slow.groupBy("sample").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"), F.max("max_write_ms").alias("slowest_ms"))


def slow_writes(target_io: DataFrame, threshold_ms: float = 1000.0) -> DataFrame:
    """(sample, target, max_write_ms) of the targets whose slowest write took longer, in the order of time."""
    return target_io.where(F.col("max_write_ms") > threshold_ms).select("sample", "target", "max_write_ms").orderBy("sample", "target")
