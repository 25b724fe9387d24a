"""Rates of cumulative counters, open connections and the job registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import with_previous, with_running


def counter_rate(df: DataFrame, by: list[str], order: str, value: str = "ops", period_s: float = 1.0, min_rate: float = 0.05) -> DataFrame:
    """Millions a second since the reading before; the first reading and rates of `min_rate` or less give nothing."""
    rate = (F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order))) / period_s / 1e6
    return df.withColumn("mops", rate).where(F.col("mops") > min_rate)


def interval_rates(df: DataFrame, io_bytes: int, ops_per_iter: int = 1, nominal: bool = False) -> DataFrame:
    """From (t, rank, n cumulative) summed over ranks: M IOPS, GB/s and the running total in millions; `nominal` divides by 1 s."""
    sums = df.groupBy("t").agg(F.sum("n").alias("n"))
    sums = with_previous(sums, [], ["t"], _n=F.col("n"), _t=F.col("t"))
    dn, dt = F.col("n") - F.coalesce("_n", F.lit(0)), F.lit(1.0) if nominal else F.col("t") - F.col("_t")
    return sums.select("t", (dn * 1e-6 / dt).alias("miops"), (dn * ops_per_iter * io_bytes * 1e-9 / dt).alias("gbps"), (F.col("n") * 1e-6).alias("ops_accum_m"))


def active_connections(events: DataFrame) -> DataFrame:
    """(jobid, t, open, peak) after each second with changes, from (jobid, t, kind connect or disconnect).

    Changes are summed per second first, so the running window sees a row a second.
    """
    step = F.when(F.col("kind") == "connect", 1).otherwise(-1)
    net = events.groupBy("jobid", "t").agg(F.sum(step).alias("net"))
    upto = Window.partitionBy("jobid").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = net.withColumn("open", F.sum("net").over(upto))
    return rows.withColumn("peak", F.max("open").over(Window.partitionBy("jobid"))).select("jobid", "t", "open", "peak")


def job_registry(connections: DataFrame) -> DataFrame:
    """(jobid, uid, nnode, seq): what a job's first connection said, numbered by registration, in ranges of its order."""
    first = connections.groupBy("jobid").agg(F.min(F.struct("t", "conn_id", "uid", "nnode")).alias("f")).select("jobid", "f.*")
    return with_running(first, [], ["t", "conn_id"], seq=F.lit(1)).select("jobid", "uid", "nnode", F.col("seq").cast("long").alias("seq"))
