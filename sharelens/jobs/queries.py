"""The registered queries: each operator over views of the tables, with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import placement as pl
from ..functions import scalars as sc
from ..functions.xxh64 import xxh64_sql
from ..operators import aggregates as ag
from ..operators import catalog as ca
from ..operators import counters as co
from ..operators import fairshare as fs
from ..operators import joins as jo
from ..sources import reports as so
from ..streaming import streams as st
from .views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SERVERS = 7


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"
DAY = "CAST(floor(epoch(day) / 86400) AS BIGINT)"


def day_number(df: DataFrame, ts: str = "day") -> DataFrame:
    return df.withColumn("day", F.floor(sc.epoch_seconds(ts) / 86400))


# Scalars

SIZES = "concat(CAST(l_quantity AS INT), substr('kmgtKMG.z', CAST(l_linenumber + l_orderkey % 3 AS INT), 1), CASE WHEN l_partkey % 5 = 0 THEN 'b' ELSE '' END)"


@query("p1_parse_size", f"""
SELECT s, count(*) AS n, max(CASE WHEN factor IS NOT NULL THEN TRY_CAST(TRY_CAST(m AS DOUBLE) * factor AS BIGINT) END) AS bytes FROM (
SELECT s, regexp_extract(s, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)(.?)', 1) AS m, CASE lower(regexp_extract(s, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)(.?)', 2)) WHEN '' THEN 1.0 WHEN 'k' THEN 1024.0 WHEN 'm' THEN 1048576.0 WHEN 'g' THEN 1073741824.0 WHEN 't' THEN 1099511627776.0 END AS factor
FROM (SELECT {SIZES} AS s FROM lineitem)) GROUP BY s""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.expr(SIZES).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return rows.withColumn("bytes", sc.parse_size(F.col("s")))


@query("p2_parse_report_time", """
SELECT conn_id, CASE WHEN conn_id % 10 = 0 THEN 0 ELSE CAST(epoch(day) AS BIGINT) END AS t FROM connections""")
def _(spark, d):
    text = F.when(F.col("conn_id") % 10 == 0, F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" junk"))).otherwise(F.date_format("day", "yyyy-MM-dd:HH:mm:ss"))
    return view(spark, d, "connections").select("conn_id", sc.parse_report_time(text).alias("t"))


NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in sc.OP_NAMES.items())


@query("p3_op_name", f"""
SELECT op, CASE WHEN op & 255 >= 81 THEN 'invalid_op_code' ELSE CASE op & 255 {NAMES} ELSE 'unknown-op-' || (op & 255) END END AS name, count(*) AS n FROM (SELECT pkey % 512 AS op FROM trace) GROUP BY op""")
def _(spark, d):
    return view(spark, d, "trace").groupBy((F.col("pkey") % 512).alias("op")).agg(F.count("*").alias("n")).withColumn("name", sc.op_name(F.col("op")))


CODES = ", ".join(str(k) for k, v in sc.OP_NAMES.items() if v in sc.DISPATCHED)


@query("p4_valid_requests", f"""
SELECT server, count(*) AS n FROM (SELECT server, CASE WHEN okey % 4 = 0 THEN 0 ELSE {sc.REQUEST_MARK} END + pkey % 100 AS op FROM trace) WHERE op & 4294967040 = {sc.REQUEST_MARK} AND op & 255 IN ({CODES}) GROUP BY server""")
def _(spark, d):
    rows = view(spark, d, "trace").select("server", (F.when(F.col("okey") % 4 == 0, 0).otherwise(sc.REQUEST_MARK) + F.col("pkey") % 100).alias("op"))
    return sc.valid_requests(rows).groupBy("server").agg(F.count("*").alias("n"))


MESSY = "concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/' END, 'a//', CASE WHEN o_orderkey % 5 = 0 THEN '../../..' ELSE './b' END, '/c', o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN '/' ELSE '/x/..' END)"


@query("p5_canonical_path", f"""
SELECT o_orderkey, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT o_orderkey, list_reduce(list_prepend('', list_filter(string_split('/home/' || raw, '/'), lambda x: x NOT IN ('', '.')) ), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) AS p
FROM (SELECT o_orderkey, CASE WHEN {MESSY}[1] = '/' THEN '../' || {MESSY} ELSE {MESSY} END AS raw FROM orders))""")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", sc.canonical_path(F.expr(MESSY), "/home").alias("path"))


@query("p6_split_path", r"""
SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS entry, CAST(length(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS INT) AS parent_len, CAST(length(regexp_extract(path, '([^/]*)$', 1)) AS INT) AS entry_len FROM catalog""")
def _(spark, d):
    return view(spark, d, "catalog").select("path", sc.split_path(F.col("path")).alias("s")).select("path", "s.*")


@query("p7_on_mount", """
SELECT okey % 3 = 0 AS odd, count(*) FILTER (p LIKE '/myfs%') AS loose, count(*) FILTER (p = '/myfs' OR p LIKE '/myfs/%') AS strict FROM (SELECT okey, CASE okey % 3 WHEN 0 THEN '/myfsX/o' ELSE path END AS p FROM trace) GROUP BY 1""")
def _(spark, d):
    rows = view(spark, d, "trace").select((F.col("okey") % 3 == 0).alias("odd"), F.when(F.col("okey") % 3 == 0, "/myfsX/o").otherwise(F.col("path")).alias("p"))
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("odd").agg(count(sc.on_mount(F.col("p"))).alias("loose"), count(sc.on_mount(F.col("p"), strict=True)).alias("strict"))


TAGGED = "concat(path, CASE okey % 4 WHEN 0 THEN concat('_S0', CAST(okey % 10 AS STRING)) WHEN 1 THEN concat('.0000000', CAST(okey % 9 AS STRING)) ELSE '' END)"
MD5 = f"('0x' || substr(md5(p), 1, 15))::BIGINT % {SERVERS}"


@query("p8_place", f"""
SELECT p AS path, CAST(CASE WHEN okey % 4 = 0 AND okey % 10 < {SERVERS} THEN okey % 10 WHEN okey % 4 = 1 AND okey % 9 < {SERVERS} THEN okey % 9 ELSE {MD5} END AS INT) AS server FROM (SELECT DISTINCT okey, {TAGGED} AS p FROM trace)""")
def _(spark, d):
    rows = view(spark, d, "trace").select(F.expr(TAGGED).alias("path")).distinct()
    return rows.withColumn("server", pl.place(F.col("path"), SERVERS, "md5"))


#: Paths of 8 bytes to over 64.
LONG = "concat(path, CASE okey % 3 WHEN 1 THEN concat('/é/a-file-of-a-longer-name-', CAST(okey AS STRING)) WHEN 2 THEN repeat('/d', CAST(okey % 40 AS INT)) ELSE '' END)"


@query("p8_place_xxh64", f"SELECT p AS path, CAST({xxh64_sql('p')} % {SERVERS} AS INT) AS server FROM (SELECT DISTINCT {LONG} AS p FROM trace)")
def _(spark, d):
    rows = view(spark, d, "trace").select(F.expr(LONG).alias("path")).distinct()
    return rows.withColumn("server", pl.place(F.col("path"), SERVERS))


#: One hexadecimal digit after "_S", a ".00" number, both or neither.
CLIENT_TAGGED = "concat(path, CASE okey % 4 WHEN 0 THEN concat('_S', CAST(okey % 10 AS STRING)) WHEN 1 THEN concat('.0000000', CAST(okey % 9 AS STRING)) WHEN 2 THEN concat('.00000_S', CAST(okey % 10 AS STRING)) ELSE '' END)"


@query("p8_place_client", f"""
SELECT p AS path, CAST(CASE WHEN okey % 4 = 1 THEN okey % 9 % {SERVERS} WHEN okey % 4 = 2 THEN 0 WHEN okey % 4 = 0 AND okey % 10 < {SERVERS} THEN okey % 10 ELSE {xxh64_sql('p')} % {SERVERS} END AS INT) AS server
FROM (SELECT DISTINCT okey, {CLIENT_TAGGED} AS p FROM trace)""")
def _(spark, d):
    rows = view(spark, d, "trace").select(F.expr(CLIENT_TAGGED).alias("path")).distinct()
    return rows.withColumn("server", pl.place(F.col("path"), SERVERS, variant="client"))


HOMED = f"SELECT jobid, okey, off, nlen, CAST(okey % {SERVERS} AS INT) AS home FROM trace"
PIECES = f"""SELECT *, greatest(off, shift * 2097152) AS piece_off, least(off + nlen, (shift + 1) * 2097152) - greatest(off, shift * 2097152) AS piece_len, CAST((home + shift) % {SERVERS} AS INT) AS server
FROM (SELECT *, unnest(range(off // 2097152, (off + greatest(nlen, 1) - 1) // 2097152 + 1)) AS shift FROM ({HOMED}))"""


def _homed(spark, d):
    return view(spark, d, "trace").select("jobid", "okey", "off", "nlen", (F.col("okey") % SERVERS).cast("int").alias("home"))


@query("p9_stripe_requests", f"SELECT jobid, okey, off, nlen, home, shift, piece_off, piece_len, server FROM ({PIECES})")
def _(spark, d):
    return pl.stripe_requests(_homed(spark, d), SERVERS)


@query("a17_server_load", f"SELECT server, count(*) AS pieces, CAST(sum(piece_len) AS BIGINT) AS bytes FROM ({PIECES}) GROUP BY server")
def _(spark, d):
    return pl.server_load(_homed(spark, d), SERVERS)


@query("p10_page_spans", """
SELECT page_id, count(*) AS n, CAST(sum(greatest(off, page_id * 1048576) - page_id * 1048576) AS BIGINT) AS starts, CAST(sum(least(off + nlen, (page_id + 1) * 1048576) - greatest(off, page_id * 1048576)) AS BIGINT) AS bytes
FROM (SELECT *, unnest(range(off // 1048576, (off + nlen - 1) // 1048576 + 1)) AS page_id FROM (SELECT off, least(nlen, 60000000 - off) AS nlen FROM trace) WHERE nlen > 0) GROUP BY page_id""")
def _(spark, d):
    rows = pl.page_spans(view(spark, d, "trace").select("off", "nlen", F.lit(60000000).cast("long").alias("size")), clamp_to="size")
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("page_offset").alias("starts"), F.sum("copy_len").alias("bytes"))


@query("p11_transfer_class", "SELECT CASE WHEN nlen <= 335872 THEN 'inline' ELSE 'direct' END AS class, op, count(*) AS n FROM trace GROUP BY ALL")
def _(spark, d):
    return view(spark, d, "trace").groupBy(sc.transfer_class(F.col("nlen")).alias("class"), "op").agg(F.count("*").alias("n"))


@query("p12_short_host", r"SELECT h AS host, count(*) AS n FROM (SELECT split_part(regexp_extract(url, '^https?://([^/?#]*)', 1), '.', 1) AS h FROM pages) GROUP BY h")
def _(spark, d):
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    return spark.read.parquet(f"{d}/pages.parquet").groupBy(sc.short_host(host).alias("host")).agg(F.count("*").alias("n"))


@query("p13_delete_fanout", f"""
SELECT server, count(*) AS n FROM (SELECT CAST((okey % {SERVERS} + unnest(range(1, least((size + 2097151) // 2097152, {SERVERS - 1}) + 1))) % {SERVERS} AS INT) AS server FROM (SELECT okey, max(off + nlen) AS size FROM trace GROUP BY okey) WHERE size > 2097152) GROUP BY server""")
def _(spark, d):
    files = view(spark, d, "trace").groupBy("okey").agg(F.max(F.col("off") + F.col("nlen")).alias("size")).withColumn("home", (F.col("okey") % SERVERS).cast("int"))
    return pl.delete_fanout(files, SERVERS).groupBy("server").agg(F.count("*").alias("n"))


# Joins

#: Requests of whose orders a tenth names a job that nobody registered.
ASKED = "SELECT CASE WHEN okey % 10 = 3 THEN -jobid ELSE jobid END AS jobid, op, nlen FROM {trace}"


@query("j1_enrich_requests", f"SELECT t.op, j.uid AS job_uid, j.nnode, count(*) AS n, CAST(sum(nlen) AS BIGINT) AS bytes FROM ({ASKED.format(trace='trace')}) t JOIN jobs j USING (jobid) GROUP BY ALL")
def _(spark, d):
    ok, _ = jo.enrich_requests(spark.sql(ASKED, trace=view(spark, d, "trace")), view(spark, d, "jobs"))
    return ok.groupBy("op", "job_uid", "nnode").agg(F.count("*").alias("n"), F.sum("nlen").alias("bytes"))


@query("j1_rejects", f"SELECT jobid, count(*) AS n FROM ({ASKED.format(trace='trace')}) WHERE jobid NOT IN (SELECT jobid FROM jobs) GROUP BY jobid")
def _(spark, d):
    _, rejects = jo.enrich_requests(spark.sql(ASKED, trace=view(spark, d, "trace")), view(spark, d, "jobs"))
    return rejects.groupBy("jobid").agg(F.count("*").alias("n"))


@query("j2_user_group", "SELECT e.req_id, e.uid, g.gid FROM ev e LEFT JOIN (SELECT uid, arg_min(gid, conn_id) AS gid FROM connections GROUP BY uid) g ON e.uid = g.uid")
def _(spark, d):
    return jo.add_group(view(spark, d, "ev").select("req_id", "uid"), jo.user_group(view(spark, d, "connections"))).select("req_id", "uid", "gid")


RUNS = "SELECT jobid AS run, CAST(server % 3 AS STRING) AS tag, 1000 + CAST(min(pkey) AS BIGINT) AS end_s, count(*) AS n FROM trace GROUP BY ALL"


@query("j3_align_slices", f"""
WITH runs AS (SELECT *, end_s - n + 1 AS start FROM ({RUNS})), span AS (SELECT run, min(start) AS t0, max(end_s) AS t1 FROM runs GROUP BY run)
SELECT run, CAST(t - t0 AS INT) AS time_in_seconds, tag, CASE WHEN t >= start AND t - start < n THEN CAST(t - start AS DOUBLE) ELSE 0.0 END AS mbps FROM (SELECT *, unnest(range(t0, t1)) AS t FROM runs JOIN span USING (run))""")
def _(spark, d):
    runs = view(spark, d, "trace").groupBy(F.col("jobid").alias("run"), (F.col("server") % 3).cast("string").alias("tag")).agg((F.min("pkey") + 1000).alias("end_s"), F.count("*").alias("n"))
    runs = runs.select("run", "tag", "end_s", F.lit(1).alias("line"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda x: x.cast("double")).alias("slices"))
    return jo.align_slices(runs, ["run"])


@query("j4_apply_scale", "SELECT jobid, CASE WHEN nnode > 4 THEN jobid / 10 ELSE 1.0 END AS scale FROM jobs")
def _(spark, d):
    jobs = view(spark, d, "jobs")
    return fs.apply_scale(jobs, jobs.where("nnode > 4").select("jobid", (F.col("jobid") / 10).alias("scale"))).select("jobid", "scale")


#: Every third order makes or removes its customer's directory, the others a file in it; a seventh of all name a directory that isn't there.
MAKES = "SELECT concat(dir, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('/o', o_orderkey + o_orderkey % 2) END) AS path, CASE WHEN o_orderkey % 3 = 0 THEN '/myfs' ELSE dir END AS parent, CASE WHEN o_orderkey % 3 = 0 THEN 'mkdir' ELSE 'open' END AS kind, o_orderkey FROM (SELECT o_orderkey, concat('/myfs/', CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE 'c' END, o_custkey) AS dir FROM {orders})"
ROOTED = "SELECT path, type, size, parent, entry FROM {catalog} UNION ALL SELECT '/myfs', 4, 0, '', '/myfs'"


def _catalog(spark, d):
    return spark.sql(ROOTED, catalog=view(spark, d, "catalog"))


def _makes(spark, d):
    return spark.sql(MAKES, orders=spark.read.parquet(f"{d}/orders.parquet"))


ROOTED_SQL, MAKES_SQL = ROOTED.format(catalog="catalog"), MAKES.format(orders="orders")


@query("j5_check_creates", f"""
SELECT m.o_orderkey, m.path, CASE WHEN c.path IS NOT NULL THEN CASE WHEN m.kind = 'mkdir' THEN 'EEXIST' ELSE 'OPENED' END WHEN p.path IS NULL THEN 'ENOENT' ELSE 'OK' END AS status
FROM ({MAKES_SQL}) m LEFT JOIN (SELECT DISTINCT path FROM ({ROOTED_SQL})) c ON m.path = c.path LEFT JOIN (SELECT DISTINCT path FROM ({ROOTED_SQL}) WHERE type = 4) p ON m.parent = p.path""")
def _(spark, d):
    return jo.check_creates(_makes(spark, d), _catalog(spark, d)).select("o_orderkey", "path", "status")


@query("j6_stat_paths", f"SELECT m.o_orderkey, m.path, c.type, c.size, CASE WHEN c.path IS NULL THEN 'ENOENT' ELSE 'OK' END AS status FROM ({MAKES_SQL}) m LEFT JOIN ({ROOTED_SQL}) c ON m.path = c.path")
def _(spark, d):
    return jo.stat_paths(_makes(spark, d).select("o_orderkey", "path"), _catalog(spark, d)).select("o_orderkey", "path", "type", "size", "status")


EXTENTS = "SELECT path, unnest(range(0, max(off + nlen) // 2097152)) * 2097152 AS file_offset, CAST(2097152 AS BIGINT) AS block_size FROM trace GROUP BY path"


def _runs(spark, d):
    """The blocks of each file as one run."""
    runs = view(spark, d, "trace").groupBy("path").agg(F.max(F.expr("(off + nlen) div 2097152")).alias("blocks")).where("blocks > 0")
    return runs.select("path", F.lit(0).cast("long").alias("file_offset"), F.lit(2097152).cast("long").alias("block_size"), "blocks")


@query("j7_locate_blocks", f"""
SELECT t.path, t.off, t.nlen, e.file_offset, e.block_size FROM trace t LEFT JOIN ({EXTENTS}) e ON t.path = e.path AND e.file_offset = t.off // 2097152 * 2097152""")
def _(spark, d):
    return jo.locate_blocks(view(spark, d, "trace").select("path", "off", "nlen"), _runs(spark, d))


@query("j8_verify_readback", """
SELECT path, off // 1048576 AS unit, min(CASE WHEN pkey % 11 = 0 THEN off END) AS first_bad, min(CASE WHEN pkey % 11 = 0 THEN off END) IS NULL AS passed FROM trace GROUP BY ALL""")
def _(spark, d):
    words = view(spark, d, "trace").select("path", "off", F.when(F.col("pkey") % 11 == 0, -1).otherwise(F.col("off")).alias("value"))
    return jo.verify_readback(words, 1048576)


@query("j9_check_removes", f"""
SELECT m.o_orderkey, m.path, CASE WHEN m.kind = 'mkdir' AND (c.type IS NULL OR c.type <> 4) OR m.kind = 'open' AND (c.type IS NULL OR c.type <> 8) THEN 'ENOENT' WHEN m.kind = 'mkdir' AND m.path IN (SELECT parent FROM ({ROOTED_SQL})) THEN 'ENOTEMPTY' ELSE 'OK' END AS status
FROM ({MAKES_SQL}) m LEFT JOIN ({ROOTED_SQL}) c ON m.path = c.path""")
def _(spark, d):
    removes = _makes(spark, d).select("o_orderkey", "path", F.when(F.col("kind") == "mkdir", "rmdir").otherwise("unlink").alias("kind"))
    return jo.check_removes(removes, _catalog(spark, d)).select("o_orderkey", "path", "status")


# Aggregates


@query("a1_throughput_slices", """
WITH e AS (SELECT uid, CAST(floor(epoch(ts)) AS BIGINT) AS t, nlen FROM ev), b AS (SELECT uid, min(t) AS t0, max(t) AS t1 FROM e GROUP BY uid),
s AS (SELECT uid, (t - t0) // 21600 AS slice, sum(nlen) AS bytes FROM e JOIN b USING (uid) GROUP BY ALL), c AS (SELECT uid, unnest(range(0, (t1 - t0) // 21600 + 1)) AS slice FROM b)
SELECT uid, slice, round(coalesce(bytes, 0) / 1048576.0 / 21600 * 1000000, 6) AS mbps FROM c LEFT JOIN s USING (uid, slice)""")
def _(spark, d):
    rows = ag.throughput_slices(view(spark, d, "ev").select("uid", sc.epoch_seconds("ts").alias("t"), "nlen"), "uid", 21600)
    return rows.select("uid", "slice", F.round(F.col("mbps") * 1000000, 6).alias("mbps"))


@query("a2_run_summary", """
SELECT jobid, round(sum(bytes) / (1048576.0 * 60), 6) AS mbps, round(coalesce(stddev_samp(bytes / (1048576.0 * 60)), 'nan'::DOUBLE), 6) AS rank_stddev FROM (SELECT jobid, server, CAST(sum(nlen) AS DOUBLE) AS bytes FROM trace GROUP BY ALL) GROUP BY jobid""")
def _(spark, d):
    return rounded(ag.run_summary(view(spark, d, "trace").select("jobid", F.col("server").alias("rank"), F.col("nlen").alias("bytes")), 60), "mbps", "rank_stddev")


@query("a3_ops_done", "SELECT server, jobid, op, count(*) AS ops FROM trace GROUP BY ALL")
def _(spark, d):
    return ag.ops_done(view(spark, d, "trace"), ["server", "jobid", "op"])


COUNTS = "SELECT server, t.jobid, nnode + server % 2 AS nnode, count(*) AS ops FROM trace t JOIN jobs USING (jobid) GROUP BY ALL"


def _server_counts(spark, d):
    ok, _ = jo.enrich_requests(view(spark, d, "trace"), view(spark, d, "jobs"))
    return ok.groupBy("server", "jobid", (F.col("nnode") + F.col("server") % 2).alias("nnode")).agg(F.count("*").alias("ops"))


@query("a4_merge_server_counts", f"""
WITH m AS (SELECT jobid, CAST(sum(ops) AS BIGINT) AS ops, arg_min(nnode, server) AS nnode FROM ({COUNTS}) GROUP BY jobid)
SELECT jobid, ops, nnode, CAST((SELECT sum(ops) FROM m) AS BIGINT) AS total_ops, CAST((SELECT sum(nnode) FROM m) AS BIGINT) AS total_nodes FROM m""")
def _(spark, d):
    return ag.merge_server_counts(_server_counts(spark, d))


def _decisions(spark, d):
    """Decisions and their candidate sets: all users of an hour; chosen: the request's user. Requests of one hour and user are one row of `n` decisions that names the set."""
    rows = view(spark, d, "ev").groupBy(F.floor(sc.epoch_seconds("ts") / 3600).alias("hour"), "uid").agg(F.count("*").alias("n"), F.min("ts").alias("ts"))
    hours = rows.groupBy("hour").agg(F.array_sort(F.collect_set("uid")).alias("candidates")).withColumn("set_id", ag.set_name("candidates"))
    sets = hours.groupBy("set_id").agg(F.first("candidates").alias("candidates"))
    return rows.join(hours.select("hour", "set_id"), "hour").select("ts", "hour", "set_id", F.col("uid").alias("chosen"), "n"), sets


DECISIONS = f"SELECT e.req_id, e.ts, e.hour, s.members, e.uid AS chosen FROM (SELECT *, {HOUR} AS hour FROM ev) e JOIN (SELECT {HOUR} AS hour, list_sort(list_distinct(list(uid))) AS members FROM ev GROUP BY 1) s ON e.hour = s.hour"
SETS = f"SELECT members, id, CAST(sum(CASE WHEN id = chosen THEN n ELSE 0 END) AS BIGINT) AS n FROM (SELECT members, chosen, n, unnest(members) AS id FROM (SELECT members, chosen, count(*) AS n FROM ({DECISIONS}) GROUP BY ALL)) GROUP BY ALL"


@query("a5_decision_counts", f"SELECT array_to_string(members, ',') AS ids, CAST(len(members) AS INT) AS size, id, n FROM ({SETS})")
def _(spark, d):
    return ag.decision_counts(*_decisions(spark, d)).drop("members")


@query("a6_merge_decisions", f"SELECT array_to_string(members, ',') AS ids, id, n * 2 AS n FROM ({SETS})")
def _(spark, d):
    decisions, sets = _decisions(spark, d)
    counts = ag.counted_sets(decisions, sets=sets)
    return ag.merge_decisions(counts, counts).select("ids", "id", "n")


@query("a7_format_decisions", f"""
SELECT day, string_agg(text, ';' ORDER BY size, members) AS log FROM (SELECT day, members, len(members) AS size, array_to_string(members, ',') || ':' || string_agg(n, ',' ORDER BY id) AS text
FROM (SELECT day, members, id, CAST(sum(CASE WHEN id = chosen THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT hour // 24 AS day, members, chosen, unnest(members) AS id FROM ({DECISIONS})) GROUP BY ALL) GROUP BY day, members) GROUP BY day""")
def _(spark, d):
    decisions, sets = _decisions(spark, d)
    return ag.format_decisions(ag.counted_sets(decisions.withColumn("day", F.floor(F.col("hour") / 24)), ["day"], sets), ["day"])


@query("a8_describe", """
SELECT target, count(*) AS count, round(sum(seconds), 6) AS sum, round(sum(seconds * seconds), 6) AS sum2, min(seconds) AS min, max(seconds) AS max, round(avg(seconds), 6) AS mean, round(coalesce(stddev_samp(seconds), 0), 6) AS stddev FROM io_ops GROUP BY target""")
def _(spark, d):
    return rounded(ag.describe(view(spark, d, "io_ops"), "seconds", ["target"]), "sum", "sum2", "mean", "stddev")


@query("a9_merge_stats", """
SELECT target, count(*) AS count, round(sum(seconds), 6) AS sum, round(sum(seconds * seconds), 6) AS sum2, min(seconds) AS min, max(seconds) AS max, round(avg(seconds), 6) AS mean, round(coalesce(stddev_samp(seconds), 0), 6) AS stddev FROM io_ops GROUP BY target""")
def _(spark, d):
    partials = ag.describe(day_number(view(spark, d, "io_ops"), "sample"), "seconds", ["target", "day", "kind"])
    return rounded(ag.merge_stats(partials, ["target"]), "sum", "sum2", "mean", "stddev")


@query("a10_percentiles", "SELECT target, kind, round(quantile_cont(seconds, 0.5), 6) AS median, round(quantile_cont(seconds, 0.05), 6) AS p5, round(quantile_cont(seconds, 0.999), 6) AS \"p99.9\" FROM io_ops GROUP BY ALL")
def _(spark, d):
    rows = ag.percentiles(view(spark, d, "io_ops"), "seconds", ["target", "kind"], [5, 99.9])
    return rows.select("target", "kind", F.round("median", 6).alias("median"), F.round("p5", 6).alias("p5"), F.round(F.col("`p99.9`"), 6).alias("p99.9"))


TARGETS = """SELECT CAST(floor(epoch(sample) / 86400) AS BIGINT) AS sample, target, """ + ", ".join(
    f"4194304 / (1048576 * sum(seconds) FILTER (kind = '{k}')) AS {k}_mbps, min(seconds) FILTER (kind = '{k}') * 1000 AS min_{k}_ms, avg(seconds) FILTER (kind = '{k}') * 1000 AS avg_{k}_ms, max(seconds) FILTER (kind = '{k}') * 1000 AS max_{k}_ms" for k in ("read", "write")
) + " FROM io_ops GROUP BY ALL"


def _targets(spark, d):
    return ag.target_io_report(day_number(view(spark, d, "io_ops"), "sample").withColumn("sample", F.col("day")), 4194304)


@query("a11_target_io_report", f"SELECT sample, target, {', '.join(f'round({c}, 9) AS {c}' for c in so.TARGET_IO)} FROM ({TARGETS})")
def _(spark, d):
    return _targets(spark, d).withColumns({c: F.round(c, 9) for c in so.TARGET_IO})


SAMPLES = "SELECT CAST(floor(epoch(sample) / 86400) AS BIGINT) AS sample, coalesce(sum(seconds) FILTER (kind IN ('read', 'write')), 0) AS data_sec, coalesce(sum(seconds) FILTER (kind = 'stat'), 0) AS metadata_read_sec, 0.0::DOUBLE AS metadata_write_sec FROM io_ops GROUP BY ALL"


def _samples(spark, d):
    return ag.sample_report(day_number(view(spark, d, "io_ops"), "sample").withColumn("sample", F.col("day")))


@query("a12_sample_report", f"SELECT sample, round(data_sec, 6) AS data_sec, round(metadata_read_sec, 6) AS metadata_read_sec, metadata_write_sec FROM ({SAMPLES})")
def _(spark, d):
    return rounded(_samples(spark, d), "data_sec", "metadata_read_sec")


@query("a13_dir_counts", "SELECT parent, count(*) AS entries, count(*) FILTER (type = 8) AS files, count(*) FILTER (type = 4) AS dirs, CAST(sum(length(entry) + 2) AS BIGINT) AS name_bytes FROM catalog GROUP BY parent")
def _(spark, d):
    return ag.dir_counts(view(spark, d, "catalog"))


@query("a14_file_state", """
WITH c AS (SELECT path, max(off + nlen) AS r, max(server) AS m, CAST(max(epoch(day)) AS BIGINT) AS a FROM trace GROUP BY path), k AS (SELECT DISTINCT path, CAST(okey % 50 * 1000000 AS BIGINT) AS size FROM trace)
SELECT path, greatest(size, r) AS size, greatest(3, m) AS mtime, a AS atime, CASE WHEN r > size THEN r // 512 ELSE 0 END AS blocks FROM k JOIN c USING (path)""")
def _(spark, d):
    t = view(spark, d, "trace")
    closes = t.select("path", sc.epoch_seconds("day").alias("ts"), (F.col("off") + F.col("nlen")).alias("max_range"), F.col("server").alias("mtime"))
    files = t.select("path", (F.col("okey") % 50 * 1000000).alias("size"), F.lit(3).alias("mtime"), F.lit(0).cast("long").alias("atime"), F.lit(0).cast("long").alias("blocks")).distinct()
    return ag.file_state(closes, files)


@query("a15_space_report", f"SELECT CAST(16777216 AS BIGINT) AS inodes, 16777216 - (SELECT count(*) FROM catalog) AS free_inodes, CAST(33554432 AS BIGINT) AS pages, 33554432 - (SELECT count(*) * 512 FROM ({EXTENTS})) AS free_pages, 164 AS name_length")
def _(spark, d):
    return ag.space_report(view(spark, d, "catalog"), _runs(spark, d))


@query("a16_file_count", "SELECT count(*) AS files FROM catalog WHERE path LIKE '/myfs/%' AND type = 8")
def _(spark, d):
    return ag.file_count(view(spark, d, "catalog"), "/myfs")


# Shares

ACTIVE = f"SELECT {HOUR} AS hour, e.uid AS key, j.nnode AS weight, count(*) AS n FROM ev e JOIN ev_jobs j ON e.jobid = j.jobid GROUP BY ALL"


def _active(spark, d):
    ok, _ = jo.enrich_requests(view(spark, d, "ev").drop("uid"), view(spark, d, "ev_jobs"))
    rows = fs.policy_key_weight(ok.withColumn("uid", F.col("job_uid")), "size-fair")
    return rows.withColumn("hour", F.floor(sc.epoch_seconds("ts") / 3600)).groupBy("hour", "key", "weight").agg(F.count("*").alias("n"))


@query("f1_policy_key_weight", " UNION ALL ".join(f"SELECT '{p}' AS policy, {k} AS key, {w} AS weight, count(*) AS jobs FROM jobs GROUP BY ALL" for p, k, w in (("fifo", "NULL::BIGINT", "NULL::INT"), ("user-fair", "uid::BIGINT", "1"), ("job-fair", "jobid", "1"), ("size-fair", "jobid", "nnode"))))
def _(spark, d):
    found = [fs.policy_key_weight(view(spark, d, "jobs"), p).groupBy("key", "weight").agg(F.count("*").alias("jobs")).withColumn("policy", F.lit(p)) for p in fs.POLICIES]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("f2_promised_share", f"SELECT hour, key, weight, round(weight / sum(weight) OVER (PARTITION BY hour), 6) AS promised FROM ({ACTIVE})")
def _(spark, d):
    return rounded(fs.promised_share(_active(spark, d), ["hour"]), "promised").drop("n")


@query("f3_cumulative_probability", "SELECT jobid, round(sum(nnode) OVER (ORDER BY seq) / sum(nnode) OVER (), 6) AS upto FROM jobs")
def _(spark, d):
    return rounded(fs.cumulative_probability(view(spark, d, "jobs")), "upto").select("jobid", "upto")


#: Every third job counts a twentieth of its operations, so that some have few.
OPS = "CAST(CASE WHEN jobid % 3 = 0 THEN floor(n / 20) ELSE n END AS BIGINT)"
SCALED = f"SELECT jobid, CASE WHEN ops + 1 < 20 THEN 0.0002 ELSE least(nnode * sum(ops) OVER () / ((ops + 1) * sum(nnode) OVER ()), {SERVERS}.0) END AS scale FROM (SELECT jobid, nnode, {OPS} AS ops FROM (SELECT jobid, nnode, count(*) AS n FROM trace JOIN jobs USING (jobid) GROUP BY ALL))"


def _scaled(spark, d):
    ok, _ = jo.enrich_requests(view(spark, d, "trace"), view(spark, d, "jobs"))
    return fs.global_scale(ok.groupBy("jobid", "nnode").agg(F.count("*").alias("n")).select("jobid", "nnode", F.expr(OPS).alias("ops")), SERVERS)


@query("f4_global_scale", f"SELECT jobid, round(scale, 6) AS scale FROM ({SCALED})")
def _(spark, d):
    return rounded(_scaled(spark, d), "scale").select("jobid", "scale")


@query("f5_rescaled_probability", f"SELECT jobid, round(sum(nnode * coalesce(scale, 1.0)) OVER (ORDER BY seq) / sum(nnode * coalesce(scale, 1.0)) OVER (), 6) AS upto FROM jobs LEFT JOIN ({SCALED}) USING (jobid)")
def _(spark, d):
    return rounded(fs.rescaled_probability(view(spark, d, "jobs"), _scaled(spark, d)), "upto").select("jobid", "upto")


@query("f6_weighted_pick", f"""
WITH a AS ({ACTIVE}), w AS (SELECT hour, key, sum(weight) OVER (PARTITION BY hour ORDER BY key) AS upto, sum(weight) OVER (PARTITION BY hour) AS whole FROM a)
SELECT hour, coalesce(min(CASE WHEN upto > whole * (hour % 97) / 97.0 THEN key END), max(key)) AS picked FROM w GROUP BY hour""")
def _(spark, d):
    a = _active(spark, d)
    draws = a.groupBy("hour").agg((F.sum("weight") * (F.col("hour") % 97) / 97.0).alias("r"))
    return fs.weighted_pick(a.select("hour", "key", F.col("key").alias("seq"), "weight"), draws, "hour").drop("r")


@query("f6_weighted_picks", f"""
WITH a AS ({ACTIVE}), w AS (SELECT hour, key, sum(weight) OVER (PARTITION BY hour ORDER BY key) AS upto, sum(weight) OVER (PARTITION BY hour) AS whole FROM a),
d AS (SELECT DISTINCT hour, k, whole * k / 8.0 AS r FROM w, (SELECT unnest(range(9)) AS k))
SELECT hour, k, coalesce(min(CASE WHEN upto > r THEN key END), max(key)) AS picked FROM w JOIN d USING (hour) GROUP BY hour, k""")
def _(spark, d):
    """Nine draws for each set, those at a candidate's edge and at the end among them."""
    a = _active(spark, d)
    draws = a.groupBy("hour").agg(F.sum("weight").alias("whole")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("r", F.col("whole") * F.col("k") / 8.0)
    return fs.weighted_pick(a.select("hour", "key", F.col("key").alias("seq"), "weight"), draws, "hour").select("hour", F.col("k").cast("long").alias("k"), "picked")


QUOTAS = {"size-fair": "30.0 * nnode / sum(nnode) OVER ()", "job-fair": "30.0 / count(*) OVER ()", "user-fair": "30.0 / count(*) OVER ()", "user-size-fair": "30.0 * nnode / sum(nu) OVER ()", "user-job-fair": "30.0 / sum(ju) OVER ()"}


@query("f7_time_quota", " UNION ALL ".join(f"SELECT '{p}' AS policy, jobid, round({q}, 6) AS quota_us FROM (SELECT *, nnode / sum(nnode) OVER (PARTITION BY uid) AS nu, 1 / count(*) OVER (PARTITION BY uid) AS ju FROM jobs)" for p, q in QUOTAS.items()))
def _(spark, d):
    found = None
    for p in fs.QUOTA_POLICIES:
        rows = rounded(fs.time_quota(view(spark, d, "jobs"), p), "quota_us").select(F.lit(p).alias("policy"), "jobid", "quota_us")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("f8_share_report", f"""
SELECT hour, key, weight, n, round(weight / sw, 6) AS promised, round(n / sn, 6) AS observed, round(n / sn - weight / sw, 6) AS gap, round((n / sn) / (weight / sw), 6) AS ratio
FROM (SELECT *, sum(weight) OVER (PARTITION BY hour) AS sw, sum(n) OVER (PARTITION BY hour) AS sn FROM ({ACTIVE}))""")
def _(spark, d):
    return rounded(fs.share_report(_active(spark, d), ["hour"]), "promised", "observed", "gap", "ratio")


@query("f9_oldest_requests", "SELECT uid, CAST(floor(epoch(min(ts))) AS BIGINT) AS t, arg_min(req_id, (ts, req_id)) AS req_id FROM ev GROUP BY uid")
def _(spark, d):
    rows = fs.oldest_requests(view(spark, d, "ev").withColumnRenamed("ts", "t_queued"), "uid")
    return rows.select("uid", sc.epoch_seconds("t_queued").alias("t"), "req_id")


@query("f9_dispatch_choice", "SELECT c_custkey AS pick_id, c_custkey * 3 AS uid, coalesce(o.req_id, (SELECT arg_min(req_id, (ts, req_id)) FROM ev)) AS req_id FROM customer LEFT JOIN (SELECT uid, arg_min(req_id, (ts, req_id)) AS req_id FROM ev GROUP BY uid) o ON o.uid = c_custkey * 3")
def _(spark, d):
    picks = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("pick_id"), (F.col("c_custkey") * 3).alias("uid"))
    return fs.dispatch_choice(view(spark, d, "ev").withColumnRenamed("ts", "t_queued"), picks, "uid")


PHASES = f"SELECT uid % 3 AS tag, {HOUR} AS t, CAST(sum(nlen) AS DOUBLE) AS mbps FROM ev GROUP BY ALL"


@query("f10_phase_medians", f"""
WITH s AS ({PHASES}), a AS (SELECT t, string_agg(tag, ',' ORDER BY tag) AS active FROM s GROUP BY t), p AS (SELECT *, sum(CASE WHEN active = prev THEN 0 ELSE 1 END) OVER (ORDER BY t) AS phase FROM (SELECT *, lag(active) OVER (ORDER BY t) AS prev FROM a)),
r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY t) AS k, count(*) OVER (PARTITION BY phase) AS size FROM p)
SELECT active, tag, round(quantile_cont(mbps, 0.5), 6) AS median, count(*) AS seconds FROM r JOIN s USING (t) WHERE k > 1 AND k <= size - 1 GROUP BY ALL""")
def _(spark, d):
    rows = view(spark, d, "ev").groupBy((F.col("uid") % 3).alias("tag"), F.floor(sc.epoch_seconds("ts") / 3600).alias("t")).agg(F.sum("nlen").cast("double").alias("mbps"))
    return rounded(fs.phase_medians(rows, (1, 1)), "median")


@query("f11_scaling_efficiency", """
WITH s AS (SELECT CAST(server AS INT) AS nodes, CASE WHEN jobid % 2 = 0 THEN 'FIFO' ELSE 'Job-fair' END AS policy, CASE WHEN op = 18 THEN 'read' ELSE 'write' END AS direction, CAST(sum(nlen) AS DOUBLE) AS mbps FROM trace GROUP BY ALL)
SELECT *, round(mbps / (nodes * (SELECT mbps FROM s WHERE nodes = 1 AND policy = 'FIFO' AND direction = 'read')), 6) AS efficiency FROM s""")
def _(spark, d):
    rows = view(spark, d, "trace").groupBy(F.col("server").cast("int").alias("nodes"), F.when(F.col("jobid") % 2 == 0, "FIFO").otherwise("Job-fair").alias("policy"), F.when(F.col("op") == 18, "read").otherwise("write").alias("direction"))
    return rounded(fs.scaling_efficiency(rows.agg(F.sum("nlen").cast("double").alias("mbps"))), "efficiency")


@query("f12_slow_samples", f"SELECT sample, round(data_sec, 6) AS data_sec, round(metadata_read_sec, 6) AS metadata_read_sec FROM ({SAMPLES}) WHERE data_sec > (SELECT avg(data_sec) + stddev_samp(data_sec) FROM ({SAMPLES}))")
def _(spark, d):
    return rounded(fs.slow_samples(_samples(spark, d), "data_sec"), "data_sec", "metadata_read_sec").drop("metadata_write_sec")


@query("f13_slow_targets", f"SELECT sample, string_agg(target, ',' ORDER BY target) AS targets, round(max(max_write_ms), 6) AS slowest_ms FROM ({TARGETS}) WHERE max_write_ms > 60 GROUP BY sample")
def _(spark, d):
    return rounded(fs.slow_targets(_targets(spark, d), 60), "slowest_ms")


@query("f13_slow_writes", f"SELECT sample, target, round(max_write_ms, 6) AS max_write_ms FROM ({TARGETS}) WHERE max_write_ms > 60")
def _(spark, d):
    return rounded(fs.slow_writes(_targets(spark, d), 60), "max_write_ms")


# Counters


@query("w1_counter_rate", f"""
SELECT uid, hour, ops, round(mops, 6) AS mops FROM (SELECT *, (ops - lag(ops) OVER (PARTITION BY uid ORDER BY hour)) / 1e6 AS mops FROM (SELECT uid, hour, CAST(sum(n) OVER (PARTITION BY uid ORDER BY hour) AS BIGINT) AS ops FROM (SELECT uid, {HOUR} AS hour, sum(nlen) AS n FROM ev GROUP BY ALL))) WHERE mops > 0.05""")
def _(spark, d):
    from pyspark.sql import Window

    sums = view(spark, d, "ev").groupBy("uid", F.floor(sc.epoch_seconds("ts") / 3600).alias("hour")).agg(F.sum("nlen").alias("n"))
    rows = sums.select("uid", "hour", F.sum("n").over(Window.partitionBy("uid").orderBy("hour")).alias("ops"))
    return rounded(co.counter_rate(rows, ["uid"], "hour"), "mops")


@query("w2_interval_rates", f"""
WITH s AS (SELECT {HOUR} AS t, count(*) AS c FROM ev GROUP BY 1), u AS (SELECT t, sum(c) OVER (ORDER BY t) AS n FROM s)
SELECT t, round((n - coalesce(lag(n) OVER (ORDER BY t), 0)) * 1e-6 / (t - lag(t) OVER (ORDER BY t)), 9) AS miops, round((n - coalesce(lag(n) OVER (ORDER BY t), 0)) * 4096 * 1e-9 / (t - lag(t) OVER (ORDER BY t)), 9) AS gbps, round(n * 1e-6, 9) AS ops_accum_m FROM u""")
def _(spark, d):
    from pyspark.sql import Window

    sums = view(spark, d, "ev").groupBy(F.floor(sc.epoch_seconds("ts") / 3600).alias("t")).agg(F.count("*").alias("c"))
    rows = co.interval_rates(sums.select("t", F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("t")).alias("n")), 4096)
    return rows.withColumns({c: F.round(c, 9) for c in ("miops", "gbps", "ops_accum_m")})


CHANGES = f"SELECT jobid, {DAY} AS t, 1 AS step FROM connections UNION ALL SELECT jobid, {DAY} + 30, -1 FROM connections"


@query("w3_active_connections", f"SELECT jobid, t, CAST(open AS BIGINT) AS open, CAST(max(open) OVER (PARTITION BY jobid) AS BIGINT) AS peak FROM (SELECT jobid, t, sum(net) OVER (PARTITION BY jobid ORDER BY t) AS open FROM (SELECT jobid, t, sum(step) AS net FROM ({CHANGES}) GROUP BY ALL))")
def _(spark, d):
    rows = day_number(view(spark, d, "connections")).select("jobid", F.col("day").alias("t"))
    return co.active_connections(rows.withColumn("kind", F.lit("connect")).unionByName(rows.select("jobid", (F.col("t") + 30).alias("t"), F.lit("disconnect").alias("kind"))))


@query("w4_job_registry", f"SELECT jobid, uid, nnode, row_number() OVER (ORDER BY t, conn_id) AS seq FROM (SELECT *, {DAY} AS t, row_number() OVER (PARTITION BY jobid ORDER BY {DAY}, conn_id) AS k FROM connections) WHERE k = 1")
def _(spark, d):
    return co.job_registry(day_number(view(spark, d, "connections")).withColumn("t", F.col("day")))


# Streams in batch form; tests hold the streaming form against it.

US = "CAST(epoch_us(ts) AS BIGINT)"


def _ev(spark, d):
    return view(spark, d, "ev")


@query("st1_throughput", f"SELECT uid, {US} // 3600000000 * 3600000000 AS window_start, {US} // 3600000000 * 3600000000 + 3600000000 AS window_end, round(sum(nlen) / 1048576.0, 6) AS mb, count(*) AS ops FROM ev GROUP BY ALL")
def _(spark, d):
    return rounded(st.stream_throughput(_ev(spark, d), "uid", "1 hour"), "mb")


@query("st2_active_periods", f"""
WITH e AS (SELECT uid, {US} AS t FROM ev), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY uid ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS b FROM e), s AS (SELECT *, sum(b) OVER (PARTITION BY uid ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT uid, min(t) AS window_start, max(t) + 21600000000 AS window_end, count(*) AS requests FROM s GROUP BY uid, k""")
def _(spark, d):
    return st.active_periods(_ev(spark, d), "uid", "6 hours")


@query("st3_fairness_rounds", f"""
WITH r AS (SELECT {US} // 86400000000 * 86400000000 AS window_start, e.jobid, count(*) AS ops, max(nnode) AS nnode FROM ev e JOIN ev_jobs j ON e.jobid = j.jobid GROUP BY ALL)
SELECT window_start, window_start + 86400000000 AS window_end, jobid, ops, nnode, round(CASE WHEN ops + 1 < 20 THEN 0.0002 ELSE least(nnode * sum(ops) OVER w / ((ops + 1) * sum(nnode) OVER w), {SERVERS}.0) END, 6) AS scale FROM r WINDOW w AS (PARTITION BY window_start)""")
def _(spark, d):
    ok, _ = jo.enrich_requests(_ev(spark, d), view(spark, d, "ev_jobs"))
    return rounded(st.fairness_rounds(ok, SERVERS, "1 day"), "scale")


@query("st3_fairness_rounds_by_server", f"""
WITH s AS (SELECT {US} // 86400000000 * 86400000000 AS window_start, e.jobid, req_id % 3 AS server, count(*) AS ops, max(nnode) AS nnode FROM ev e JOIN ev_jobs j ON e.jobid = j.jobid GROUP BY ALL),
r AS (SELECT window_start, jobid, CAST(sum(ops) AS BIGINT) AS ops, arg_min(nnode, server) AS nnode FROM s GROUP BY ALL)
SELECT window_start, window_start + 86400000000 AS window_end, jobid, ops, nnode, round(CASE WHEN ops + 1 < 20 THEN 0.0002 ELSE least(nnode * sum(ops) OVER w / ((ops + 1) * sum(nnode) OVER w), {SERVERS}.0) END, 6) AS scale FROM r WINDOW w AS (PARTITION BY window_start)""")
def _(spark, d):
    ok, _ = jo.enrich_requests(_ev(spark, d).withColumn("server", F.col("req_id") % 3), view(spark, d, "ev_jobs"))
    return rounded(st.fairness_rounds(ok, SERVERS, "1 day"), "scale")


@query("st4_decision_rounds", f"SELECT {US} // 86400000000 * 86400000000 AS window_start, {US} // 86400000000 * 86400000000 + 86400000000 AS window_end, array_to_string(members, ',') AS ids, id, CAST(sum(CASE WHEN id = chosen THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT *, unnest(members) AS id FROM ({DECISIONS})) GROUP BY ALL")
def _(spark, d):
    decisions, sets = _decisions(spark, d)
    return st.decision_rounds(decisions, "1 day", sets=sets)


@query("st5_lost_connections", f"SELECT uid AS conn_id, max({US}) AS last_us FROM ev WHERE uid % 5 <> 0 GROUP BY uid HAVING (SELECT max({US}) FROM ev) - max({US}) > 43200000000")
def _(spark, d):
    beats = _ev(spark, d).select(F.col("uid").alias("conn_id"), "ts", (F.col("uid") % 5 == 0).alias("inter_server"))
    return st.lost_connections(beats, 43200)


# Catalogs


def _file_events(spark, d):
    """Each order's file is created at its date, closed half a day later, and moved or removed after one day for some orders."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", F.concat(F.lit("/myfs/c"), "o_custkey", F.lit("/o"), "o_orderkey").alias("path"), sc.epoch_seconds("o_orderdate").alias("t"), F.col("o_totalprice").cast("long").alias("size"))
    none = F.lit(None).cast("string").alias("new_path")
    made = o.select((F.col("o_orderkey") * 4).alias("event_id"), "t", F.lit("create").alias("kind"), "path", none, F.lit(None).cast("long").alias("max_range"))
    closed = o.select((F.col("o_orderkey") * 4 + 1).alias("event_id"), (F.col("t") + 43200).alias("t"), F.lit("close").alias("kind"), "path", none, F.col("size").alias("max_range"))
    gone = o.where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 4 + 2).alias("event_id"), (F.col("t") + 86400).alias("t"), F.lit("unlink").alias("kind"), "path", none, F.lit(None).cast("long").alias("max_range"))
    moved = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") * 4 + 3).alias("event_id"), (F.col("t") + 86400).alias("t"), F.lit("rename").alias("kind"), "path", F.concat("path", F.lit("_old")).alias("new_path"), F.lit(None).cast("long").alias("max_range"))
    return made.unionByName(closed).unionByName(gone).unionByName(moved)


@query("c1_catalog_snapshot", """
SELECT concat(parent, '/', entry) AS path, 8 AS type, size, parent, entry FROM (SELECT concat('/myfs/c', o_custkey) AS parent, concat('o', o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '_old' ELSE '' END) AS entry, CAST(trunc(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderstatus <> 'F')""")
def _(spark, d):
    return ca.catalog_snapshot(_file_events(spark, d))


#: What the rules give for this log: only even customers have the directory that their files and its removal name.
REPLAYED = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS held FROM orders)
SELECT -c_custkey - 1 AS event_id, CAST(0 AS BIGINT) AS t, 'mkdir' AS kind, '/myfs/c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END AS path, 'OK' AS status FROM customer
UNION ALL SELECT k * 4, t, 'create', '/myfs/c' || c || '/o' || k, CASE WHEN held THEN 'OK' ELSE 'ENOENT' END FROM o
UNION ALL SELECT k * 4 + 2, t + 86400, 'unlink', '/myfs/c' || c || '/o' || k, CASE WHEN held THEN 'OK' ELSE 'ENOENT' END FROM o WHERE s = 'F'
UNION ALL SELECT c_custkey + 1099511627776, CAST(1099511627776 AS BIGINT), 'rmdir', '/myfs/c' || c_custkey,
    CASE WHEN c_custkey % 2 = 1 THEN 'ENOENT' WHEN c_custkey IN (SELECT c FROM o WHERE s <> 'F') THEN 'ENOTEMPTY' ELSE 'OK' END FROM customer"""


@query("c2_replay_status", REPLAYED)
def _(spark, d):
    """Directories are made, those of odd customers under another name, files of all are created and some removed again, then all directories are removed."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("/myfs/c"), "c_custkey").alias("path"))
    made = F.when(F.col("c_custkey") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit("x")))
    dirs = c.select((-F.col("c_custkey") - 1).alias("event_id"), F.lit(0).cast("long").alias("t"), F.lit("mkdir").alias("kind"), made.alias("path"))
    ends = c.select((F.col("c_custkey") + (1 << 40)).alias("event_id"), F.lit(1 << 40).cast("long").alias("t"), F.lit("rmdir").alias("kind"), "path")
    files = _file_events(spark, d).where("kind IN ('create', 'unlink')").select("event_id", "t", "kind", "path")
    from ..jobs.shared import shared_dir

    shared_dir(spark)
    return ca.replay_status(dirs.unionByName(files).unionByName(ends))


@query("c3_list_directory", f"""
SELECT row_number() OVER (ORDER BY entry) - 1 + 5 AS at, entry, type, total, 'OK' AS status FROM (SELECT entry, type, (SELECT count(*) FROM catalog WHERE parent = '/myfs') AS total FROM catalog WHERE parent = '/myfs' ORDER BY entry OFFSET 5 LIMIT 20)""")
def _(spark, d):
    return ca.list_directory(_catalog(spark, d), "/myfs", 5, 20)


# Sources, over lines that Spark writes from the tables


@query("s1_parse_run_reports", """
SELECT CAST(jobid AS INT) AS jobid, 'job' || (jobid % 3) AS tag, CAST(max(epoch(day)) AS BIGINT) AS end_s, CAST(count(*) AS INT) AS nn, round(sum(nlen) / 1048576.0, 3) AS mbps, list_sort(list(round(nlen / 1048576.0, 1))) AS slices FROM trace GROUP BY jobid""")
def _(spark, d):
    runs = view(spark, d, "trace").groupBy("jobid").agg(F.max("day").alias("day"), F.count("*").alias("n"), F.sum("nlen").alias("b"), F.array_sort(F.collect_list(F.round(F.col("nlen") / 1048576, 1))).alias("s"))
    line = F.format_string("# rw_speed.job%d time=%s nn=%d np=48 user=1 jobid=%d mbps=%.3f mbps_rank_stddev=1.0 mbps_1sec_time_slices=(%s)", F.col("jobid") % 3, F.date_format("day", "yyyy-MM-dd:HH:mm:ss"), "n", "jobid", F.col("b") / 1048576, F.array_join(F.transform("s", lambda x: x.cast("string")), ","))
    return so.parse_run_reports(runs.select(line.alias("value"))).select("jobid", "tag", "end_s", "nn", "mbps", "slices")


@query("s2_parse_run_headers", f"""
SELECT 'job' || (conn_id % 3) AS tag, CAST(epoch(day) AS BIGINT) AS start_s, CAST(48 AS INT) AS np, nnode AS nn, 'h' || uid AS rank0host, '/myfs/c' || jobid AS prefix, CAST(1048576 AS BIGINT) AS iosize, CAST((1 + gid) * 1048576 AS BIGINT) AS filesize, 60.0 + gid AS run_time FROM connections""")
def _(spark, d):
    rows = view(spark, d, "connections")
    line = F.format_string("rw_speed time=%s np=48 nn=%d sim_nn=1 rank0host=h%d -prefix=/myfs/c%d -iosize=1m -filesize=%dm -time=%d.0 -tag=job%d", F.date_format("day", "yyyy-MM-dd:HH:mm:ss"), "nnode", "uid", "jobid", F.col("gid") + 1, F.col("gid") + 60, F.col("conn_id") % 3)
    return so.parse_run_headers(rows.select(line.alias("value"))).drop("sim_nn")


@query("s4_slice_table", """
SELECT CAST(pkey AS INT) AS time_in_seconds, 'job' || k AS tag, round(coalesce(sum(nlen) FILTER (jobid % 3 = k), 0) / 1048576.0, 1) AS mbps FROM trace, (SELECT unnest(range(3)) AS k) GROUP BY pkey, k""")
def _(spark, d):
    tags = [F.round(F.coalesce(F.sum(F.when(F.col("jobid") % 3 == k, F.col("nlen"))), F.lit(0)) / 1048576, 1).alias(f"job{k}.mbps") for k in range(3)]
    return so.long_slices(view(spark, d, "trace").groupBy(F.col("pkey").alias("time_in_seconds")).agg(*tags))


@query("s5_scaling_table", """
SELECT CAST(server AS INT) AS nodes, policy, direction, CAST(coalesce(sum(nlen) FILTER ((jobid % 2 = 0) = (policy = 'FIFO') AND (op = 18) = (direction = 'read')), 0) AS DOUBLE) AS mbps
FROM trace, (SELECT unnest(['FIFO', 'Job-fair']) AS policy), (SELECT unnest(['write', 'read']) AS direction) GROUP BY ALL""")
def _(spark, d):
    series = [(p, r) for p in ("FIFO", "Job-fair") for r in ("write", "read")]
    total = lambda p, r: F.sum(F.when(((F.col("jobid") % 2 == 0) == F.lit(p == "FIFO")) & ((F.col("op") == 18) == F.lit(r == "read")), F.col("nlen")).otherwise(0)).alias(f"{p} {r}")
    return so.long_scaling(view(spark, d, "trace").groupBy(F.col("server").alias("node count")).agg(*[total(p, r) for p, r in series]))


@query("s3_parse_decision_log", f"SELECT CAST(day % 8 AS INT) AS rank, CAST(day AS DOUBLE) AS time_s, array_to_string(members, ',') AS ids, CAST(len(members) AS INT) AS size, id, n FROM (SELECT hour // 24 AS day, members, id, CAST(sum(CASE WHEN id = chosen THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT hour, members, chosen, unnest(members) AS id FROM ({DECISIONS})) GROUP BY ALL)")
def _(spark, d):
    logs = QUERIES["a7_format_decisions"](spark, d)
    return so.parse_decision_log(logs.select(F.format_string("# server reportDecisionLog rank %d time=%d.00 %s", F.col("day") % 8, "day", "log").alias("value"))).drop("members")


@query("s6_parse_variability", f"SELECT sample * 86400 AS t, round(data_sec, 3) AS data_sec, round(metadata_read_sec, 3) AS metadata_read_sec, round(metadata_write_sec, 3) AS metadata_write_sec FROM ({SAMPLES})")
def _(spark, d):
    rows = _samples(spark, d)
    line = F.concat_ws("\t", F.date_format(F.timestamp_add("SECOND", F.col("sample") * 86400, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd:HH:mm:ss"), *[F.round(c, 3).cast("string") for c in so.VARIABILITY])
    return so.parse_table(rows.select(line.alias("value")), so.VARIABILITY).drop("ts")


@query("s7_parse_target_io", f"SELECT sample * 86400 AS t, target, {', '.join(f'round({c}, 9) AS {c}' for c in so.TARGET_IO)} FROM ({TARGETS})")
def _(spark, d):
    day = F.date_format(F.timestamp_add("SECOND", F.col("sample") * 86400, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd:HH:mm:ss")
    line = F.concat_ws("\t", day, *[F.coalesce(F.round(c, 9).cast("string"), F.lit("-")) for c in so.TARGET_IO])
    return so.parse_target_io(_targets(spark, d).select(F.concat(F.lit("/log/ost"), "target").alias("file"), line.alias("value"))).drop("sample")


@query("s8_parse_interval_reports", f"""
SELECT CAST(t AS DOUBLE) AS t, CASE WHEN t % 2 = 0 THEN round(b / 1000, 3) END AS gbps, round(n / 1000.0, 3) AS miops, CASE WHEN t % 2 = 0 THEN 'io' ELSE 'stat' END AS kind FROM (SELECT {HOUR} AS t, count(*) AS n, CAST(sum(nlen) AS DOUBLE) AS b FROM ev GROUP BY 1)""")
def _(spark, d):
    sums = view(spark, d, "ev").groupBy(F.floor(sc.epoch_seconds("ts") / 3600).alias("t")).agg(F.count("*").alias("n"), F.sum("nlen").cast("double").alias("b"))
    speed = F.when(F.col("t") % 2 == 0, F.format_string("Bandwidth =  %s GB/s     ", F.round(F.col("b") / 1000, 3).cast("decimal(28,3)").cast("string"))).otherwise("")
    line = F.concat(F.format_string("T =   %d.0    ", "t"), speed, F.format_string("%.3f M IOPS     T_Reduce =    12 us     nOP_Accu =   0.61", F.col("n") / 1000))
    return so.parse_interval_reports(sums.select(line.alias("value"))).select("t", "gbps", "miops", "kind")


@query("s9_parse_request_trace", "SELECT 'in' AS stage, CAST(server AS INT) AS tid, op AS tag, CASE op WHEN 18 THEN 'read' ELSE 'write' END AS op_name, CAST(jobid AS INT) AS jobidx, CAST(pkey AS DOUBLE) AS t, count(*) AS n FROM trace GROUP BY ALL")
def _(spark, d):
    line = F.format_string("in msg tid=%d tag=%d name=%s jobidx=%d time=%d.000000 content=00ff", "server", "op", sc.op_name(F.col("op")), "jobid", "pkey")
    rows = so.parse_request_trace(view(spark, d, "trace").select(line.alias("value")))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


#: Lines of four kinds from every request, one of seven spoilt in some way.
SPOILT = {
    "run_reports": ("bad slices", "concat('rw_speed.job', jobid, ' time=2021-08-23:16:33:23 nn=1 mbps=1.5 mbps_1sec_time_slices=(1.5,', CASE WHEN okey % 7 = 0 THEN 'x' ELSE '2' END, ')')"),
    "decision_log": ("ids and counts differ", "concat('FairQueue::reportDecisionLog rank 1 time=2.5 ', jobid, ',7:4', CASE WHEN okey % 7 = 1 THEN '' ELSE ',5' END)"),
    "interval_reports": ("no rate", "concat('T = ', okey, '.0 ', CASE WHEN okey % 7 = 2 THEN 'none' ELSE '0.610' END, ' M IOPS')"),
    "request_trace": ("bad form", "concat('in msg tid=1 tag=2 name=read ', CASE WHEN okey % 7 = 3 THEN 'job' ELSE 'jobidx' END, '=3 time=1.5 content=0a')"),
}


@query("s_rejected_lines", " UNION ALL ".join(f"SELECT '{k}' AS reader, '{reason}' AS reason, count(*) AS n FROM trace WHERE okey % 7 = {i}" for i, (k, (reason, _)) in enumerate(SPOILT.items())))
def _(spark, d):
    found = None
    for reader, (_, line) in SPOILT.items():
        rows = so.rejected_lines(view(spark, d, "trace").select(F.expr(line).alias("value")), reader)
        rows = rows.groupBy(F.lit(reader).alias("reader"), "reason").agg(F.count("*").alias("n"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("s10_parse_dir_list", "SELECT path, 4 AS type FROM catalog WHERE type = 4")
def _(spark, d):
    names = view(spark, d, "catalog").where("type = 4").select(F.concat("entry", F.lit("\r")).alias("value"))
    return so.parse_dir_list(names)
