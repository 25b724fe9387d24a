"""Golden rows, hand-worked cases, and streams against their batch form."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sharelens.functions import placement, scalars
from sharelens.functions.xxh64 import xxh64
from sharelens.operators import aggregates, catalog, counters, fairshare, joins
from sharelens.sources import reports
from sharelens.streaming import streams

DATA = Path(__file__).parent / "data"


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_reports_align_to_the_golden_table(spark, tmp_path):
    runs = reports.read_run_reports(spark, str(DATA / "run_reports.txt"))
    slices = joins.align_slices(runs)
    golden = reports.read_slice_table(spark, str(DATA / "aligned.txt"))
    assert values(slices, "time_in_seconds", "tag", "mbps") == values(golden, "time_in_seconds", "tag", "mbps")
    reports.write_slice_table(slices, str(tmp_path / "wide"))
    again = "".join(p.read_text() for p in (tmp_path / "wide").glob("part-*"))
    assert again.split() == (DATA / "aligned.txt").read_text().split()


@pytest.mark.parametrize(
    "reader, line, reason",
    [
        ("run_reports", "# rw_speed.a time=2021-08-23:16:33:23 mbps_1sec_time_slices=(1,2.5)", None),
        ("run_reports", "rw_speed. time=2021-08-23:16:33:23 mbps_1sec_time_slices=(1)", "no tag"),
        ("run_reports", "rw_speed.a time=yesterday mbps_1sec_time_slices=(1)", "no end time"),
        ("run_reports", "rw_speed.a time=2021-08-23:16:33:23 mbps=1", "no slices"),
        ("run_reports", "rw_speed.a time=2021-08-23:16:33:23 mbps_1sec_time_slices=(1,,2)", "bad slices"),
        ("run_reports", "another program", None),
        ("decision_log", "FairQueue::reportDecisionLog rank 0 time=5.0 1,2:3,4;5:6", None),
        ("decision_log", "FairQueue::reportDecisionLog rank x", "bad head"),
        ("decision_log", "FairQueue::reportDecisionLog rank 0 time=5.0 1,a:3,4", "bad set"),
        ("decision_log", "FairQueue::reportDecisionLog rank 0 time=5.0 1,2:3;5:6", "ids and counts differ"),
        ("interval_reports", "T = 1.0 none", "no rate"),
        ("interval_reports", "INFO> Reporting performance 1.250 M iops", "no time"),
        ("request_trace", "in msg tid=1 tag=2 name=read time=1.5", "bad form"),
        ("request_trace", "in msg tid=1 tag=2 name=read jobidx=3 time=1.5 content=0a", None),
    ],
)
def test_rejected_lines(spark, reader, line, reason):
    """A line that a reader is meant for has rows or a reason."""
    lines = spark.createDataFrame([(line, 1)], "value string, line long")
    got = reports.rejected_lines(lines, reader).collect()
    assert [(r.value, r.reason) for r in got] == ([] if reason is None else [(line, reason)])
    if reader == "decision_log":
        assert reports.parse_decision_log(lines).count() == {None: 3, "ids and counts differ": 1}.get(reason, 0)


def test_scaling(spark):
    rows = fairshare.scaling_efficiency(reports.read_scaling(spark, str(DATA / "scaling.csv")))
    assert rows.where("nodes = 1 AND policy = 'FIFO' AND direction = 'read'").first()["efficiency"] == 1.0
    assert rows.count() == 32


def test_interval_reports(spark):
    lines = spark.createDataFrame([("T =   1.0    Bandwidth =  2.500 GB/s     0.610 M IOPS     T_Reduce =    12 us     nOP_Accu =   0.61",), ("T =   2.0     0.610 M IOPS     T_Reduce =    12 us     nOP_Accu =   1.22",), ("INFO> Reporting performance 1.250 M iops T = 7",), ("other",)], "value string")
    assert values(reports.parse_interval_reports(lines), "t", "gbps", "miops", "kind") == [(1.0, 2.5, 0.61, "io"), (2.0, None, 0.61, "stat"), (7.0, None, 1.25, "server")]


def test_run_headers(spark):
    lines = spark.createDataFrame([("rw_speed time=2021-08-23:16:33:23 np=48 nn=1 sim_nn=1 rank0host=h -prefix=/p -iosize=1m -filesize=100m -time=60.0 -tag=job1",)], "value string")
    r = reports.parse_run_headers(lines).first()
    assert (r.tag, r.np, r.iosize, r.filesize, r.run_time, r.rank0host) == ("job1", 48, 1 << 20, 100 << 20, 60.0, "h")


@pytest.mark.parametrize("text, size", [("4kb", 4096), (".5m", 524288), ("1e3", 1000), (".", None), ("-1", None), ("3q", None), ("", None), ("7", 7)])
def test_parse_size(spark, text, size):
    assert spark.createDataFrame([(text,)], "s string").select(scalars.parse_size(F.col("s"))).first()[0] == size


def test_paths(spark):
    df = spark.createDataFrame([("../../x",), ("/",), ("",), ("/a//b/./c/",), ("/a/..",)], "p string")
    assert [r[0] for r in df.select(scalars.canonical_path(F.col("p"), "/w")).collect()] == ["/x", "/", "/w", "/a/b/c", "/"]


def test_xxh64_vectors(spark):
    """The published hashes of these strings, as unsigned numbers modulo a prime."""
    known = {"": 0xEF46DB3751D8E999, "a": 0xD24EC4F1A98C6E5B, "abc": 0x44BC2CF5AD770999, "/myfs": 0xC266456B7763FD93}
    df = spark.createDataFrame([(k,) for k in known], "p string").select("p", placement.xxh64_mod(F.col("p"), 10007).alias("m"))
    assert {r.p: r.m for r in df.collect()} == {k: v % 10007 for k, v in known.items()}


def test_xxh64_of_all_lengths(spark):
    xxhash = pytest.importorskip("xxhash")
    texts = [None, *(("aé/漢" * 60).encode()[:n].decode(errors="ignore") + "x" * (n % 4) for n in range(140))]
    df = spark.createDataFrame([(t,) for t in texts], "p string").select("p", xxh64(F.col("p")).alias("h"), placement.xxh64_mod(F.col("p"), 2**31 - 1).alias("m"))
    for r in df.collect():
        want = None if r.p is None else xxhash.xxh64_intdigest(r.p.encode())
        assert (r.h is None and r.m is None) if want is None else (r.h % 2**64, r.m) == (want, want % (2**31 - 1)), r.p


@pytest.mark.parametrize("path, server, client", [("/myfs/f_S02", 2, None), ("/myfs/f_S2", None, 2), ("/myfs/f_S9", None, None), ("/myfs/f_S0a", None, None), ("/myfs/f.00000012", None, 5), ("/myfs/f.00000003", 3, 3), ("/f.00000_S4", 0, 0), ("_S1", None, 1)])
def test_tags_of_both_sides(spark, path, server, client):
    """7 servers; None: by hash. A tag is read otherwise by a client than by a server."""
    df = spark.createDataFrame([(path,)], "p string")
    hashed = placement.xxh64_mod(F.col("p"), 7)
    got = df.select(placement.place(F.col("p"), 7), placement.place(F.col("p"), 7, variant="client"), hashed).first()
    assert (got[0], got[1]) == (got[2] if server is None else server, got[2] if client is None else client)


def test_stripes_and_edges(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 2097151, 2), (6, 2097152, 2097152)], "home int, off long, nlen long")
    found = values(placement.stripe_requests(df, 7), "off", "piece_off", "piece_len", "server")
    assert found == [(0, 0, 0, 0), (2097151, 2097151, 1, 0), (2097151, 2097152, 1, 1), (2097152, 2097152, 2097152, 0)]


def test_policies(spark):
    jobs = spark.createDataFrame([(2001, 101, 2), (2002, 101, 2), (1003, 102, 1)], "jobid long, uid long, nnode int")
    users = fairshare.promised_share(fairshare.policy_key_weight(jobs, "user-fair").select("key", "weight").distinct().withColumn("s", F.lit(1)), ["s"])
    assert values(users, "key", "promised") == [(101, 0.5), (102, 0.5)]
    with pytest.raises(ValueError):
        fairshare.policy_key_weight(jobs, "group-fair")
    quota = fairshare.time_quota(jobs, "user-job-fair", normalized=True)
    assert quota.agg(F.sum("quota_us")).first()[0] == pytest.approx(30.0)


def test_one_rank_and_small_samples(spark):
    one = spark.createDataFrame([(1, 0, 1048576)], "jobid int, rank int, bytes long")
    assert str(aggregates.run_summary(one, 1.0).first()["rank_stddev"]) == "nan"
    assert aggregates.describe(one.withColumn("v", F.lit(2.0)), "v", ["jobid"]).first()["stddev"] == 0.0


def test_empty_frames(spark):
    none = spark.createDataFrame([], "decision_id long, candidates array<long>, chosen long")
    assert aggregates.decision_counts(none).count() == 0
    assert counters.active_connections(spark.createDataFrame([], "jobid long, t long, kind string")).count() == 0
    assert catalog.catalog_snapshot(spark.createDataFrame([], "event_id long, t long, kind string, path string, new_path string, max_range long")).count() == 0


def test_sizes_follow_renames(spark):
    def sizes(*log):
        rows = [(i, i, *e, *[None] * (4 - len(e))) for i, e in enumerate(log)]
        events = spark.createDataFrame([(i, t, k, p, to, r) for i, t, k, p, to, r in rows], "event_id long, t long, kind string, path string, new_path string, max_range long")
        return {r.path: r.size for r in catalog.catalog_snapshot(events).collect()}

    assert sizes(("create", "/a"), ("close", "/a", None, 5), ("rename", "/a", "/b"), ("rename", "/b", "/c")) == {"/c": 5}
    assert sizes(("create", "/a"), ("close", "/a", None, 100), ("unlink", "/a"), ("create", "/a"), ("rename", "/a", "/b")) == {"/b": 0}
    chain = [("rename", f"/{i}", f"/{i + 1}") for i in range(6)]
    assert sizes(("create", "/0"), ("close", "/0", None, 5), *chain[:3], ("close", "/3", None, 9), *chain[3:], ("create", "/0"), ("rename", "/0", "/x")) == {"/6": 9, "/x": 0}


def test_replay(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    log = [(1, "mkdir", "/myfs/a"), (2, "mkdir", "/myfs/a"), (3, "create", "/myfs/a/f"), (4, "rmdir", "/myfs/a"), (5, "unlink", "/myfs/a/f"), (6, "unlink", "/myfs/a/f"), (7, "rmdir", "/myfs/a"), (8, "create", "/myfs/a/g"), (9, "create", "/myfs/b/h")]
    df = spark.createDataFrame([(i, i, k, p) for i, k, p in log], "event_id long, t long, kind string, path string")
    found = {r.event_id: r.status for r in catalog.replay_status(df).collect()}
    assert found == {1: "OK", 2: "EEXIST", 3: "OK", 4: "ENOTEMPTY", 5: "OK", 6: "ENOENT", 7: "OK", 8: "ENOENT", 9: "ENOENT"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, 1_700_000_000 + i * 7, 1048576) for i in range(60)]
    df = spark.createDataFrame(rows, "jobid int, t long, nlen long").select("jobid", F.timestamp_seconds("t").alias("ts"), "nlen")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_throughput(stream, "jobid", "30 seconds").writeStream.outputMode("complete").format("memory").queryName("thr").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    cols = ["jobid", "window_start", "mb", "ops"]
    assert values(spark.table("thr"), *cols) == values(streams.stream_throughput(df, "jobid", "30 seconds"), *cols)


def test_partitions_do_not_matter(spark):
    rows = [(i % 50, i % 7, i % 3 + 1, i) for i in range(500)]
    df = spark.createDataFrame(rows, "hour int, key int, weight int, n int").groupBy("hour", "key").agg(F.max("weight").alias("weight"), F.sum("n").alias("n"))
    one, eight = (values(fairshare.share_report(df.repartition(k), ["hour"]), "hour", "key", "observed", "promised") for k in (1, 8))
    assert one == eight


def replayed(log, root="/myfs"):
    """The rules of a replay, event after event."""
    types, found = {root: "mkdir"}, {}
    for i, kind, path in log:
        parent = path.rpartition("/")[0]
        if kind in ("mkdir", "create"):
            if path in types and path != root:
                found[i] = "EEXIST" if kind == "mkdir" else "OPENED"
            elif parent and types.get(parent) != "mkdir":
                found[i] = "ENOENT"
            else:
                types[path], found[i] = kind, "OK"
        elif types.get(path) != ("mkdir" if kind == "rmdir" else "create"):
            found[i] = "ENOENT"
        elif any(p.startswith(path + "/") for p in types):
            found[i] = "ENOTEMPTY"
        else:
            found[i] = "OK"
            del types[path]
    return found


@pytest.mark.parametrize("seed", range(3))
def test_replay_of_random_logs(spark, tmp_path, seed):
    """Files and directories of the same names, kinds that don't fit, some directories that are made once."""
    import random

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    draw, log = random.Random(seed), []
    for i in range(600):
        path = "/myfs" + "".join(f"/{draw.choice('abc')}" for _ in range(draw.randint(1, 4)))
        kind = draw.choice(["mkdir", "mkdir", "create", "unlink", "rmdir"])
        log.append((i, "mkdir", f"/myfs/once{i}") if i % 40 == 0 else (i, kind, path.replace("/myfs", f"/myfs/once{draw.randrange(15) * 40}") if i % 3 == 0 else path))
    df = spark.createDataFrame([(i, i // 2, k, p) for i, k, p in log], "event_id long, t long, kind string, path string")
    assert {r.event_id: r.status for r in catalog.replay_status(df).collect()} == replayed(log)


def test_phase_medians_of_published_runs(spark):
    """Two competing runs, two nodes against one: the published medians, with one second trimmed at each end of a phase."""
    slices = joins.align_slices(reports.read_run_reports(spark, str(DATA / "size_fair_reports.txt"))).withColumnRenamed("time_in_seconds", "t")
    found = {(r.active, r.tag): round(r["median"]) for r in fairshare.phase_medians(slices, (1, 1)).collect()}
    both = sorted(v for (active, _), v in found.items() if "," in active)
    assert both == [7289, 14595]
    pooled = fairshare.phase_medians(slices.withColumn("share", F.lit(0.5)), (1, 1), pool="share").where("active LIKE '%,%'").collect()
    assert len(pooled) == 1 and 7289 < pooled[0]["median"] < 14595


def test_shares_of_published_decisions(spark):
    """Decisions of 5 s under two policies: 1 node against 2, by node and by job."""
    rows = [("size-fair", 1001, 1, 43035), ("size-fair", 2002, 2, 85901), ("job-fair", 1001, 1, 65003), ("job-fair", 2002, 1, 64997)]
    found = {(r.policy, r.key): (round(r.promised, 4), round(r.observed, 4)) for r in fairshare.share_report(spark.createDataFrame(rows, "policy string, key long, weight int, n long"), ["policy"]).collect()}
    assert found == {("size-fair", 1001): (0.3333, 0.3338), ("size-fair", 2002): (0.6667, 0.6662), ("job-fair", 1001): (0.5, 0.5), ("job-fair", 2002): (0.5, 0.5)}


def test_scaling_efficiencies(spark):
    rows = fairshare.scaling_efficiency(reports.read_scaling(spark, str(DATA / "scaling.csv")))
    found = {(r.nodes, r.policy, r.direction): round(r.efficiency, 4) for r in rows.collect()}
    assert found[1, "FIFO", "write"] == round(11746.27 / 11766.65, 4) and found[128, "Job-fair", "read"] == round(1140109.80 / (128 * 11766.65), 4)


def test_target_files(spark, tmp_path):
    (tmp_path / "log.ost7").write_text("# timestamp\tread\n2021-08-23:16:33:23\t1.5\t2\t3\t4\t5.5\t6\t7\t8\n")
    r = reports.read_target_io(spark, str(tmp_path / "log.ost7")).first()
    assert (r.target, r.read_mbps, r.max_write_ms, r.sample) == (7, 1.5, 8.0, "2021-08-23:16:33:23")


@pytest.fixture
def requests(spark, tmp_path):
    """Requests as a table and as a stream of three files."""
    rows = [(i % 3, i % 2, 1 + i % 3, [0, 1, 2][: 1 + i % 3], i % 3, 1_700_000_000 + i * 7 + 60 * (i // 20), 1048576, i % 3 == 2) for i in range(90)]
    df = spark.createDataFrame(rows, "jobid int, server int, nnode int, candidates array<int>, chosen int, s long, nlen long, inter_server boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for k in range(3):
        df.orderBy("ts").offset(30 * k).limit(30).coalesce(1).write.parquet(str(tmp_path / "in" / f"k{k}"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run_stream(spark, out, tmp_path, name, mode="append"):
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_periods_and_decisions_as_streams(spark, tmp_path, requests):
    """What a stream has finished is part of the batch form, and all of it but the last windows is finished."""
    df, stream = requests
    for name, form, cols in (("st2", lambda x: streams.active_periods(x, "jobid", "30 seconds"), ["jobid", "window_start", "window_end", "requests"]), ("st4", lambda x: streams.decision_rounds(x, "1 minute"), ["window_start", "ids", "id", "n"])):
        done, whole = values(run_stream(spark, form(stream), tmp_path, name), *cols), values(form(df), *cols)
        assert set(done) <= set(whole) and len(done) >= len(whole) - 6 and done


def finished(query):
    query.processAllAvailable()
    query.stop()


def test_fairness_rounds_as_stream(spark, tmp_path, requests):
    """Each finished round once, although the last batch is repeated after a failure."""
    df, stream = requests
    write = lambda: finished(streams.write_fairness_rounds(stream, 7, str(tmp_path / "rounds"), str(tmp_path / "c3"), "1 minute").start())
    write()
    cols = ["window_start", "jobid", "ops", "nnode", "scale"]
    done, whole = values(spark.read.parquet(str(tmp_path / "rounds")), *cols), values(streams.fairness_rounds(df, 7, "1 minute"), *cols)
    assert set(done) <= set(whole) and len(done) >= len(whole) - 6 and done
    commits = sorted((tmp_path / "c3" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    write()
    assert values(spark.read.parquet(str(tmp_path / "rounds")), *cols) == done
    counts = streams.round_counts(df, "1 minute")
    for _ in range(2):
        streams.put_rounds(counts, 5, 7, str(tmp_path / "again"))
    assert values(spark.read.parquet(str(tmp_path / "again")), *cols) == whole


def test_lost_connections_as_stream(spark, tmp_path, requests):
    """As in one batch, also when the stream stops and starts again between its files."""
    df, stream = requests
    beats = lambda x: x.select(F.when(F.col("ts") < F.timestamp_seconds(F.lit(1_700_000_200)), F.col("jobid")).otherwise(9).cast("long").alias("conn_id"), "ts", "inter_server")
    whole = values(streams.lost_connections(beats(df), 60), "conn_id", "last_us")
    out = streams.stream_lost_connections(beats(stream), 60)
    done = values(run_stream(spark, out, tmp_path, "st5"), "conn_id", "last_us")
    assert done == whole and len(done) == 2

    rest = tmp_path / "rest"
    rest.mkdir()
    for k in (1, 2):
        (tmp_path / "in" / f"k{k}").rename(rest / f"k{k}")
    for k in (0, 1, 2):
        if k:
            (rest / f"k{k}").rename(tmp_path / "in" / f"k{k}")
        put = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "lost"))
        finished(put.option("checkpointLocation", str(tmp_path / "c5")).start())
    assert values(spark.read.parquet(str(tmp_path / "lost")), "conn_id", "last_us") == whole
