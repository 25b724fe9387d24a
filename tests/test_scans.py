"""Running sums, ranks and look-ups over all rows: equal to Python's, and no task holds them all."""

import random
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharelens.operators import aggregates, catalog, fairshare, joins, scans
from sharelens.sources import reports
from sharelens.streaming import streams


@pytest.fixture
def eight(spark):
    """Eight shuffle partitions, as many as are planned."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_part(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize("groups", [1, 3, 200])
def test_running_sums_and_previous_rows(eight, groups):
    rng = random.Random(groups)
    rows = [(rng.randrange(groups) if i % 50 else None, i, rng.randint(-5, 9)) for i in range(3000)]
    rng.shuffle(rows)
    df = eight.createDataFrame(rows, "g int, t int, x int")
    summed = scans.with_running(df, ["g"], ["t"], s=F.col("x"), n=F.lit(1))
    seen = scans.with_previous(df, ["g"], ["t"], was=F.col("x"), at=F.col("t"))
    got = {r.t: (r.s, r.n, r.s_all) for r in summed.collect()}
    before = {r.t: (r.was, r["at"]) for r in seen.collect()}
    for g in {r[0] for r in rows}:
        own = sorted((t, x) for k, t, x in rows if k == g)
        whole = sum(x for _, x in own)
        for i, (s, (t, x)) in enumerate(zip(accumulate(x for _, x in own), own)):
            assert got[t] == (s, i + 1, whole)
            assert before[t] == (own[i - 1][1], own[i - 1][0]) if i else before[t] == (None, None)
    if groups == 1:
        assert largest_part(scans.ranges(df, ["g"], ["t"])) < 3000 / 4


@pytest.mark.parametrize("n", [1, 2, 7, 4000])
def test_percentiles_of_one_group(eight, n):
    """Ties, infinities of copies and nulls; ranges of values, not the group, are what a task holds."""
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2 if n > 100 else 6)
    rows = [("a", float(v)) for v in values] + [("a", None), ("b", None), (None, 5.0), (None, 7.0)]
    df = eight.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in aggregates.percentiles(df, "v", ["g"], [0, 5, 99.9, 100, 250]).collect()}
    for name, p in (("median", 50), ("p0", 0), ("p5", 5), ("p99.9", 99.9), ("p100", 100), ("p250", 100)):
        assert got["a"][name] == pytest.approx(np.percentile(values, p), abs=1e-9)
    assert got["b"]["median"] is None and got[None]["median"] == 6.0
    whole = scans.exact_percentiles(df, "v", [], {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(np.median([*values, 5.0, 7.0]))
    if n > 1000:
        wide = eight.range(20_000).select((F.rand(3)).alias("v"))
        assert largest_part(scans.ranges(wide, [], ["v"])) < 20_000 / 4


@pytest.mark.parametrize("spread", [2 / 4000, 0])
def test_percentiles_order_few_values_of_a_large_group(eight, monkeypatch, spread):
    """Of 200,000 different values of a group and 100,000 equal ones, those near the wanted ranks are ordered; where a sketch misses, the result is exact too."""
    put, ranges = [], scans.ranges
    monkeypatch.setattr(scans, "SPREAD", spread)
    monkeypatch.setattr(scans, "ranges", lambda df, by, order: put.append(ranges(df, by, order)) or put[-1])
    df = eight.range(300_000).select((F.col("id") % 2 == 0).alias("g"), F.when(F.col("id") < 200_000, F.xxhash64("id") / 1e9).otherwise(7.0).alias("v"))
    for by in (["g"], []):
        put.clear()
        got = scans.exact_percentiles(df, "v", by, {"a": 0.05, "m": 0.5, "z": 0.999}).collect()
        assert put[0].count() < 200_000 / 50
        assert spread == 0 or len(put) == 1
        values = df.toPandas()
        for r in got:
            own = values[values.g == r.g].v if by else values.v
            assert [r.a, r.m, r.z] == pytest.approx(np.percentile(own, [5, 50, 99.9]), rel=1e-12)


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert aggregates.percentiles(none, "v", ["g"], [5]).collect() == []
    assert [tuple(r) for r in scans.exact_percentiles(none, "v", [], {"m": 0.5}).collect()] == [(None,)]


def test_a_key_that_spans_years(spark):
    """10^8 seconds of one key: the calendar is unfolded in chunks over many tasks."""
    df = spark.createDataFrame([(1, 0, 1 << 20), (1, 10**8, 3 << 20), (2, 7, 1 << 20)], "k int, t long, nlen long")
    rows = aggregates.throughput_slices(df, "k")
    assert rows.agg(F.count("*"), F.sum("mbps"), F.max("slice")).first()[:] == (10**8 + 2, 5.0, 10**8)
    few = aggregates.throughput_slices(df.where("t < 10"), "k", 2)
    assert sorted(map(tuple, few.collect())) == [(1, 0, 0.5), (2, 0, 0.5)]


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_many_draws_of_a_set(spark, monkeypatch, most):
    monkeypatch.setattr(fairshare, "DRAWS", most)
    rng = random.Random(most)
    sets = {g: [rng.choice([0, 1, 2.5, 3]) for _ in range(rng.randint(1, 6))] for g in range(12)}
    candidates = [(g, i, 100 * g + i, float(w)) for g, ws in sets.items() for i, w in enumerate(ws)]
    draws = [(g, k, rng.choice([0.0, 1.0, 2.5, 5.5, rng.uniform(0, 12)])) for g in range(14) for k in range(10)]
    draws += [(3, 99, 1.0), (3, 99, 1.0)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = fairshare.weighted_pick(frame(candidates, "g int, seq int, key int, weight double"), frame(draws, "g int, k int, r double"), "g")
    want = []
    for g, k, r in draws:
        if g in sets:
            ends = list(accumulate(sets[g]))
            want.append((g, k, r, 100 * g + min(bisect_right(ends, r), len(ends) - 1)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_deep_pages_of_a_directory(eight):
    names = [f"f{i:05d}" for i in range(5000)]
    rows = [("/d", 4, "/", "d")] + [(f"/d/{n}", 8, "/d", n) for n in random.Random(1).sample(names, len(names))]
    df = eight.createDataFrame(rows, "path string, type int, parent string, entry string")
    for offset, limit, dots in ((0, 3, True), (4321, 50, False), (4990, 100, False), (6000, 5, False), (7, 0, False)):
        have = ([".", ".."] if dots else []) + names
        page = sorted((r["at"], r.entry, r.total, r.status) for r in catalog.list_directory(df, "/d", offset, limit, dots).collect())
        assert page == [(offset + i, n, len(have), "OK") for i, n in enumerate(have[offset : offset + limit])]
    assert [tuple(r) for r in catalog.list_directory(df, "/none").collect()] == [(None, None, None, 0, "ENOENT")]
    parts = scans.ranges(df.where("parent = '/d'"), [], ["entry"])
    found = scans.offsets(parts, [], n=F.lit(1)).where("n_before < 4371 AND n_before + n > 4321")
    assert found.count() <= 2


def test_replay_below_a_removed_top_directory(eight):
    """All paths lie below a directory that is removed at the end, most of them in one; they are dealt over tasks all the same."""
    n = 3000
    log = [(0, "mkdir", "/myfs/top"), (1, "mkdir", "/myfs/top/hot"), (2, "mkdir", "/myfs/top/cold")]
    log += [(10 + i, "create", f"/myfs/top/{'cold' if i % 10 == 0 else 'hot'}/f{i}") for i in range(n)]
    log += [(20_000, "rmdir", "/myfs/top"), (20_001, "rmdir", "/myfs/top/hot")]
    log += [(30_000 + i, "unlink", path) for i, (_, kind, path) in enumerate(log) if kind == "create"]
    log += [(90_000, "rmdir", "/myfs/top/hot"), (90_001, "rmdir", "/myfs/top"), (90_002, "rmdir", "/myfs/top/cold"), (90_003, "rmdir", "/myfs/top")]
    log += [(90_004, "create", "/myfs/top/hot/late"), (90_005, "mkdir", "/myfs/top")]
    df = eight.createDataFrame([(i, i, k, p) for i, k, p in log], "event_id long, t long, kind string, path string")
    for salted in (1 << 16, 100):
        got = {r.event_id: r.status for r in catalog.replay_status(df, salted=salted).collect()}
        odd = {i: s for i, s in got.items() if s != "OK"}
        assert odd == {20_000: "ENOTEMPTY", 20_001: "ENOTEMPTY", 90_001: "ENOTEMPTY", 90_004: "ENOENT"}


def test_replay_judges_no_round_in_vain(eight, monkeypatch):
    """A log whose events all succeed is judged once: what is guessed at first is found true."""
    tables, saved = [], catalog.saved
    monkeypatch.setattr(catalog, "saved", lambda df: tables.append(saved(df)) or tables[-1])
    log = [(0, "mkdir", "/myfs/a"), (1, "create", "/myfs/a/f"), (2, "unlink", "/myfs/a/f"), (3, "rmdir", "/myfs/a")]
    df = eight.createDataFrame([(i, i, k, p) for i, k, p in log], "event_id long, t long, kind string, path string")
    assert {r.status for r in catalog.replay_status(df).collect()} == {"OK"}
    assert len(tables) == 3  # the log, its events by directory, their states


def test_decisions_over_large_sets_travel_once(spark):
    """8 sets of 2,000 ids, each decided on by all its members: what is shuffled grows with the ids, not with their square."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    each = spark.range(16000).select(F.col("id").alias("chosen"), (F.col("id") % 8).alias("k"), F.lit(3).cast("long").alias("n"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    groups = each.groupBy("k").agg(F.collect_list("chosen").alias("candidates")).withColumn("set_id", aggregates.set_name("candidates"))
    decisions, sets = each.join(groups.select("k", "set_id"), "k"), groups.select("set_id", "candidates")
    packed = aggregates.counted_sets(decisions, sets=sets)
    log = aggregates.format_decisions(packed).select(F.concat(F.lit("x reportDecisionLog rank 1 time=2.0 "), "log").alias("value"))
    forms = {
        "a5": (aggregates.decision_counts(decisions, sets), 3), "a6": (aggregates.merge_decisions(packed, packed), 6),
        "st4": (streams.decision_rounds(decisions, "1 day", sets=sets), 3), "s3": (reports.parse_decision_log(log), 3),
    }
    for name, (rows, n) in forms.items():
        before = set(stages())
        assert rows.agg(F.count("*"), F.countDistinct("id"), F.min("n"), F.max("n"), F.min(F.length("ids"))).first()[:4] == (16000, 16000, n, n), name
        # With their sets' texts the rows would take 16,000 times 10 KB.
        assert sum(b for i, b in stages().items() if i not in before) < 8_000_000, name


def test_decisions_without_some_choices(spark):
    """Candidates in any order, repeated, never chosen or null; a choice outside its set counts nowhere. Streams' form and batch agree with a count by hand."""
    rows = [([3, 1, 2], 1, 2), ([1, 2, 3, 3], 3, 1), ([1, 2], 7, 4), ([1, 2], None, 1), ([5, None], 5, 1), ([], 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "candidates array<long>, chosen int, n long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    want = [("1,2", 1, 0), ("1,2", 2, 0), ("1,2,3", 1, 2), ("1,2,3", 2, 0), ("1,2,3", 3, 1), ("5", 5, 1), ("5", None, 0)]
    for got in (aggregates.decision_counts(df), streams.decision_rounds(df, "1 day")):
        assert sorted((tuple(r) for r in got.select("ids", "id", "n").collect()), key=lambda r: (r[0], r[1] is None, r[1])) == want
    packed = aggregates.counted_sets(df.where("size(candidates) > 2"))
    assert [r["log"] for r in aggregates.format_decisions(packed).collect()] == ["1,2,3:2,0,1"]


def test_decision_log_of_a_large_set(spark):
    """A set of 40,000 ids is read without a stack for each of them."""
    ids = ",".join(str(i) for i in range(40_000))
    lines = spark.createDataFrame([(f"FairQueue::reportDecisionLog rank 1 time=2.5 {ids}:{ids}", 1)], "value string, line long")
    assert reports.parse_decision_log(lines).agg(F.count("*"), F.sum(F.col("id") - F.col("n"))).first()[:] == (40_000, 0)
    assert reports.rejected_lines(lines, "decision_log").count() == 0


@pytest.mark.parametrize("few", [0, 3, 16])
def test_blocks_of_long_runs(spark, few):
    """Runs of up to 2^40 blocks, gaps, overlaps, paths of one or many runs and of none, against a look at every run."""
    draw, stripe = random.Random(few), 2097152
    extents = [("a", 0, stripe, 1 << 40), ("b", 5 * stripe, stripe, 3), ("b", 7 * stripe, stripe, 1 << 20), ("d", 0, 0, 4)]
    extents += [("c", i * 3000 * stripe, stripe // 2, draw.randint(0, 8000)) for i in range(20)] + [("c", 0, 4096, 1 << 33)]
    requests = [(p, draw.randrange(70_000) * stripe + draw.randrange(3), i) for i in range(300) for p in ("a", "b", "c", "d")] + [("b", 8 * stripe, -1), (None, 0, -2), ("x", 1, -3)]
    want = []
    for p, off, i in requests:
        held = [(s + (off - s) // size * size, size) for q, s, size, n in extents if p == q and s <= off < s + size * n]
        want += [(i, p, off, s, size) for s, size in held or [(None, None)]]
    runs = spark.createDataFrame(extents, "path string, file_offset long, block_size long, blocks long")
    rows = joins.locate_blocks(spark.createDataFrame(requests, "path string, off long, i int"), runs, few=few)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in rows.select("i", "path", "off", "file_offset", "block_size").collect()), key=key) == sorted(want, key=key)


def test_space_of_runs(spark):
    """A run of 2^40 blocks counts as many pages as its blocks would, without a row for each."""
    catalog_ = spark.createDataFrame([("/myfs/a",)], "path string")
    runs = spark.createDataFrame([("a", 0, 4097, 1 << 40), ("b", 0, 4096, 3)], "path string, file_offset long, block_size long, blocks long")
    assert aggregates.space_report(catalog_, runs).first()["free_pages"] == aggregates.PAGES - (2 << 40) - 3
    assert aggregates.space_report(catalog_, runs.drop("blocks")).first()["free_pages"] == aggregates.PAGES - 3
