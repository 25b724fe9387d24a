"""Token alignment, centroid clustering and substring dedup against brute force."""

import hashlib
import math
import os
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharelens.jobs.shared import shared_dir
from sharelens.llm import centroid_clustering, chat_format, common, line_dedup, near_dedup, pii, quality_classifier, substring_dedup, token_alignment, toxicity

ODD = [
    None, "", " ", "  ", "\n", "\n\n a", "a\r\nb", "x  y", "x　y   z  q", "<|endoftext|> <s>", "▁a", "éé",
    "a\x1cb c", "\x85 x", "日本語のテキスト と 漢字", "\U0001f642\U0001f642 ok", "tab\t\tb \t", "\x00", "\r\r x", "it's we'll 12,345.67",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    rows = [(i, t, None, None, None) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def sequence(rng, n, kinds=40):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{token_alignment.VOCABULARIES}/{token_alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{token_alignment.VOCABULARIES}/{token_alignment.PIECE_BPE}")


def aligned_slowly(tokenizers, text):
    """(A's ids, B's ids, groups, links) by comparing all byte ranges."""
    a, b = tokenizers
    if not text:
        return [], [], [], []
    value = token_alignment._byte_values()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [token_alignment.piece_bytes(b.id_to_piece(i)) for i in ids_b]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return [], [], [], []

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    ra, rb = ranges(parts_a), ranges(parts_b)
    links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(ra) for j, (t, f) in enumerate(rb) if s < f and t < e]
    groups, start = [], 0
    for end in sorted({e for _, e in ra} & {e for _, e in rb}):
        groups.append(tuple([i for i, (s, e) in zip(ids, r) if start <= s and e <= end] for ids, r in ((ids_a, ra), (ids_b, rb))))
        start = end
    return ids_a, ids_b, groups, links


@pytest.mark.parametrize("common", [1 << 20, 40, 0])
def test_alignment_against_brute_force(spark, tokenizers, common):
    rng = random.Random(5)
    texts = [*ODD, "The same text twice.", "The same text twice.", *(sequence(rng, 30) for _ in range(20)), "unbroken" * 300]
    slow = [aligned_slowly(tokenizers, t) for t in texts]
    counts = Counter(pair for *_, links in slow for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    got = {r["doc_id"]: r for r in token_alignment.align_tokenizers(documents(spark, texts).repartition(3), common=common).collect()}
    for i, (a, b, groups, links) in enumerate(slow):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        want = (len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest)
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, texts[i]


def test_alignment_of_empty_and_clashing_tables(spark):
    empty = documents(spark, ["x"]).where("false")
    assert token_alignment.align_tokenizers(empty).collect() == []
    clash = documents(spark, ["a b", None], [None, 7]).withColumns({c: F.lit("x") for c in ("pairs", "row", "n", "best", "n_a", "rare")})
    got = token_alignment.align_tokenizers(clash).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_a > 0) for r in got] == [(None, True), (7, False)]


def test_chunks_change_no_token(tokenizers):
    a, b = tokenizers
    files = [open(f"{token_alignment.VOCABULARIES}/{n}", "rb").read() for n in (token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)]
    tokens, rng = token_alignment.Aligner(*files), random.Random(9)
    assert tokens.cut
    marks = [" ", "  ", "\n", "\t", "\r\n", " ", "　", ";", "'s", "a", "Z", "é", "漢", "7", "\x1c", "<s>", "word"]
    for _ in range(1500):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 25)))
        ids_a, ids_b = tokens.encode(text)
        assert list(ids_a) == a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert list(ids_b) == b.encode(text), repr(text)


def test_gallop():
    rng = random.Random(1)
    for _ in range(300):
        x, y = (sorted(rng.sample(range(400), rng.randint(1, 120))) for _ in range(2))
        x[-1:], y[-1:] = [400], [400]
        x, y = sorted(set(x)), sorted(set(y))
        assert list(token_alignment.gallop(x, y)) == [sum(v < u for v in y) for u in x]


VECTORS = "vec_id long, embedding array<float>, label int"


def clustered_slowly(rows, k, rounds, dimensions, scale):
    """{position: (cluster, distance)}, inertia by cluster, final centroids; all in Python's whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and abs(x) < float("inf") for x in v)]
    whole = [[int(np.floor(scale * float(np.float32(x)))) for x in v] for _, v in kept]
    rank = lambda j: (kept[j][0] is None, hashlib.sha256(f"1:{kept[j][0]}".encode()).hexdigest(), whole[j])
    centroids = [whole[j] for j in sorted(range(len(kept)), key=rank)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for v in whole]
        for n in range(len(centroids)):
            if mine := [v for v, o in zip(whole, own) if o == n]:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(kept[j][0], near(v)[1], near(v)[0]) for j, v in enumerate(whole)]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found]


@pytest.mark.parametrize("spread", [1, 30, 2_000_000])
def test_clusters_against_brute_force(spark, rows_of, spread):
    """Few values make ties, repeated vectors and empty clusters; large ones sums beyond 2^32."""
    rng = random.Random(spread)
    rows = [(i, [rng.randint(-spread, spread) / 3 for _ in range(5)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0] * 4), (63, [1.0, None, 1.0, 1.0, 1.0]), (64, [float("nan")] * 5), (65, [float("inf")] * 5)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, [0.5] * 5)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1))
    for parts in (1, 7):
        got = centroid_clustering.cluster_vectors(df.repartition(parts), k=9, rounds=3, dimensions=5).collect()
        columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert rows_of(got, columns) == sorted(clustered_slowly(rows, 9, 3, 5, 64), key=lambda x: tuple((v is None, str(v)) for v in x))


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 0)], VECTORS)
    got = centroid_clustering.cluster_vectors(df, k=16, dimensions=2).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in got) == [(1, 0, 0), (2, 0, 0)] and len({r.cluster for r in got}) == 2
    assert centroid_clustering.cluster_vectors(df.where("false"), dimensions=2).collect() == []


def test_threshold_walk_stops_early_and_meets_ties():
    rng = np.random.default_rng(3)
    for k, d in ((1, 3), (2, 1), (16, 2), (40, 6)):
        for high in (3, 1000):
            x, c = rng.integers(-high, high, (300, d)), rng.integers(-high, high, (k, d))
            exact = ((x[:, None] - c[None]) ** 2).sum(2)
            number, distance = centroid_clustering.nearest(x, c)
            assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def cut_slowly(rows, window):
    """(doc_id, n_words, n_removed, kept) of each (doc_id, text)."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: 2**63 - 1 if i is None else i
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            least[x] = min(least.get(x, 2**63), order(i))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < order(i) for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.mark.parametrize("hot", [256, 1, 0])
@pytest.mark.parametrize("window,gram", [(13, 6), (5, 5), (4, 1)])
def test_substrings_against_brute_force(spark, rows_of, window, gram, hot):
    rng = random.Random(window)
    passages = [sequence(rng, n, 1000) for n in (5, 13, 14, 40)]
    rows = [(i, f"{sequence(rng, rng.randint(0, 30), 300)} {rng.choice(passages)}\n{sequence(rng, rng.randint(0, 30), 300)}") for i in range(80)]
    rows += [(80 + i, passages[3]) for i in range(30)]  # copies
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "é\u3000x " * 40), (205, "é\u3000x " * 41), (206, "a " * 3000), (207, "a " * 20)]
    rows += [(5, rows[5][1]), (5, passages[3]), (None, passages[3]), (None, sequence(rng, 60)), (None, passages[2] + " end"), (-3, passages[2])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("m", "run", "doc", "starts", "_x")})
    for parts in (1, 5):
        got = substring_dedup.dedup_substrings(df.repartition(parts), window=window, gram=gram, hot=hot).collect()
        want = cut_slowly(rows, window)
        assert rows_of(got, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]) == sorted(want, key=lambda x: tuple((v is None, str(v)) for v in x))


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    """Stages written one after another and rounds of union-find leave no shuffle on disk, and the session's setting as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f) for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, setting = shuffles(), spark.conf.get(name)
    sums = spark.range(10000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n"))
    edges = common.stage(sums.select("k", (F.col("k") + 1).alias("l")).union(sums.select("k", "n")).toDF("a", "b"), "edges")
    comps = common.stage(common.components(edges), "comps")
    until = time.time() + 10
    while shuffles() - before and time.time() < until:  # they are deleted in the background
        time.sleep(0.1)
    assert not shuffles() - before
    assert comps.select("comp").distinct().count() == 1
    assert spark.conf.get(name) == setting


def test_rows_of_a_common_window_do_not_grow_with_its_runs(spark):
    """2,000 documents with one passage and different ends: a window is joined in a row for each task, not for each run."""
    passage = [f"p{j}" for j in range(20)]
    ends = [" ".join(x) for i in range(2000) for x in ([f"w{i}"] * 4 + passage[:16], passage)]
    runs = spark.createDataFrame([(1, i, i // 2, i // 2, e.encode(), 8) for i, e in enumerate(ends)], "m long, k long, doc long, last long, run binary, n int")
    got = substring_dedup.met_windows(runs.repartition(4), 13).collect()
    assert len(got) <= 4 * 8  # the passage has 8 windows; no other is in two documents
    assert sorted(x for r in got for x in r.members) == [(i, at, i // 2) for i, e in enumerate(ends) for at in range(8) if e.split()[at][0] == "p"]
    assert {r.least for r in got} == {0}


def test_windows_of_a_run_come_back_as_one_row(spark, monkeypatch):
    """2,000 runs that share eight windows: what is found is a row for each run, and no pack has much more than its share of them."""
    monkeypatch.setattr(substring_dedup, "PACK", 1000)
    passage = " ".join(f"p{j}" for j in range(20))
    runs = spark.createDataFrame([(1, i * 2654435761, i, i, f"{passage} w{i}".encode(), 9) for i in range(2000)], "m long, k long, doc long, last long, run binary, n int")
    met = substring_dedup.met_windows(runs, 13)
    packs = Counter()
    for r in met.collect():
        packs[r.pack] += len(r.members)
    assert len(packs) == 19 and max(packs.values()) < 2 * 1000 and sum(packs.values()) == 2000 * 8
    got = substring_dedup.by_run(met).collect()
    assert {(r.m, r.k, tuple(map(tuple, r.early))) for r in got} == {(1, i * 2654435761, tuple((at, 0) for at in range(8))) for i in range(1, 2000)}
    assert len(got) == 1999
    plan = substring_dedup.by_run(met)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "explode(members" not in plan


def test_substrings_of_an_empty_table(spark):
    assert substring_dedup.dedup_substrings(documents(spark, ["x"]).where("false")).collect() == []


def test_super_k_mers_hold_each_window_once():
    rng = random.Random(2)
    for _ in range(200):
        words = sequence(rng, rng.randint(0, 60), rng.choice([1, 3, 50])).encode().split()
        window = rng.randint(1, 15)
        gram = rng.randint(1, window)
        _, start, n = substring_dedup.runs(words, window, gram)
        covered = [s + k for s, size in zip(start.tolist(), n.tolist()) for k in range(size)]
        assert covered == list(range(max(0, len(words) - window + 1)))


# Mends of earlier operators


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 1000, 20_000])
def test_running_totals(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")), lambda i: (i * 7) % 11).alias("x"))
    x = F.slice("x", 1, n) if n else F.filter("x", lambda v: F.lit(False))
    want = np.cumsum([(i * 7) % 11 for i in range(n)]).tolist()
    assert df.select(common.running_totals(x)).first()[0] == want


def test_many_spans_in_one_text(spark):
    """40,000 addresses in one text: time in proportion to the text."""
    one = "mail a.b1@mail.example.com now "
    df = spark.createDataFrame([(1, one * 40_000), (2, one * 3)], "doc_id long, text string")
    spans = df.select("doc_id", pii.candidates(F.col("text")).alias("s"))
    spans.where("doc_id = 2").collect()
    begin = time.time()
    got = spans.select(F.size("s").alias("n"), F.element_at("s", -1)["start"].alias("at")).collect()
    assert time.time() - begin < 10
    assert [(r.n, r["at"]) for r in got] == [(40_000, len(one) * 39_999 + 5), (3, len(one) * 2 + 5)]


def test_long_conversations(spark):
    """Masks of a conversation of 6,000 turns, by hand."""
    rows = [(2 * k, i, "assistant" if i % 2 else "user", f"{k} turn {i}") for k in (0,) for i in range(6000)] + [(1, 0, "user", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    begin = time.time()
    r = chat_format.format_preferences(df).first()
    assert time.time() - begin < 20
    at, spans = 0, []
    for _, _, role, text in rows[:6000]:
        shown = f"<|{role}|>\n{text}<|end|>\n"
        if role == "assistant":
            spans.append(f"{at + len(role) + 5}:{at + len(shown) - 1}")
        at += len(shown)
    assert r.chosen_mask == ",".join(spans) and r.rejected_mask == ""


def test_expectation_maximisation_over_single_candidates():
    """The chances of vote patterns against EM that looks at every candidate by itself."""
    rng = random.Random(6)
    patterns = [(k, tuple(rng.choice((-1, 0, 1)) for _ in range(4)), rng.randint(1, 9)) for k in (0, 2) for _ in range(12)]
    patterns = [(k, v, n) for (k, v), n in {(k, v): n for k, v, n in patterns}.items()]
    got = pii.reliabilities(patterns, rounds=4)
    for kind in (0, 2):
        each = [v for k, v, n in patterns if k == kind for _ in range(n)]
        real = [0.05 if v[0] < 0 else 0.95 if sum(v) > 0 else 0.5 for v in each]
        for _ in range(4):
            share = (sum(real) + 1) / (len(each) + 2)
            odds = [math.log(share / (1 - share))] * len(each)
            for j in range(4):
                weight = len(each) if j == 0 else 3
                for vote in (-1, 0, 1):
                    lean, back = pii.PRIOR_RATES[j == 0][vote]
                    yes = (sum(p for v, p in zip(each, real) if v[j] == vote) + weight * lean) / (sum(real) + weight)
                    no = (sum(1 - p for v, p in zip(each, real) if v[j] == vote) + weight * back) / (len(each) - sum(real) + weight)
                    odds = [o + math.log((yes + 1e-6) / (no + 1e-6)) * (v[j] == vote) for o, v in zip(odds, each)]
            real = [1 / (1 + math.exp(-max(-30, min(30, o)))) for o in odds]
        for v, p in zip(each, real):
            assert got[kind, v] == pytest.approx(p, abs=1e-9)


def test_toxicity_learns_from_a_bounded_number_of_words(spark):
    rng = random.Random(4)
    texts = [sequence(rng, 40) + (" vile nasty" if i % 3 == 0 else "") for i in range(240)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    shared, _, _ = toxicity.train(docs, labels, words=1000)
    assert 0 < sum(len(texts[i].split()) for i in shared.value.ids) <= 1000
    assert len(toxicity.train(docs, labels)[0].value.ids) > 140
    assert toxicity.toxicity(docs, labels, words=1000).count() == 240


def test_toxicity_reads_postings_in_their_order():
    """What a search makes besides the index is less than 26 bytes for each posting of its words, and its neighbours are the nearest."""
    rng = random.Random(5)
    words = [b"t%d" % i for i in range(400)]
    examples = [(i, i % 2, Counter(rng.sample(words, 60))) for i in range(3000)]
    index = toxicity.BlockMaxIndex({w: 1 + i / 400 for i, w in enumerate(words)}, examples, 0.5)
    asked = Counter(words)
    index.nearest(asked, None)
    postings = sum(len(e[2]) for e in examples)
    tracemalloc.start()
    at, cosine = index.nearest(asked, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 26 * postings
    unit = index.unit(asked)
    exact = sorted((sum(unit[t] * w for t, w in index.unit(e[2]).items()) for e in examples), reverse=True)
    assert list(cosine) == pytest.approx(exact[: toxicity.K], abs=1e-6)


def test_quality_learns_from_all_labels(spark, monkeypatch):
    """17,000 labelled documents outside the held-out third, one of 20 low: all are in the model's rows, and most high ones in a pair."""
    seen, stage = {}, quality_classifier.stage
    monkeypatch.setattr(quality_classifier, "stage", lambda df, name: seen.setdefault(name, stage(df, name)))
    docs = spark.range(26_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 20 == 0, "### low text").otherwise("a good text").alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 20 > 0).cast("int").alias("quality"))
    model = quality_classifier.train(docs, marks)
    taught = docs.where("crc32(string(doc_id)) % 3 <> 1").count()
    assert seen["features"].select("doc_id").distinct().count() == taught > 17_000
    assert seen["pairs"].count() > 6 * taught
    found = quality_classifier.score_quality(docs, model).groupBy(F.col("doc_id") % 20 == 0).agg(F.min("score"), F.max("score")).collect()
    assert all(r[1] > 0.5 if not r[0] else r[2] <= 0.5 for r in found)


# The pipeline's stages


def test_stages_leave_little_behind(spark):
    """What the line and the near-duplicate stage write on the way is gone before the next stage begins, whoever calls them."""
    draw = random.Random(5)
    lines = [sequence(draw, 12, 400) for _ in range(60)]
    docs = documents(spark, ["\n".join(draw.sample(lines, 4) + [sequence(draw, 9, 400)]) for _ in range(60)])
    at = shared_dir(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(at) if "-" in x and os.path.isdir(f"{at}/{x}") and any(y.startswith("part-") for y in os.listdir(f"{at}/{x}"))}
    for step in (line_dedup.line_dedup_stage, near_dedup.near_dedup_stage):
        before = tables()
        assert step(spark, docs, "").count() > 0
        assert {x.rpartition("-")[0] for x in tables() - before} <= {"gone"}


@pytest.mark.parametrize("compared", [0, 64])
def test_long_lists_by_prefixes_or_dealt(spark, monkeypatch, compared):
    """Lists of more than a block are compared by prefixes or in pairs of blocks; no line that has its like is kept either way."""
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    monkeypatch.setattr(line_dedup, "COMPARED", compared, raising=False)
    used, prefixes = [], line_dedup.prefixes
    monkeypatch.setattr(line_dedup, "prefixes", lambda *a: used.append(1) or prefixes(*a))
    draw, lines = random.Random(4), []
    phrase = "the same beginning of all the lines of this list, "
    for _ in range(40):
        end = sequence(draw, 12, 900)
        lines += [phrase + end, phrase + end[:-1] + "!"]
    found = line_dedup.dedup_lines(documents(spark, lines)).collect()
    assert sorted(r.doc_id for r in found if r.text) == list(range(0, 80, 2))
    assert bool(used) == (compared == 0)
