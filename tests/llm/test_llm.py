"""The pipeline operators against brute force and on awkward rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sharelens.llm import chat_format, decontamination, html_extraction, line_dedup, mixing, near_dedup, pii, quality_classifier, quality_rules, toxicity
from sharelens.llm.common import components, linked_classes

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node string"


def text(seed: int, n: int = 40) -> str:
    return " ".join(f"{WORDS[(seed * 7 + i * i * (seed % 5 + 1)) % 20]}{(seed * 31 + i) % 97}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, exact and near copies, repeated rows, columns with clashing names."""
    near = text(1).split()
    near[20] = "changed"
    rows = [(1, text(1)), (2, text(1)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, text(2)), (7, text(2)), (None, text(3)), (8, text(4, 30000)), (9, "one two"), (10, "One two"), (11, text(5) + "\n" + text(6) + "\n" + text(5)), (12, text(6))]
    return spark.createDataFrame([(i, t, None if i == 9 else "en", None if i == 10 else "s", 0, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (None, 3), (9, 9)], "a long, b long")
    found = {r.node: r.comp for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(31)}, 50: 50, 70: 50, 100: 50}


def linked(spark, nodes, links):
    """The classes of one list of `nodes` in which just `links` are similar."""
    true = spark.createDataFrame(links, "a long, b long")
    return {r.node: r.comp for r in linked_classes(spark.createDataFrame([(7, n) for n in nodes], "key long, node long"), lambda pairs: pairs.join(true, ["a", "b"])).collect()}


def test_links_beside_a_pivot_without_links(spark):
    assert linked(spark, [1, 2, 3], [(1, 2)]) == {1: 1, 2: 1}


def test_links_beside_a_pivot_drawn_twice(spark):
    """A chain in which the second round draws the pivot of the first one again."""
    drawn = {r.id: r.h for r in spark.range(1, 40).select("id", F.xxhash64("id", F.lit(1)).alias("h")).collect()}
    last = next(i for i in range(3, 40) if drawn[i] < drawn[i - 1])
    assert linked(spark, [last - 2, last - 1, last], [(last - 2, last - 1), (last - 1, last)]) == dict.fromkeys([last - 2, last - 1, last], last - 2)


def test_near_duplicates(docs, none):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    comp = {r.doc_id: r.component_id for r in rows}
    assert comp[2] == comp[3] == 1 and comp[10] == 9 and comp[4] == 4 and comp[7] == 7 and comp[None] is None
    assert {r.doc_id: r.n_shingles for r in rows}[5] == 0
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_brute_force(spark):
    base = [text(s, 60).split() for s in range(12)]
    texts = [" ".join(w if (i * 13 + k * 7) % (8 + i % 9 * 3) else f"x{i}{k}" for k, w in enumerate(base[i % 12])) for i in range(150)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    up = list(range(150))

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in range(150):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {i: root(i) for i in range(150)}


def test_line_dedup(spark, docs, none):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "_lines_gone"]
    assert rows[2].text == "" and rows[3].text == "" and rows[1].text == text(1) and rows[4].text is None and rows[6].text == " \n\t "
    assert rows[11].text == text(5) + "\n" + text(6) and rows[12].text == "" and rows[7].text == text(2)
    assert line_dedup.dedup_lines(none).count() == 0


def shingles(line, size=5):
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def test_line_dedup_sees_every_character(spark):
    lines = ["https://www.example.org/news/alpha", "https://www.example.org/shop/omega-77", "See https://example.com/foo for", "See https://example.com/bar for", "今天的天气非常好我们一起去公园散步吧", "今天的天气非常好我们一起回家看电视剧", "d41d8cd98f00b204e9800998ecf8427e", "d41d8cd98f00ffffffffffffffffffff"]
    for a, b in zip(lines[::2], lines[1::2]):
        assert len(shingles(a) & shingles(b)) < 0.75 * len(shingles(a) | shingles(b))
    rows = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == dict(enumerate(lines))
    found = spark.createDataFrame([(x,) for x in [*lines, "abcd", "😀a😀b😀c😀"]], "line string").select("line", F.size(line_dedup.shingle_hashes(F.col("line"))).alias("n")).collect()
    assert all(r.n == len(shingles(r.line)) for r in found)


def test_band_keys_by_set_size(spark):
    """Sets of at most EVERY members with J >= 0.75 always share a key, larger ones nearly always: brute force over random sets."""
    import random

    draw, pairs = random.Random(5), []
    for common, left, right in [(3, 0, 1), (4, 0, 1), (6, 1, 1), (6, 0, 2), (9, 1, 2), (12, 2, 2), (12, 0, 4)] + [(15, 2, 3), (30, 5, 5), (60, 10, 10)]:
        for _ in range(150):
            h = [draw.randrange(-(2**63), 2**63) for _ in range(common + left + right)]
            pairs.append((common + max(left, right), sorted(h[: common + left]), sorted(h[:common] + h[common + left :])))
    rows = line_dedup.with_band_keys(spark.createDataFrame([(2 * i + k, s) for i, p in enumerate(pairs) for k, s in enumerate(p[1:])], "id long, hashes array<long>"))
    keys = {r.id: set(r["keys"]) for r in rows.collect()}
    missed = {}
    for i, (size, _, _) in enumerate(pairs):
        missed[size] = missed.get(size, 0) + (not keys[2 * i] & keys[2 * i + 1])
    assert all(n <= (0 if size <= 16 else 8) for size, n in missed.items()), missed


def test_decontamination(spark, docs, none):
    items = [(1, text(1)), (2, "one two"), (3, None), (4, ""), (5, "beta gamma"), (5, text(6))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {}
    for i, t in items:
        w = fold(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    for part in (10**6, 7):
        for r in decontamination.decontaminate(docs, bench, part_windows=part).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
            w, hit, ids = fold(r.text), set(), set()
            for p, i in windows.items():
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        ids |= i
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    assert decontamination.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(docs, bench.limit(0)).collect())


def test_quality_rules(docs, none):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert rows[4].n_words == 0 and rows[4].base_failed and not rows[4].kept and rows[1].kept
    assert rows[11].n_dup_lines == 1 and rows[11].n_repeat_words == 80
    words = (text(1) + " " + text(2)).encode().split()
    assert quality_rules.repeated_words(words) == 0 and quality_rules.repeated_words(words + words[:8]) == 16 and quality_rules.repeated_words([b"a"] * 9) == 9
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_classifier(spark, none):
    rows = [(i, text(i) if i % 3 else " ".join(f"{w}###" for w in text(i).split())) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = labels(spark, [(i, int(i % 3 > 0), 0) for i in range(200)] + [(5, 0, 0), (None, 1, 0), (999, 1, 0), (7, None, 0)])
    found = quality_classifier.quality_classifier(docs, marks).where("doc_id < 300").collect()
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in found) >= 295
    assert {r.score for r in quality_classifier.quality_classifier(docs, marks.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_classifier(none, marks).count() == 0


def test_toxicity(spark, none):
    rows = [(i, text(i) + (" vile nasty" if i % 4 == 0 else "")) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(300)])
    found = toxicity.toxicity(docs, marks).where("doc_id < 400").collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in found)
    assert toxicity.toxicity(docs, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(none, marks).count() == 0


def test_toxicity_keeps_all_terms_and_rows(spark):
    rows = [(i, text(i) + (" vile nasty" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared, _, _ = toxicity.train(docs, labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(300)]))
    kept = [i for i in range(300) if i in set(shared.value.ids)]
    assert kept == [r.doc_id for r in docs.where(~toxicity.held_out()).where("doc_id < 300").orderBy("doc_id").collect()]
    assert set(shared.value.idf) == {w.encode() for i in kept for w in rows[i][1].lower().split()}
    alone, long = (c[0] for _, c in shared.value.nearest_each([(toxicity.Counter(x.encode().split()), None) for x in ("vile", "vile " + " ".join(f"other{i}" for i in range(10000)))]))
    assert long < 0.1 * alone  # words that no example has count in the norm


def test_block_max_is_exact():
    terms = [bytes([97 + i]) for i in range(8)]
    idf = {t: 1 + i / 3 for i, t in enumerate(terms)}
    examples = [(i, i % 2, {terms[j]: 1 + (i * j) % 3 for j in range(8) if (i >> (j % 5)) % 3 == j % 3}) for i in range(500)]
    examples = [e for e in examples if e[2]]
    index = toxicity.BlockMaxIndex(idf, examples, 0.3)
    for q in range(0, 500, 7):
        tf = {terms[j]: 1 + (q + j) % 2 for j in range(8) if (q >> (j % 4)) % 2} or {terms[0]: 1}
        vector = index.unit(tf)
        best = sorted((sum(w * index.unit(e[2]).get(t, 0) for t, w in vector.items()) for e in examples if e[0] != q), reverse=True)[: toxicity.K]
        at, cosine = index.nearest(tf, q)
        assert list(cosine) == pytest.approx([b for b in best if b > 0])


def test_html():
    page = "<html><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>One &amp; two<br>three<p>Four <b>five</b><script>var x='</p>'</script></article><div class='comments'><p>Nice post!</p></div><aside>More</aside><footer>End</footer>"
    _, edge = html_extraction.fit([])
    assert html_extraction.extract(page, {}, edge) == "Head\nOne & two three\nFour five"
    assert html_extraction.extract(None, {}, edge) == "" and html_extraction.extract("<", {}, edge) in ("", "<")


def test_html_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small tree."""
    import itertools

    import numpy as np

    nodes = html_extraction.parse("<div><p>a</p><nav>b<i>c</i></nav></div>")
    edge = np.array([[[0.9, 0.1], [0.3, 0.7]], [[0.85, 0.15], [0.4, 0.6]], [[0.8, 0.2], [0.25, 0.75]], [[0.7, 0.3], [0.45, 0.55]]])
    score = [sum(html_extraction.prior_mean(f) * x for f, x in html_extraction.node_features(nodes, i)) for i in range(len(nodes))]
    total, one = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        p = np.exp(sum(s * v for s, v in zip(score, y)))
        for i in range(1, len(nodes)):
            p *= edge[html_extraction.edge_kind(nodes, i), y[nodes[i].parent], y[i]]
        total += p
        one += p * np.array(y)
    assert html_extraction.marginals(nodes, {}, edge) == pytest.approx(list(one / total))


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs, budget_percent=150, epochs=2).collect()
    total = sum(len((r.text or "").split()) for r in docs.collect())
    assert abs(sum(r.taken for r in rows) - total * 150 // 100) <= 20
    assert all(0 < r.taken <= r.tokens for r in rows) and mixing.mix(none).count() == 0
    full = mixing.mix(docs, budget_percent=300, epochs=2).agg(F.sum("taken")).first()[0]
    assert full == 2 * total


def test_chat(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "bb"), (1, 2, None, None), (2, 0, "user", "alone"), (None, 0, "user", "x")]
    found = {r.pair_id: r for r in chat_format.format_preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(found) == {0, 1}
    r = found[0]
    assert r.n_prefix == 1 and r.prompt == "<|user|>\nhi<|end|>\n" and r.chosen == "<|assistant|>\na<|end|>\n"
    assert r.rejected[slice(*map(int, r.rejected_mask.split(":")))] == "bb<|end|>"
    assert found[1].prompt == "" and found[1].rejected == "" and found[1].n_rejected == 0


def test_pii(spark, docs, none):
    t = "é mail a.b@c.de_x@y.zz call +1 (555) 123-4567 or 4111 1111 1111 1111, ip 10.0.0.256 and 1.2.3.4.5.6.7.8 key = \"" + "0a" * 20 + "\" " + "9" * 20000
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(50, t)], "doc_id long, text string"))
    r = {x.doc_id: x for x in pii.personal_data(df).collect()}[50]
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    spans = [f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, t) if k == "email" or all(int(x) <= 255 for x in m[0].split("."))]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (2, 2, 1, 1)
    assert r.spans.startswith(",".join(spans))
    assert pii.personal_data(none).count() == 0
