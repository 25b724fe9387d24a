"""Mixing sources to target weights, in DataFrame functions only.

Leaves are (domain, lang, source). A budget of tokens flows down the tree by
weight: each node's budget is dealt to its children in proportion to their
weights, but none gets more than it can supply (its tokens times `epochs`).
What a child cannot use goes to its siblings, again by weight; only when all
children of a node are full does the rest go to the node's own siblings, since
a node's supply bounds its share one level up. A leaf then takes documents in
the order of a seeded hash, epoch after epoch, until its budget is met; the
last one is cut to the tokens that are left.

All amounts are integers: shares are rounded down, so that a level may leave
fewer tokens than it has nodes unspent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD, stage

SEED, EPOCHS = 7, 2
#: The budget, in percent of the tokens there are, and the weights of languages; others weigh LANG_DEFAULT.
BUDGET_PERCENT = 60
LANG_WEIGHTS, LANG_DEFAULT = {"en": 40, "de": 25, "fr": 20, "es": 15}, 10
#: Rows of a leaf that are put in order together, on average; only the bucket in which the budget ends is.
BUCKET_ROWS = 4096
_LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """The default domain of a source: one of four, by a hash of its name."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(source), 1, 4), 16, 10).cast("int") % 4).cast("string"))


def deal(nodes: DataFrame, keys: list[str], parent: list[str], budgets: DataFrame) -> DataFrame:
    """`budgets` (parent columns, `budget`) dealt to `nodes` (keys, `weight`, `supply`): adds `budget` to the nodes.

    In order of supply per weight, a child whose fair share of what is left
    exceeds its supply is full; the first one that isn't, and all after it,
    share the rest by weight. A weight of 0 gets nothing. The order is exact for
    weights below 2^26: wholes first, then what is left, of which different ones differ as doubles.
    """
    rows = nodes.join(budgets.withColumnRenamed("budget", "given"), parent) if parent else nodes.crossJoin(F.broadcast(budgets.withColumnRenamed("budget", "given")))
    rows = rows.where("weight > 0")
    order = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(F.expr("supply div weight"), F.expr("CAST(supply % weight AS DOUBLE) / weight"), *[F.col(k) for k in keys])
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left_tokens", F.col("given") - F.coalesce(F.sum("supply").over(before), F.lit(0)))
    rows = rows.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("full", F.expr("CAST(left_tokens AS DECIMAL(38,0)) * weight >= CAST(supply AS DECIMAL(38,0)) * left_weight"))
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("stop", F.min(F.when(~F.col("full"), F.struct("rank", "left_tokens", "left_weight"))).over(whole))
    share = F.expr("CAST(CAST(stop.left_tokens AS DECIMAL(38,0)) * weight div stop.left_weight AS BIGINT)")
    return rows.withColumn("budget", F.when(F.col("stop").isNull() | (F.col("rank") < F.col("stop.rank")), F.col("supply")).otherwise(F.least("supply", share))).select(*keys, "weight", "supply", "budget")


def weighted(nodes: DataFrame, keys: list[str], weights: DataFrame | None, default: Column) -> DataFrame:
    """`nodes` with `weight`: that of the row of `weights` which names just `keys`, else `default`."""
    if weights is None:
        return nodes.withColumn("weight", default)
    named = weights.where(" AND ".join(f"{k} IS {'NOT ' if k in keys else ''}NULL" for k in _LEAF))
    named = named.groupBy(*keys).agg(F.max(F.greatest(F.coalesce(F.col("weight").cast("long"), F.lit(0)), F.lit(0))).alias("weight"))
    return nodes.join(named, keys, "left").withColumn("weight", F.coalesce("weight", default.cast("long")))


def leaf_budgets(leaves: DataFrame, budget: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(domain, lang, source, budget) from `leaves` (domain, lang, source, supply) and the one-row `budget`.

    `weights` (domain, lang, source, weight) is a table of target weights, whole numbers. A row whose lang and source are null
    weighs a domain against the others, one whose source is null a language within its domain, a full one a
    source within both. A weight of 0, below 0 or null gives nothing; of repeated rows the largest holds. Nodes without a row have the default:
    LANG_WEIGHTS for languages, 1 for domains and sources, which is all that counts if there is no table.
    """
    langs = leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply"))
    domains = langs.groupBy("domain").agg(F.sum("supply").alias("supply"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in LANG_WEIGHTS.items() for x in kv])[F.col("lang")], F.lit(LANG_DEFAULT))
    dealt = deal(weighted(domains, ["domain"], weights, F.lit(1)), ["domain"], [], budget)
    dealt = deal(weighted(langs, ["domain", "lang"], weights, weight), ["domain", "lang"], ["domain"], dealt.select("domain", "budget"))
    return deal(weighted(leaves, _LEAF, weights, F.lit(1)), _LEAF, ["domain", "lang"], dealt.select("domain", "lang", "budget")).select(*_LEAF, "budget")


def mix(
    docs: DataFrame,
    budget_percent: int = BUDGET_PERCENT,
    epochs: int = EPOCHS,
    seed: int = SEED,
    weights: DataFrame | None = None,
    carry: bool = False,
    domain: Column | str | None = None,
) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens, taken): a row for each document and epoch that is taken.

    `domain` is the column or expression of `docs` that names a document's domain,
    to which `weights` can refer; null is named "". Without it, sources are dealt
    to four by a hash of their names. `weights` is a table of target weights (see leaf_budgets). With `carry` the whole row of `docs` comes along as `_row`.

    Tokens are runs of anything but blanks. Null languages and sources are
    named "". Texts without tokens, null ones included, supply nothing and are
    never taken. In an epoch, documents follow the MD5 of seed, epoch and
    doc_id (of its text's MD5 if it has none), ties by doc_id and then by MD5 of the text; rows equal in all of
    these are taken in no particular order, with equal tokens.
    """
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    kept = ["_row"] if carry else []
    digest = F.md5(F.coalesce("text", F.lit(""))).alias("digest")
    given = F.col(domain) if isinstance(domain, str) else domain
    given = domain_of(F.coalesce(F.col("source"), F.lit(""))) if given is None else F.coalesce(given.cast("string"), F.lit(""))
    rows = docs.select(*own, "doc_id", given.alias("domain"), name("lang"), name("source"), tokens.alias("tokens"), digest).where("tokens > 0")
    rows = stage(rows, "tokens")
    leaves = rows.groupBy(*_LEAF).agg(F.sum("tokens").alias("size"), F.count("*").alias("n"))
    leaves = stage(leaves.withColumn("supply", F.col("size") * epochs), "leaves")
    budget = leaves.agg(F.expr(f"coalesce(sum(size), 0) * {int(budget_percent)} div 100").alias("budget"))
    plan = leaf_budgets(leaves.select(*_LEAF, "supply"), budget, weights).join(leaves, _LEAF)
    plan = plan.where("budget > 0").select(*_LEAF, F.expr("budget div size").alias("whole"), F.expr("budget % size").alias("rest"), F.expr(f"greatest(1, n div {BUCKET_ROWS})").alias("buckets"))
    plan = stage(plan, "plan")

    rows = rows.join(plan, _LEAF)
    full = rows.where("whole > 0").select(*kept, "doc_id", *_LEAF, F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("epoch"), "tokens", F.col("tokens").alias("taken"))

    # The epoch that the budget ends in: sums by hash bucket find the bucket; only its rows are put in order.
    own_name = F.coalesce(F.col("doc_id").cast("string"), F.col("digest"))  # texts stand for missing ids, so that these don't all come together
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), own_name))
    part = rows.where("rest > 0").withColumn("turn", turn).withColumn("bucket", F.expr("conv(substr(turn, 1, 8), 16, 10) * buckets div 4294967296").cast("long"))
    sums = part.groupBy(*_LEAF, "bucket").agg(F.sum("tokens").alias("sum"))
    order = Window.partitionBy(*_LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(order), F.lit(0)))
    part = part.join(stage(sums, "sums"), [*_LEAF, "bucket"]).where("before < rest")
    inside = part.where("before + sum <= rest").withColumn("taken", F.col("tokens"))
    order = Window.partitionBy(*_LEAF, "bucket").orderBy("turn", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    edge = part.where("before + sum > rest").withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    edge = edge.where("start < rest").withColumn("taken", F.least("tokens", F.col("rest") - F.col("start")))
    cols = [*kept, "doc_id", *_LEAF, F.col("whole").cast("int").alias("epoch"), "tokens", "taken"]
    return full.unionByName(inside.select(*cols)).unionByName(edge.select(*cols))


#: DuckDB: the same, with the tree dealt level by level and one running sum for each leaf.
def mix_sql(documents: str = "documents", budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> str:
    weight = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items()) + f" ELSE {LANG_DEFAULT} END"

    def level(name: str, nodes: str, keys: str, parent: str, budgets: str) -> str:
        on = " AND ".join(f"n.{k} = b.{k}" for k in parent.split(", ") if k) or "true"
        by = "PARTITION BY " + ", ".join(f"n.{k}" for k in parent.split(", ")) if parent else ""
        order = f"{by} ORDER BY n.supply // n.weight, (n.supply % n.weight)::DOUBLE / n.weight, " + ", ".join(f"n.{k}" for k in keys.split(", "))
        up = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_0 AS (SELECT n.*, b.budget - coalesce(sum(n.supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt,
    sum(n.weight) OVER ({by}) - coalesce(sum(n.weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw,
    row_number() OVER w AS rank FROM {nodes} n JOIN {budgets} b ON {on} WHERE n.weight > 0 WINDOW w AS ({order})),
{name}_1 AS (SELECT *, min(CASE WHEN lt * weight < supply::HUGEINT * lw THEN rank END) OVER ({up}) AS stop FROM {name}_0),
{name}_2 AS (SELECT *, max(CASE WHEN rank = stop THEN lt END) OVER ({up}) AS slt, max(CASE WHEN rank = stop THEN lw END) OVER ({up}) AS slw FROM {name}_1),
{name} AS (SELECT * EXCLUDE (lt, lw, rank, stop, slt, slw), CASE WHEN stop IS NULL OR rank < stop THEN supply ELSE least(supply, slt * weight // slw) END AS budget FROM {name}_2)"""

    return f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS tokens, md5(coalesce(text, '')) AS digest FROM {documents}),
named AS (SELECT *, 'domain' || (('0x' || substr(md5(source), 1, 4))::INTEGER % 4) AS domain FROM docs WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens) AS size, sum(tokens) * {epochs} AS supply, 1 AS weight FROM named GROUP BY ALL),
langs AS (SELECT domain, lang, sum(supply) AS supply, {weight} AS weight FROM leaves GROUP BY domain, lang),
domains AS (SELECT domain, sum(supply) AS supply, 1 AS weight FROM langs GROUP BY domain),
total AS (SELECT sum(size) * {budget_percent} // 100 AS budget FROM leaves),
{level('bd', 'domains', 'domain', '', 'total')},
{level('bl', 'langs', 'domain, lang', 'domain', 'bd')},
{level('bs', 'leaves', 'domain, lang, source', 'domain, lang', 'bl')},
epochs AS (SELECT n.*, e.epoch, b.budget, b.size FROM named n JOIN bs b USING (domain, lang, source), (SELECT unnest(range({epochs})) AS epoch) e WHERE e.epoch * b.size < b.budget),
placed AS (SELECT *, epoch * size + coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, digest)), doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM epochs)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, tokens::BIGINT AS tokens, least(tokens, budget - start)::BIGINT AS taken FROM placed WHERE start < budget
"""


def prefix_of(text: Column, tokens: Column) -> Column:
    """The first `tokens` tokens of a text and the blanks before and between them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"(?:{BLANKS})?{WORD}"), F.lit(0)), F.lit(1), tokens.cast("int")), "")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the corpus to train on, a row for each document and epoch taken.

    All columns of the documents, then epoch, tokens and taken, with mix_ before a name that is taken. Where a budget ends within a document, its text is cut to the tokens taken.
    """
    taken = mix(docs, carry=True)
    whole = F.col("_row.text")
    text = F.when(F.col("taken") < F.col("tokens"), prefix_of(whole, F.col("taken"))).otherwise(whole)
    own = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    names = {c: c for c in ("epoch", "tokens", "taken")}
    for c in names:
        while names[c] in docs.columns:
            names[c] = f"mix_{names[c]}"
    return taken.select(*own, *[F.col(c).alias(name) for c, name in names.items()])
