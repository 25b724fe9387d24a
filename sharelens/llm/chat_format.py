"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common prefix of the two conversations' turns (equal role and text)
is rendered once as the prompt; what follows in each is its completion. The
mask of a completion lists what is trained on: the text and end mark of the
assistant's turns, as code-point spans start:end in the completion.

Marks begin with "<|". Where a role or text has these characters, they are
rendered as "< |", so that what a user writes can't forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_totals

START, MIDDLE, END, ESCAPED = "<|", "|>\n", "<|end|>\n", "< |"
TRAINED_ROLE = "assistant"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def _mask(turns: Column) -> Column:
    head = lambda t: F.length(F.concat(F.lit(START), t["role"], F.lit(MIDDLE)))
    ends = running_totals(F.transform(turns, lambda t: F.length(_render(t)).cast("long")))

    def span(t: Column, end: Column) -> Column:
        """The line break after the end mark is not trained on; null for turns that aren't."""
        begin = end - F.length(_render(t)) + head(t)
        return F.when(t["role"] == TRAINED_ROLE, F.concat_ws(":", begin.cast("string"), (end - 1).cast("string")))

    return F.array_join(F.array_compact(F.zip_with(turns, ends, span)), ",")


def format_preferences(conversations: DataFrame) -> DataFrame:
    """(pair_id, n_chosen, n_rejected, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask), a row for each pair.

    Conversations 2k and 2k + 1 are the chosen and the rejected one of pair k;
    where one is missing it has no turns, so the prefix is empty. Turns are
    ordered by turn, role and text, nulls first; repeated turns count as often
    as they occur. A null role or text is empty; rows without conv_id belong to
    no conversation and are left out. A conversation is one rendered text, so
    it is the unit that a task holds. Equal conversations have empty completions.
    """
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(START), F.lit(ESCAPED)).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", plain("role"), plain("text"))
    pairs = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("side", "turn", "role", "text"))).alias("turns"))
    side = lambda k: F.transform(F.filter("turns", lambda t: t["side"] == k), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    pairs = pairs.select("pair_id", side(0).alias("c"), side(1).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int"))
    tail = lambda k: F.slice(k, F.col("n") + 1, F.greatest(F.size(k) - F.col("n"), F.lit(0)))
    text = lambda turns: F.array_join(F.transform(turns, _render), "")
    return pairs.select(
        "pair_id", F.size("c").alias("n_chosen"), F.size("r").alias("n_rejected"), F.col("n").alias("n_prefix"),
        text(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), text(tail("c")).alias("chosen"), text(tail("r")).alias("rejected"),
        _mask(tail("c")).alias("chosen_mask"), _mask(tail("r")).alias("rejected_mask"),
    )


def format_sql(conversations: str = "conversations") -> str:
    def side(k: int) -> str:
        return f"SELECT pair_id, i, role, text, '{START}' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM turns WHERE side = {k}"

    def part(name: str, source: str, keep: str) -> str:
        return f"""{name} AS (SELECT pair_id, string_agg(shown, '' ORDER BY i) AS shown, string_agg(CASE WHEN role = '{TRAINED_ROLE}' THEN (upto - length(shown) + {len(START) + len(MIDDLE)} + length(role)) || ':' || (upto - 1) END, ',' ORDER BY i) AS mask
    FROM (SELECT s.*, sum(length(s.shown)) OVER (PARTITION BY s.pair_id ORDER BY s.i) AS upto FROM {source} s JOIN prefix p USING (pair_id) WHERE {keep}) GROUP BY pair_id)"""

    return f"""
WITH turns AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role, text
    FROM (SELECT conv_id, turn, replace(coalesce(role, ''), '{START}', '{ESCAPED}') AS role, replace(coalesce(text, ''), '{START}', '{ESCAPED}') AS text FROM {conversations} WHERE conv_id IS NOT NULL)),
c AS ({side(0)}), r AS ({side(1)}),
sizes AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM turns GROUP BY pair_id),
differ AS (SELECT pair_id, min(i) AS i FROM (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i, c.role = r.role AND c.text = r.text AS same FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.i = r.i) WHERE same IS NOT TRUE GROUP BY pair_id),
prefix AS (SELECT s.*, coalesce(d.i - 1, s.nc) AS n FROM sizes s LEFT JOIN differ d USING (pair_id)),
{part('pr', 'c', 's.i <= p.n')}, {part('ch', 'c', 's.i > p.n')}, {part('re', 'r', 's.i > p.n')}
SELECT p.pair_id::BIGINT AS pair_id, nc::INTEGER AS n_chosen, nr::INTEGER AS n_rejected, n::INTEGER AS n_prefix, coalesce(pr.shown, '') AS prompt, coalesce(ch.shown, '') AS chosen, coalesce(re.shown, '') AS rejected,
    coalesce(ch.mask, '') AS chosen_mask, coalesce(re.mask, '') AS rejected_mask
FROM prefix p LEFT JOIN pr USING (pair_id) LEFT JOIN ch USING (pair_id) LEFT JOIN re USING (pair_id)
"""
