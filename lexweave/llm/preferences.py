"""Preference formatting of chat turns, in DataFrame functions only.

The chosen and the rejected conversation of a pair share a longest common prefix of turns (equal role
and text). It is rendered once as the prompt; the turns after it are the two completions. A turn is
rendered as `<|role|>\\ntext<|end|>\\n`. Of a completion only what an assistant says is learnt: `*_spans`
lists start:end (code points, end exclusive) of the text and end mark of its assistant turns; all else is masked.

Turns are ordered by number, then role and text, nulls first; repeated turns stay. Turns without a
conversation id belong to none. Null roles and texts render as empty. A rejected id that is null or
unknown has no turns, and the prompt is then the chosen conversation without its last turn.
Other columns of the turns are ignored; those of `pairs` pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

END = "<|end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row a conversation, which is one example and meets in one task."""
    rows = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def pair_by_opening(found: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): conversations with the same first turn; the least id is chosen against each of the others.

    A conversation alone is chosen against none. Pairs grow with the conversations, not with the square of a group.
    """
    opening = F.md5(F.to_json(F.element_at("turns", 1), {"ignoreNullFields": "false"}).cast("binary"))
    keyed = found.select("conv_id", opening.alias("opening"))
    groups = keyed.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n"))
    others = keyed.join(groups, "opening").filter((F.col("conv_id") != F.col("chosen_id")) | (F.col("n") == 1))
    return others.select("chosen_id", F.when(F.col("n") > 1, F.col("conv_id")).alias("rejected_id"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit(f"{END}\n"))


def _spans(turns: Column) -> Column:
    head = lambda t: F.length(F.coalesce(t["role"], F.lit(""))) + 5
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        end = s["at"] + F.length(_turn(t))
        span = F.concat_ws(":", s["at"] + head(t), end - 1)
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    return F.aggregate(turns, begin, step, lambda s: F.array_join(s["out"], ","))


def format_pairs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` (chosen_id, rejected_id) with n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    side = lambda name: found.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(f"_{name}"))
    with_chosen = pairs.join(side("chosen"), "chosen_id")
    # Pairs without a rejected side stay out of the join: null keys would all meet in one task.
    alone = with_chosen.filter("rejected_id is null").withColumn("_rejected", F.lit(None).cast(found.schema["turns"].dataType))
    both = with_chosen.filter("rejected_id is not null").join(side("rejected"), "rejected_id", "left").unionByName(alone)
    same = F.zip_with("_chosen", "_rejected", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    apart = F.array_position(same, False)
    common = F.when(F.col("_rejected").isNull(), F.size("_chosen") - 1).when(apart > 0, apart - 1).otherwise(F.size("_chosen")).cast("int")
    cut = both.withColumn("_n", common).withColumns({"_rest": F.slice("_chosen", F.col("_n") + 1, F.size("_chosen")), "_other": F.coalesce(F.slice("_rejected", F.col("_n") + 1, F.greatest(F.size("_rejected"), F.lit(0))), F.slice("_chosen", F.lit(1), F.lit(0)))})
    return cut.select(*pairs.columns, F.col("_n").cast("long").alias("n_prompt_turns"), _render(F.slice("_chosen", F.lit(1), F.col("_n"))).alias("prompt"), _render(F.col("_rest")).alias("chosen"), _render(F.col("_other")).alias("rejected"), _spans(F.col("_rest")).alias("chosen_spans"), _spans(F.col("_other")).alias("rejected_spans"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations(read(spark, sf_dir, "conversations"))
    return format_pairs(found, pair_by_opening(found))


ORACLE = r"""
WITH conv AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
grp AS (SELECT turns[1] AS opening, min(conv_id) AS chosen_id, count(*) AS n FROM conv GROUP BY 1),
pairs AS (
  SELECT g.chosen_id, CASE WHEN g.n > 1 THEN c.conv_id END AS rejected_id
  FROM conv c JOIN grp g ON c.turns[1] IS NOT DISTINCT FROM g.opening WHERE c.conv_id <> g.chosen_id OR g.n = 1),
both_ AS (
  SELECT p.*, a.turns AS ct, b.turns AS rt FROM pairs p JOIN conv a ON a.conv_id = p.chosen_id LEFT JOIN conv b ON b.conv_id = p.rejected_id),
lcp AS (
  SELECT *, CASE WHEN rt IS NULL THEN len(ct) - 1 ELSE
    coalesce(list_min(list_filter(range(1, greatest(len(ct), len(rt)) + 1), lambda i: i > len(ct) OR i > len(rt) OR ct[i] IS DISTINCT FROM rt[i])) - 1, len(ct)) END AS n
  FROM both_),
turns AS (
  SELECT chosen_id, rejected_id, n, side, i, t, '<|' || coalesce(t.role, '') || '|>' || chr(10) AS head,
         '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10) AS s
  FROM (SELECT chosen_id, rejected_id, n, 'c' AS side, unnest(range(1, len(ct) + 1)) AS i, unnest(ct) AS t FROM lcp
        UNION ALL SELECT chosen_id, rejected_id, n, 'r', unnest(range(1, len(rt) + 1)), unnest(rt) FROM lcp WHERE rt IS NOT NULL)),
placed AS (
  SELECT *, coalesce(sum(CASE WHEN i > n THEN length(s) END) OVER (PARTITION BY chosen_id, rejected_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM turns)
SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 'c' AND i <= n), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected,
  coalesce(string_agg(CAST(CAST(before_ + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(before_ + length(s) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (side = 'c' AND i > n AND t.role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(CAST(before_ + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(before_ + length(s) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (side = 'r' AND i > n AND t.role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY chosen_id, rejected_id, n
"""
