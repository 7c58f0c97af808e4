"""Perspective rotation of dialogues with several parties, with loss masks.

For every participant of a conversation (each distinct role but the narrators, by default "system") the dialogue is
rendered once: the participant's turns as assistant, the others' as user with their name, the narrators' as system.
A rendering comes in rows of BLOCK turns: its texts put together in the order of `block` are the whole dialogue. The mask
lists the spans of characters, "from-to" joined by commas, that the participant said, end marker included; they count from
the start of the whole rendering, so the masks of its rows joined by commas (empty ones left out) are the whole mask.

DataFrame functions only. Turns are numbered through by a sort over ranges and the ranges' counts, so no task gathers or
sorts a whole conversation; rows of BLOCK turns are bounded; where each of them begins in a rendering follows from running
sums of sizes, one narrow row for a participant and block. The same at every size of a conversation.

Edge cases: turns order by number (null first), then role (null first), then text; equal rows are all kept; a null text is
empty; a turn without role is a nameless user and no participant; a null conv_id is a conversation of its own; a
conversation of narrators only has no perspective; markers inside a text or role are broken by a space, and line ends in a
role become spaces, so that neither can end or begin a turn; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

BLOCK = 64


def _same(*names: str) -> F.Column:
    """Equality of a's and b's columns, null to null."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    return out


def _broken(text: F.Column) -> F.Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, rank: the place of each turn in its conversation, from 0."""
    # equal rows become one with a count before they are dealt out by range, and are told apart by a number then
    rows = (
        turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", _broken(F.coalesce("text", F.lit(""))).alias("text"))
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies") - F.col("run") * BLOCK, F.lit(BLOCK).cast("long")))))
        .drop("copies")
    )
    order = ("turn", "role", "text", "run", "copy")
    ranged = cut(rows.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order)) - 1
    return ranged.withColumn("own", own).alias("a").join(before.alias("b"), _same("conv_id", "range")).select("a.conv_id", "a.role", "a.text", (F.col("b.before") + F.col("a.own")).alias("rank"))


def perspectives(turns: DataFrame, narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """Input: conv_id, turn, role, text. One row per conversation, participant and block of BLOCK turns: text, mask, n_turns, n_masked."""
    name = F.when(F.col("role").isNull(), "user").when(F.col("role").isin(*narrators), "system").otherwise(F.concat(F.lit("user name="), F.translate(_broken(F.col("role")), "\n\r", "  ")))
    turn = F.struct("rank", "role", name.alias("name"), F.concat(F.lit("\n"), F.col("text"), F.lit("<|im_end|>")).alias("body"))
    blocks = cut(
        _numbered(turns)
        .groupBy("conv_id", F.floor(F.col("rank") / BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(turn)).alias("said"))
    )
    start, end = "<|im_start|>", "\n"
    speakers = turns.where(F.col("role").isNotNull() & ~F.col("role").isin(*narrators)).select("conv_id", F.col("role").alias("participant")).distinct()

    # where a block begins in the rendering of each participant: sizes as seen by others, and what the own turns differ by
    length = lambda t: len(start) + F.length(t["name"]) + F.length(t["body"]) + len(end)
    sizes = blocks.select("conv_id", "block", F.aggregate("said", F.lit(0).cast("long"), lambda acc, t: acc + length(t)).alias("size"))
    one = blocks.select("conv_id", "block", F.explode("said").alias("t")).select("conv_id", "block", "t.role", (len("assistant") - F.length("t.name")).alias("less"))
    owned = one.groupBy("conv_id", "block", "role").agg(F.sum("less").alias("less"))
    dense = sizes.alias("a").join(speakers.alias("b"), _same("conv_id")).select("a.*", "b.participant").alias("a")
    seen = dense.join(owned.alias("b"), _same("conv_id", "block") & (F.col("a.participant") == F.col("b.role")), "left").select("a.*", (F.col("a.size") + F.coalesce("b.less", F.lit(0))).alias("own_size"))
    earlier = Window.partitionBy("conv_id", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = seen.select("conv_id", "participant", "block", F.coalesce(F.sum("own_size").over(earlier), F.lit(0)).alias("begin"))

    own = lambda t: F.coalesce(t["role"] == F.col("participant"), F.lit(False))
    pieces = F.transform("said", lambda t: F.struct(F.when(own(t), "assistant").otherwise(t["name"]).alias("name"), t["body"].alias("body"), own(t).alias("own")))

    def step(acc: F.Column, p: F.Column) -> F.Column:
        begin = acc["at"] + len(start) + F.length(p["name"]) + 1
        after = begin + F.length(p["body"]) - 1
        spans = F.when(p["own"], F.concat(acc["spans"], F.array(F.concat_ws("-", begin.cast("string"), after.cast("string"))))).otherwise(acc["spans"])
        return F.struct((after + len(end)).alias("at"), spans.alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.col("begin").alias("at"), F.array().cast("array<string>").alias("spans")), step, lambda acc: acc["spans"])
    rows = blocks.alias("a").join(begins.alias("b"), _same("conv_id", "block")).select("a.*", "b.participant", "b.begin").withColumn("pieces", pieces)
    return rows.select(
        "conv_id",
        "participant",
        "block",
        F.array_join(F.transform("pieces", lambda p: F.concat(F.lit(start), p["name"], p["body"], F.lit(end))), "").alias("text"),
        F.array_join(spans, ",").alias("mask"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_masked"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS rank FROM t
), speakers AS (
  SELECT DISTINCT conv_id, role AS participant FROM t WHERE role IS NOT NULL AND role <> 'system'
), r AS (
  SELECT n.conv_id, s.participant, n.rank,
    '<|im_start|>' || CASE WHEN n.role IS NULL THEN 'user' WHEN n.role = s.participant THEN 'assistant' WHEN n.role = 'system' THEN 'system'
      ELSE 'user name=' || replace(replace(replace(n.role, '<|im_', '<| im_'), chr(10), ' '), chr(13), ' ') END || chr(10) AS head,
    n.text || '<|im_end|>' AS body, coalesce(n.role = s.participant, false) AS own
  FROM n JOIN speakers s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin_at
  FROM r WINDOW w AS (PARTITION BY conv_id, participant ORDER BY rank)
)
SELECT conv_id, participant, CAST(rank // 64 AS BIGINT) AS block, string_agg(head || body || chr(10), '' ORDER BY rank) AS text,
  coalesce(string_agg(CAST(CAST(begin_at AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begin_at AS BIGINT) + length(body) AS VARCHAR), ',' ORDER BY rank) FILTER (own), '') AS mask,
  count(*) AS n_turns, count(*) FILTER (own) AS n_masked
FROM p GROUP BY conv_id, participant, rank // 64
"""
