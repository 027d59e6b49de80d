"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation becomes the prompt, rendered once; the rest of each is a masked completion.

Built from DataFrame functions alone, and by turns throughout: no conversation is
ever gathered into one row, so one of any length is dealt out like any other
rows. A segment is one rendered turn; segments of (pair, part) in the order of
(turn with nulls last, segment, copy), joined without anything between, give the
full text, and the characters from mask_start to mask_end are what is learned.
``preference_pairs`` joins them: a row a pair, with the prompt once and both
completions with their masks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

#: The chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
LAST_TURN = (1 << 63) - 1


def sided_by_id(turns: DataFrame) -> DataFrame:
    """An assumption, as the table names no pairs: neighbouring ids are the two answers to one prompt, the chosen an even one. Adds pair_id and chosen. The given table has no shared prompts under it; null ids are left out."""
    return turns.filter("conv_id is not null").withColumn("pair_id", F.shiftright("conv_id", 1)).withColumn("chosen", F.col("conv_id") % 2 == 0)


def preference_segments(turns: DataFrame) -> DataFrame:
    """turns: pair_id, chosen (boolean), turn, role, text. Returns pair_id, part, turn, role, copy, segment, mask_start, mask_end.

    part is prompt, chosen or rejected. Turns are equal if they hold the same
    roles and texts equally often; the prompt ends before the first turn that is
    not. A null role or text counts as empty, a null turn comes after all others
    (and is returned as null); repeated rows are rendered as often as they stand
    (copy 1, 2, ...). Pairs of which one side has no rows are not returned;
    equal conversations are all prompt. In a completion the assistant's text
    and its end mark are learned, in the prompt nothing (mask 0 to 0). Other
    columns are ignored; an empty table gives none.
    """
    rows = turns.select("pair_id", "chosen", F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    count = lambda flag: F.count(F.when(F.col("chosen") == flag, 1))
    both = stored(rows.groupBy("pair_id", "turn", "role", "text").agg(count(True).alias("n1"), count(False).alias("n0")), "preference")
    ends = both.groupBy("pair_id").agg(F.min(F.when(F.col("n1") != F.col("n0"), F.col("turn"))).alias("end"), F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))
    ends = ends.filter("s1 > 0 and s0 > 0").select("pair_id", "end")
    whole = both.join(ends, "pair_id")
    in_prompt = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    prompt = F.when(in_prompt, F.array(F.struct(F.lit("prompt").alias("part"), F.col("n1").alias("n"))))
    rest = F.array(F.struct(F.lit("chosen").alias("part"), F.col("n1").alias("n")), F.struct(F.lit("rejected").alias("part"), F.col("n0").alias("n")))
    parts = whole.select("pair_id", "turn", "role", "text", F.explode(F.coalesce(prompt, rest)).alias("p")).filter("p.n > 0")
    each = parts.select("pair_id", F.col("p.part").alias("part"), "turn", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.n"))).alias("copy"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"))
    segment = F.concat(head, F.col("text"), F.lit(CLOSE))
    learned = (F.col("part") != "prompt") & (F.col("role") == LEARNED)
    return each.select(
        "pair_id", "part", F.when(F.col("turn") != LAST_TURN, F.col("turn")).alias("turn"), "role", "copy", segment.alias("segment"),
        F.when(learned, F.char_length(head)).otherwise(0).cast("long").alias("mask_start"), F.when(learned, F.char_length(segment)).otherwise(0).cast("long").alias("mask_end"),
    )


#: Characters of a pair, of all its segments, that preference_pairs puts into one row.
LONGEST = 1 << 24


def preference_pairs(segments: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row a pair: pair_id, whole, n_chars, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Takes the result of preference_segments. A mask is an array of (start, end) in
    characters of its completion, what is learned. Parts without segments are
    empty texts. Of a pair of more than ``longest`` characters whole is false and
    texts and masks are null: such a pair is no row of bounded size, and its segments,
    which are in their order, are the way to read it. An empty table gives none.
    """
    sizes = segments.groupBy("pair_id").agg(F.sum(F.char_length("segment")).cast("long").alias("n_chars"))
    small = segments.join(sizes.filter(F.col("n_chars") <= longest).select("pair_id"), "pair_id", "left_semi")
    one = F.struct(F.coalesce("turn", F.lit(LAST_TURN)).alias("turn"), "segment", "copy", "mask_start", "mask_end")
    each = small.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(one)).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["segment"]), "")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

    def step(a, x):
        span = F.struct((a["at"] + x["mask_start"]).alias("start"), (a["at"] + x["mask_end"]).alias("end"))
        return F.struct((a["at"] + F.char_length(x["segment"])).cast("long").alias("at"), F.when(x["mask_end"] > 0, F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

    parts = each.select("pair_id", "part", text.alias("text"), F.aggregate("s", start, step)["found"].alias("mask"))
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    joined = parts.groupBy("pair_id").agg(*[F.coalesce(of(p, "text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")], *[F.coalesce(F.first(F.when(F.col("part") == p, F.col("mask")), ignorenulls=True), none).alias(f"{p}_mask") for p in ("chosen", "rejected")])
    return sizes.join(joined, "pair_id", "left").select("pair_id", (F.col("n_chars") <= longest).alias("whole"), "n_chars", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_segments(sided_by_id(read_table(spark, sf_dir, "conversations")))


SQL = {
    "op3_preference": """
WITH r AS (
  SELECT conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), g AS (
  SELECT pair_id, turn, role, text, count(*) FILTER (chosen) AS n1, count(*) FILTER (NOT chosen) AS n0 FROM r GROUP BY ALL
), e AS (
  SELECT pair_id, min(coalesce(turn, 9223372036854775807)) FILTER (n1 <> n0) AS stop FROM g GROUP BY pair_id HAVING sum(n1) > 0 AND sum(n0) > 0
), p AS (
  SELECT pair_id, 'prompt' AS part, turn, role, text, n1 AS n FROM g JOIN e USING (pair_id) WHERE stop IS NULL OR coalesce(turn, 9223372036854775807) < stop
  UNION ALL SELECT pair_id, 'chosen', turn, role, text, n1 FROM g JOIN e USING (pair_id) WHERE coalesce(turn, 9223372036854775807) >= stop AND n1 > 0
  UNION ALL SELECT pair_id, 'rejected', turn, role, text, n0 FROM g JOIN e USING (pair_id) WHERE coalesce(turn, 9223372036854775807) >= stop AND n0 > 0
), s AS (
  SELECT pair_id, part, turn, role, unnest(range(1, n + 1)) AS copy, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS segment FROM p
)
SELECT pair_id, part, turn, role, copy, segment,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN CAST(length('<|im_start|>' || role || chr(10)) AS BIGINT) ELSE 0 END AS mask_start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN CAST(length(segment) AS BIGINT) ELSE 0 END AS mask_end
FROM s
""",
}
QUERIES = {"op3_preference": op3_preference}
