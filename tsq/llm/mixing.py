"""Mixing sources to target weights.

Every document gets a hash-random key. Inside a source the keys are range-partitioned into fixed slices
(the leading hex digits of the key) and sorted within a slice; prefix sums of the sizes are built in two
levels, per slice and over the slice totals, so no task ever holds a whole source. Each source is cut at
its exact word budget: whole epochs first, then a prefix of the key order, splitting the document at the cut.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null or repeated
ids keep one row each (rows that tie in every column are interchangeable); an empty table gives no rows;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsq.llm.common import read_documents, stage_table, text_of, word_count

SLICE_DIGITS = 3


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets by source from ``(skey, source_size)``: weights repeat in key order, none above ``most`` times its size.

    The excess of capped sources goes to the others by weight; the fixed point is one water level, found by
    sorting the sources by cap / weight. The table has one row per source.
    """
    by_key = Window.orderBy("skey")
    ranked = sizes.withColumn("rank", F.row_number().over(by_key)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy("ratio", "rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranked.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole))
        .withColumn("target", F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(F.col("water.level") * F.col("weight")))
        .select("skey", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` counts the words the mix takes from the document, repeats included; a source's sum is its rounded target.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("b")).alias("skey"),
        word_count(text_of(text_col)).alias("size"),
        key.alias("key"),
    )
    rows = stage_table(rows, "mix").withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = rows.groupBy("skey", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    offsets = slices.withColumn("offset", F.sum("slice_size").over(earlier) - F.col("slice_size")).drop("slice_size")
    targets = source_targets(
        slices.groupBy("skey").agg(F.sum("slice_size").alias("source_size")), weights, share, most
    )
    plan = (
        offsets.join(targets, "skey")
        .withColumn("goal", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    )
    inside = Window.partitionBy("skey", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("rest") - F.col("offset") - F.col("upto") + F.col("size")
    return (
        rows.withColumn("upto", F.sum("size").over(inside))
        .join(plan, ["skey", "slice"])
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).alias("taken"),
        )
    )


def op2_mix_sources(spark, sf_dir):
    return mix_sources(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
r AS (SELECT *, row_number() OVER (ORDER BY skey) AS rank FROM s),
w AS (SELECT *, CAST([3, 1, 2][((rank - 1) % 3) + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
o AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS budget FROM w),
l AS (SELECT *, (budget - (sum(cap) OVER (ORDER BY ratio, rank) - cap))
             / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT skey, source_size, CASE WHEN level > ratio THEN cap
             ELSE weight * (SELECT arg_min(level, (ratio, rank)) FROM l WHERE level <= ratio) END AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS goal,
             CAST(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
      FROM d JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size
            + greatest(0, least(size, goal % source_size - before)) END AS BIGINT) AS taken
FROM p
"""
