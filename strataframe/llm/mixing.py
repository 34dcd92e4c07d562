"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strataframe.llm.common import WORD, table, text_of
from strataframe.runtime import cut, sized_broadcast

#: Seeded bins of a source.  A source's fraction ends inside one bin; only that bin is ordered.
BINS = 1024
#: Rows of a plan (sources times bins) that may be broadcast: about 100 MB.
PLAN_ROWS = 1_000_000


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def cyclic_weights(cycle: tuple[float, ...] = (5, 2, 1)) -> Column:
    """Weights that repeat over the sources in code point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int"))


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight)`` rows.

    The fixed point of clamping and resharing is a common level: every source gets
    ``min(max_epochs * size, level * weight)``.  Sources are put in the order in which a rising level
    meets their caps; running sums give, for each prefix of clamped sources, the level of the rest,
    and the first prefix whose level clamps nobody else is the answer.  One row per source, no loop.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = (
        sources.withColumn("cap", cap)
        .withColumn("below", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(whole).cast("double"))
        .withColumn("try", F.greatest((F.col("all") - F.col("below")) / F.col("heavy"), F.lit(0.0)))
        .withColumn("level", F.max(F.when(F.col("try") <= F.col("cap") / F.col("weight"), F.col("try"))).over(whole))
    )
    return filled.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))).drop("cap", "below", "heavy", "all", "try", "level")


def seeded(seed: int, key: str | Column = "doc_id") -> Column:
    """52 uniform bits from a document's id, the same in every run and engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(-1)).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def mix(docs: DataFrame, size: Column, weight: Column | None = None, max_epochs: float = 3.0, seed: int = 17, whole_documents: bool = False) -> DataFrame:
    """Take each source of ``docs (doc_id, source, ...)`` up to its share of all sizes; ``size`` measures a row.

    Adds ``size``, ``source_size``, ``target``, ``copies`` (repetitions, a last partial one included) and
    ``taken`` (size units taken); columns of these names are replaced, all others are kept.
    A source is repeated ``floor(target / size)`` times; the fraction left over is a seeded prefix of its
    documents in hash order.  The document at which the fraction ends gives only the units that are
    still missing; with ``whole_documents`` it is taken or left whole, whichever is nearer, and ``taken``
    is always a multiple of the size.  So a source misses its target by under one unit, or by half of one
    document.

    Null sources form a source of their own, sorted last; null sizes count as 0; a document of size 0
    follows the fraction as well; an empty table gives no rows; repeated rows are separate documents of
    the same hash, ordered by size.

    Hot sources are split into ``BINS`` seeded bins before anything is ordered.  Bins are summed per
    source (partial sums before the shuffle); the plan has a row per bin and is broadcast while it has
    at most ``PLAN_ROWS``, beyond which it is joined by a shuffle on source and bin.  Rows of bins that are
    taken or left as a whole never move; only the one bin of a source in which its fraction ends is
    shuffled and ordered.  Weights and levels are windows over one row per source.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    sized = F.coalesce(size, F.lit(0)).cast("long")
    rows = docs.withColumn("_size", sized).withColumn("_h", seeded(seed)).withColumn("_bin", F.shiftright("_h", 42).cast("int"))
    bins = cut(rows.groupBy("source", "_bin").agg(F.sum("_size").alias("_bin_size")))
    shares = bins.groupBy("source").agg(F.sum("_bin_size").alias("source_size"))
    shares = water_fill(shares.withColumn("weight", cyclic_weights() if weight is None else weight), max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = shares.withColumn("_whole", F.floor(rate)).withColumn("_part", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    before = F.sum("_bin_size").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bin_size")
    plan = cut(
        bins.withColumn("_before", before)
        .withColumnRenamed("source", "_s")
        .join(shares.withColumnRenamed("source", "_source"), F.col("_s").eqNullSafe(F.col("_source")))
        .select("_s", F.col("_bin").alias("_b"), F.col("source_size").alias("_total"), F.col("target").alias("_target"), "_whole", (F.col("_part") - F.col("_before")).alias("_left"), "_bin_size")
    )
    placed = rows.drop("_size").join(sized_broadcast(plan, plan.count(), PLAN_ROWS), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")), "left")
    ends = (F.col("_left") > 0) & (F.col("_left") < F.col("_bin_size"))
    sure = placed.where(~ends).withColumn("_size", sized).withColumn("_rest", F.when(F.col("_left") > 0, F.greatest(F.col("_size"), F.lit(1))).otherwise(F.lit(0)).cast("long"))
    ordered = Window.partitionBy("source", "_bin").orderBy("_h", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(ends).withColumn("_size", sized).withColumn("_rest", F.col("_left") - (F.sum("_size").over(ordered) - F.col("_size")))
    near = F.when(F.col("_rest") * 2 >= F.col("_size"), F.col("_size")).otherwise(F.lit(0)) if whole_documents else F.greatest(F.least("_rest", "_size"), F.lit(0))
    more = F.when(F.col("_size") == 0, F.col("_rest") > 0).otherwise(F.col("_extra") > 0)
    kept = [F.col(c) for c in docs.columns if c not in made]
    return (
        sure.unionByName(edge)
        .withColumn("_extra", near)
        .select(
            *kept,
            F.col("_size").alias("size"),
            F.col("_total").alias("source_size"),
            F.col("_target").alias("target"),
            (F.col("_whole") + more.cast("int")).cast("int").alias("copies"),
            (F.col("_whole") * F.col("_size") + F.col("_extra")).alias("taken"),
        )
    )


def repeated(docs: DataFrame, copies: str = "copies") -> DataFrame:
    """The rows of a mix, each as often as the mix takes it."""
    return docs.where(F.col(copies) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(copies)))).drop("_copy", copies)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, word_count("text")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('17:' || CAST(coalesce(doc_id, -1) AS VARCHAR)), 1, 13)) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap,
         coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below,
         sum(weight) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy,
         CAST(sum(source_size) OVER () AS DOUBLE) AS everything
  FROM s),
l AS (
  SELECT *, greatest((everything - below) / heavy, 0.0) AS attempt FROM o),
t AS (
  SELECT source, source_size,
         least(cap, coalesce(max(CASE WHEN attempt <= cap / weight THEN attempt END) OVER (), 0.0) * weight) AS target
  FROM l),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole,
         CAST(round(u.target - u.whole * u.source_size) AS BIGINT)
           - (sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size) AS rest
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(least(rest, size), 0) AS BIGINT) AS taken
FROM r
"""

QUERIES = {"op1_mixing": op1_mixing}
SQL = {"op1_mixing": OP1_SQL}
