"""Mixing sources to target weights by hash-threshold histograms.

Each source's share of all words is its target. What a source has below its target is
repeated whole; for the part that remains, words are summed by source and hash bucket,
the bucket in which the budget ends is found from these sums, and only its documents are
summed again by finer buckets, until the bucket is a single hash. Documents with a hash
below that threshold are taken once more. Documents are never sorted, and a larger
budget takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texspark.llm.common import saved, table

#: Bits of the hash, and those that one histogram tells apart.
HASH_BITS, LEVEL_BITS = 52, 13
#: Sources, those with most documents, whose rows are broadcast (some 60 bytes each); documents of others are dealt out by source.
HOT_SOURCES = 1 << 16
#: A document is taken this many times at most.
MOST = 3


def water_level(sources: DataFrame, most: int = MOST) -> float:
    """The level at which sum(min(most * n, level * weight)) over sources (n, weight) is sum(n).

    Each round caps the sources that the level before exceeds; one row reaches the driver.
    """
    total = sources.agg(F.sum("n").alias("n")).first().n or 0
    level = 0.0
    while True:
        over = F.col("weight") * level > most * F.col("n")
        row = sources.agg(F.sum(F.when(over, most * F.col("n"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        higher = (total - (row.capped or 0)) / row.weight if row.weight else level
        if higher <= level:
            return level
        level = higher


def in_order(sources: DataFrame) -> DataFrame:
    """sources with rank, their place (from 0) in the order of _key: sorted by ranges, none of them in one task."""
    parts = max(1, sources.sparkSession.sparkContext.defaultParallelism)
    ranged = saved(sources.repartitionByRange(parts, F.col("_key").cast("binary")).withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    begins = ranged.groupBy("_part").agg(F.count("*").alias("rows")).withColumn("begin", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    return ranged.withColumn("at", F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_key").cast("binary")))).join(F.broadcast(begins), "_part").withColumn("rank", F.col("begin") + F.col("at") - 1).drop("_part", "at", "begin")


def with_source(rows: DataFrame, per_source: DataFrame, hot: DataFrame, cold: bool) -> DataFrame:
    """rows joined with their sources' rows on _key. Rows of hot sources are not dealt out; others are, if there are any."""
    found = rows.join(F.broadcast(per_source.join(F.broadcast(hot), "_key", "left_semi")), "_key")
    if not cold:
        return found
    others = rows.join(F.broadcast(hot), "_key", "left_anti").join(per_source.join(F.broadcast(hot), "_key", "left_anti"), "_key")
    return found.unionByName(others)


def hash_of(*columns: Column) -> Column:
    """The first 52 bits of the md5 of the columns' texts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """How often each document goes into the mix.

    docs: documents (doc_id, text, source). weights: by source in order of code points,
    null last, repeating. Returns a row for each row of docs: all its columns, size (its
    words [^\\x20\\x09-\\x0D]+; null: 0), source_size, target (of its source) and times
    (0 to 3). The words taken of a source differ from its target by half the size of one
    document at most, or of the documents that share one hash, as repeated rows do. Null
    sources are a source of their own; an empty table gives no rows. Columns of docs
    named like the new ones are replaced. A text's length matters to its count only.
    """
    weights = weights or [1.0, 2.0, 3.0]
    docs = docs.drop("size", "source_size", "target", "times")
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("a"), F.coalesce("source", F.lit("")))
    sized = saved(docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")).withColumn("_key", key).withColumn("_hash", hash_of(F.col("doc_id"), F.col("size"))), "sized")
    slim = sized.select("_key", "_hash", "size")

    # A row for each source; weights go by its place among all.
    ranked = in_order(slim.groupBy("_key").agg(F.sum("size").alias("n"), F.count("*").alias("docs")))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = saved(ranked.withColumn("weight", weight), "weights")
    level = water_level(sources)
    goal = sources.withColumn("target", F.least(MOST * F.col("n").cast("double"), F.lit(level) * F.col("weight")))
    goal = goal.withColumn("whole", F.when(F.col("n") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("n")))).otherwise(0).cast("int"))
    goal = saved(goal.select("_key", F.col("n").alias("source_size"), "target", "whole", F.when(F.col("n") > 0, F.col("target") - F.col("whole") * F.col("n")).otherwise(0.0).alias("budget")), "goal")
    hot = saved(sources.orderBy(F.desc("docs"), "_key").limit(HOT_SOURCES).select("_key"), "hot")
    cold = sources.count() > HOT_SOURCES

    # Narrow the hash range in which each source's budget ends, LEVEL_BITS at a time.
    at = goal.where("budget > 0").select("_key", "budget", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    inside = slim
    for step in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (step + 1)
        inside = with_source(inside, at.select("_key", "prefix"), hot, cold).where(F.shiftright("_hash", shift + LEVEL_BITS) == F.col("prefix")).select("_key", "_hash", "size")
        inside = saved(inside, "bucket") if step else inside
        sums = inside.groupBy("_key", F.shiftright("_hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.join(at.select("_key", "budget", "below"), "_key").withColumn("upto", F.col("below") + F.sum("n").over(upto)).where("upto >= budget")
        at = saved(sums.groupBy("_key").agg(F.min(F.struct("bucket", "upto", "n", "budget")).alias("m")).select("_key", "m.budget", (F.col("m.upto") - F.col("m.n")).alias("below"), F.col("m.bucket").alias("prefix"), F.col("m.n").alias("n")), "threshold")
    nearest = (2 * F.col("below") + F.col("n") <= 2 * F.col("budget")).cast("long")
    goal = goal.join(at.select("_key", (F.col("prefix") + nearest).alias("threshold")), "_key", "left")
    taken = F.col("whole") + F.coalesce((F.col("_hash") < F.col("threshold")).cast("int"), F.lit(0))
    return with_source(sized, goal, hot, cold).select(*docs.columns, "size", "source_size", "target", taken.alias("times"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target and the words the mix takes of it."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def oracle() -> str:
    """The columns and rows of op9_mixing in DuckDB."""
    return r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 13))::BIGINT AS h FROM sized),
src AS (SELECT source, sum(size)::BIGINT AS source_size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM src),
levels AS (SELECT k, w, source_size, ((SELECT sum(source_size) FROM src) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM ranked),
level AS (SELECT level FROM levels WHERE level * w <= 3 * source_size ORDER BY k LIMIT 1),
goal AS (SELECT source, source_size, least(3.0 * source_size, (SELECT level FROM level) * w)::DOUBLE AS target FROM src),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM goal),
summed AS (SELECT hashed.doc_id, hashed.size, source_size, target, whole, target - whole * source_size AS b,
    sum(size) OVER (PARTITION BY hashed.source, h) AS g,
    coalesce(sum(size) OVER (PARTITION BY hashed.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM hashed JOIN budget ON hashed.source IS NOT DISTINCT FROM budget.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN before < b AND 2 * before + g <= 2 * b THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed"""
