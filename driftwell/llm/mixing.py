"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight, from a hash of its id, so reruns agree.  A
source's target is split into complete epochs, which take every document, and a rest, which goes to the documents with
the smallest keys: a prefix sum of sizes in key order is cut at the rest, the document at the cut giving its first words.

A source may hold a third of all rows, so the prefix sum is taken in ranges of (source, key): documents are dealt to ranges
of about equal size at quantiles of what occurs, whatever the weights, the ranges are summed, the sums added up range by
range, and only inside a range are documents sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.llm.scratch import Scratch

#: Source weights in code-point order of the names, null last; repeated as needed.
CYCLE = (5, 2, 1)
#: Words the mix should have, as a share of all words there are; and the most that one source may be repeated.
SHARE, REPEATS = 1.5, 2
#: Documents that a range should have, about.
RANGE_ROWS = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words; null texts have none."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def targets(by_source: DataFrame, share: float = SHARE, repeats: int = REPEATS, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source.

    One sort of one short row a source, in one task: sources are names, some millions of them at most.  Shares follow the
    weights; what lies above ``repeats`` times a source's size is shared again among the others.  In
    the order of size / weight the full sources come first: the level that the rest would get after the sources before
    one says whether that one is full, and the first level with a source that is not is the final one.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = F.array(*[F.lit(float(x)) for x in cycle])
    w = by_source.withColumn("weight", F.element_at(every, (F.row_number().over(order) - 1) % len(cycle) + 1)).withColumn("cap", F.col("source_size") * float(repeats))
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(W.partitionBy()) * share - F.coalesce(F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing))
    w = w.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(W.partitionBy())
    return w.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(final * F.col("weight"))).select("source", "source_size", "target")


def mix_sources(spark: SparkSession, docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, repeats: int = REPEATS, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, the words the mix takes, for every row of ``docs``.

    Reads doc_id, text and source; ``weights`` has doc_id and quality_weight, one row a document, 1 where there is none
    (null or not above 0: never before any weighted document).  Null sources are one source, the last.  Empty texts
    have size 0 and take 0.  Rows that repeat a doc_id draw the same key and are ordered by their size.  An empty table
    gives an empty result.
    """
    scratch = Scratch(spark, "mixing")
    uniform = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)
    measured = scratch.keep(sizes(docs), "sizes")
    if weights is None:
        weighted = measured.withColumn("weight", F.lit(1.0))
    else:
        named = weights.select("doc_id", F.coalesce(F.col("quality_weight").cast("double"), F.lit(0.0)).alias("weight"))
        weighted = measured.join(named, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1e-9))
    keyed = weighted.withColumn("group", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))).withColumn("key", -F.log(uniform) / weight).drop("weight")
    # Rows that are equal in these columns are equal in all that matters, and go to one range.
    ranges = max(1, -(-measured.count() // RANGE_ROWS))
    order = ["group", "key", F.col("doc_id").asc_nulls_first(), "size"]
    keyed = scratch.keep(keyed.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")

    sums = keyed.groupBy("group", "source", "range").agg(F.sum("size").alias("range_size"))
    plan = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), share, repeats, cycle)
    plan = plan.withColumn("group", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))).drop("source")
    before = F.sum("range_size").over(W.partitionBy("group").orderBy("range")) - F.col("range_size")
    offsets = sums.select("group", "range", before.alias("before")).join(plan, "group")

    inside = F.sum("size").over(W.partitionBy("group", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = keyed.withColumn("inside", inside).join(offsets, ["group", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("before") - F.col("inside")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


#: DuckDB twin over documents and labels, with the weights of ``label_weights``.
ORACLE = r"""
WITH quality AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
keyed AS (
  SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN 0 ELSE len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0)
           / CASE WHEN q.q = 1 THEN 1.0 WHEN q.q = 0 THEN 0.25 ELSE 0.5 END AS key
  FROM documents d LEFT JOIN quality q USING (doc_id)),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM keyed GROUP BY source),
levels AS (
  SELECT *, 2.0 * source_size::DOUBLE AS cap,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(2.0 * source_size::DOUBLE) OVER (ORDER BY 2.0 * source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY 2.0 * source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
plan AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target
  FROM levels),
placed AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size)::BIGINT ELSE 0 END AS epochs,
         (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size)::BIGINT AS before
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM placed
"""


def label_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality_weight) of all documents: 1 where labelled good, 0.25 where bad, 0.5 where unlabelled."""
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    weight = F.when(F.col("_quality") == 1, 1.0).when(F.col("_quality") == 0, 0.25).otherwise(0.5)
    return docs.select("doc_id").distinct().join(own, "doc_id", "left").select("doc_id", weight.alias("quality_weight"))
