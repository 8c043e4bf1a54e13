"""Document fingerprints: a wide xxhash of the canonical text, with byte comparison inside equal buckets.

Two 64-bit xxhash values make the bucket.  Documents that share one are compared byte by byte, and by SHA-256 with the
edited texts of a report; should different texts ever meet in a bucket, they get numbers in the order of their SHA-256, so
equal canonical texts always have equal fingerprints and different ones never.  Only texts that share a bucket are shuffled
for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.llm.canonical import canonical
from driftwell.llm.scratch import Scratch

_SECOND = 0x5851F42D


def _halves(text: Column, bits: int) -> tuple[Column, Column]:
    """The two hashes, cut to ``bits`` bits where a test wants collisions."""
    first, second = F.xxhash64(text), F.xxhash64(F.lit(_SECOND), text)
    if bits >= 64:
        return first, second
    mask = F.lit((1 << bits) - 1).cast("long")
    return first.bitwiseAND(mask), second.bitwiseAND(mask)


def _printed(h: Column, l: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(l), 16, "0")))


def collisions(scratch: Scratch, hashed: DataFrame, texts: DataFrame, bits: int) -> DataFrame | None:
    """(h, l, digest, place) for different texts that share a bucket, place 0 for the first; None where there are none.

    ``hashed`` has h, l and digest of every text; ``texts`` has the raw text column they came from.
    """
    # By digest first, so that copies are summed up before they meet; a table, so that Spark knows its size: a small one is sent to
    # the texts, and of a large one's join the hot buckets can be split.
    busy = hashed.groupBy("h", "l", "digest").agg(F.count("*").alias("n")).groupBy("h", "l").agg(F.sum("n").alias("n")).where("n > 1")
    busy = scratch.keep(busy.select("h", "l"), "busy")
    c = texts.select(canonical(F.col("text")).alias("c")).select("c", *(x.alias(n) for x, n in zip(_halves(F.col("c"), bits), "hl", strict=True)))
    members = c.join(busy, ["h", "l"], "left_semi")
    clash = scratch.keep(members.groupBy("h", "l").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h", "l"), "clashes")
    by_digest = hashed.groupBy("h", "l").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("h", "l")
    clash = scratch.keep(clash.unionByName(by_digest).distinct(), "all-clashes")
    if clash.isEmpty():
        return None
    order = W.partitionBy("h", "l").orderBy("digest")
    return scratch.keep(hashed.join(clash, ["h", "l"], "left_semi").select("h", "l", "digest").distinct().withColumn("place", F.row_number().over(order) - 1), "places")


#: Documents that a range of ids should have, about, and the most ranges there are: beyond that they grow, and are sorted
#: with spills.  Range bounds are one row of 8 bytes a range.
RANGE_ROWS, MOST_RANGES = 2_000, 65_536


def with_neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the next document in ascending doc_id, and the first one after the last.

    Ranges begin at ids that occur, chosen by their hash; the first document of a range is also dealt, as a guest, to the
    range before, so that only ranges are sorted and every neighbour is found.  Null ids come last; rows with equal ids
    are ordered by their text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = texts.select("doc_id")
    count = ids.count()
    wide = min(RANGE_ROWS, count // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    every = max(1, wide, -(-count // MOST_RANGES))
    picked = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0, F.col("doc_id"))
    # The smallest id is a bound, or 0 where no row has an id.  One row, read beside every document.
    bounds = ids.where("doc_id is not null").agg(F.collect_set(picked).alias("some"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("least"))
    bounds = Scratch(spark, "bounds").keep(bounds.select(F.array_sort(F.array_union("some", F.array("least"))).alias("bounds")), "bounds")

    def halve(acc: Column, _: Column) -> Column:
        """One step of a binary search for the last bound not above the id."""
        middle = ((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        here = F.get("bounds", middle) <= F.col("doc_id")
        return F.struct(F.when(here, middle).otherwise(acc["lo"]).alias("lo"), F.when(here, acc["hi"]).otherwise(F.greatest(acc["lo"], middle - 1)).alias("hi"))

    last = F.size("bounds") - 1
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("bounds") + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), last.alias("hi")), halve, lambda acc: acc["lo"])
    placed = texts.crossJoin(F.broadcast(bounds)).withColumn("at", F.when(F.col("doc_id").isNull(), last).otherwise(found))
    guest = F.array(F.struct(F.col("at").alias("range"), F.lit(0).alias("guest")), F.struct(F.pmod(F.col("at") - 1, F.size("bounds")).alias("range"), F.lit(1).alias("guest")))
    # Without any id, all rows are in one range and the first follows the last.
    first = (F.col("doc_id") == F.get("bounds", F.col("at"))) | ((F.size("bounds") == 1) & F.col("doc_id").isNull())
    dealt = placed.select("doc_id", "text", F.explode(F.when(F.coalesce(first, F.lit(False)), guest).otherwise(F.slice(guest, 1, 1))).alias("own")).select("doc_id", "text", "own.range", "own.guest")
    order = W.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as many of the first characters of ``following``."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(spark: SparkSession, docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, fingerprint for every row of ``docs`` (doc_id and text; others ignored).

    Null texts count as empty, and all empty or blank texts are equal; rows that repeat an id or a text give a row each.
    An empty table gives an empty result.
    """
    scratch = Scratch(spark, "fingerprints")
    c = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text").cast("string")).alias("c"))
    h, l = _halves(F.col("c"), bits)
    hashed = scratch.keep(c.select("doc_id", h.alias("h"), l.alias("l"), F.sha2("c", 256).alias("digest")), "hashes")
    clashes = collisions(scratch, hashed.select("h", "l", "digest"), docs.select(F.col("text").cast("string").alias("text")), bits)
    return _named(hashed, clashes, "h", "l", "digest", "fingerprint").select("doc_id", "fingerprint")


def _named(df: DataFrame, clashes: DataFrame | None, h: str, l: str, digest: str, name: str) -> DataFrame:
    plain = _printed(F.col(h), F.col(l))
    if clashes is None:
        return df.withColumn(name, plain)
    places = clashes.select(F.col("h").alias(h), F.col("l").alias(l), F.col("digest").alias(digest), F.col("place").alias("_place"))
    named = F.when(F.coalesce("_place", F.lit(0)) == 0, plain).otherwise(F.concat_ws("-", plain, F.col("_place").cast("string")))
    return df.join(places, [h, l, digest], "left").withColumn(name, named).drop("_place")


def edit_report(spark: SparkSession, docs: DataFrame, bits: int = 64) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are to its own and its neighbour's.

    A digest is exact, so likeness is 1 for equal canonical bytes and 0 otherwise.  One row for every row of ``docs``
    (doc_id and text; others ignored); null texts are empty, and an empty text's edit is empty.  Rows with equal ids
    follow each other, in the order of their texts' hashes; a row without doc_id comes last.  A single row is its own next.
    An empty table gives an empty result.
    """
    scratch = Scratch(spark, "edit-report")
    rows = with_neighbours(spark, docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    # The canonical form is written once, for all three texts: it is most of the plan.
    forms = F.transform(F.array("text", "edited", "next_text"), canonical).alias("forms")
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), forms)
    c, e, f = (F.get("forms", F.lit(i)) for i in range(3))
    (ch, cl), (eh, el) = _halves(c, bits), _halves(e, bits)
    hashed = rows.select(
        "doc_id", "n_chars", "edited_sha256", ch.alias("ch"), cl.alias("cl"), F.sha2(c, 256).alias("cd"), eh.alias("eh"), el.alias("el"), F.sha2(e, 256).alias("ed"),
        (c == e).cast("double").alias("near_edited"), (c == f).cast("double").alias("near_next"),
    )
    hashed = scratch.keep(hashed, "hashes")
    both = hashed.select(F.col("ch").alias("h"), F.col("cl").alias("l"), F.col("cd").alias("digest")).unionByName(hashed.select(F.col("eh").alias("h"), F.col("el").alias("l"), F.col("ed").alias("digest")))
    clashes = collisions(scratch, both, docs.select(F.col("text").cast("string").alias("text")), bits)
    named = _named(_named(hashed, clashes, "ch", "cl", "cd", "fingerprint"), clashes, "eh", "el", "ed", "edited_fingerprint")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
