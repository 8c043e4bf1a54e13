"""Near-duplicate documents by a signature-coordinate inverted join.

Each document's set of word shingles gives a MinHash signature.  A document is posted under (coordinate, value)
tokens, rarest first, and only under its first ``coordinates - matches + 1`` of them: two signatures that agree on
``matches`` coordinates must meet there (prefix), and the long lists left over are only probed (skip).  Documents that
meet are compared on whole signatures, the survivors on whole shingle sets, and what is linked is joined to components.

Documents with equal sets are one class from the start.  Inside a posting list every class is first compared with a few
leaders of the list.  Classes that are then in different components though they share a list meet again under the rarest
of their own shingles, by the same prefix rule on whole sets: the smaller of two linked sets has more than 8/9 of its
shingles in common with the other, the larger at least 4/5, so the smaller is posted under few of them and the larger looks
under a few more.  No link is lost.  A family of texts that differ more than that, each in its own words, posts nothing and
makes no pairs, however many they are; a group of near copies costs pairs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.llm import textkernel as tk
from driftwell.llm.components import components
from driftwell.llm.scratch import Scratch, settings


@dataclass(frozen=True)
class NearDedup:
    """``width`` words a shingle; linked when intersection / union >= ``percent`` / 100.

    ``coordinates`` and ``matches`` set the search: a pair at a similarity of 0.8 agrees on fewer than 12 of 32
    coordinates once in about forty million.
    """

    width: int = 5
    percent: int = 80
    coordinates: int = 32
    matches: int = 12
    leaders: tuple[int, ...] = (0, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51)


_SETS = "doc_id long, n_shingles long, class_key binary, signature array<long>, sketch long"
#: Coordinates of which a sketch has two bits each.
_SKETCHED = 32


def _signatures(cfg: NearDedup):
    rng = np.random.default_rng(7)
    times = rng.integers(1, (1 << 63) - 1, cfg.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = rng.integers(0, (1 << 63) - 1, cfg.coordinates, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, keys, sig = np.zeros(n, np.int64), [b""] * n, np.zeros((n, cfg.coordinates), np.uint64)
            for row, hashes, bounds in tk.shingles(batch.column(1), cfg.width):
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                for k in range(cfg.coordinates):
                    sig[row + full, k] = np.minimum.reduceat((hashes ^ flips[k]) * times[k], bounds[full])
                for i in full:
                    distinct = np.unique(hashes[bounds[i] : bounds[i + 1]])
                    size[row + i], keys[row + i] = len(distinct), xxhash.xxh3_128_digest(distinct.tobytes())
            flat = pa.array(sig.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * cfg.coordinates), flat)
            sketch = np.zeros(n, np.uint64)
            for k in range(min(cfg.coordinates, _SKETCHED)):
                sketch |= (sig[:, k] & np.uint64(3)) << np.uint64(2 * k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(keys, pa.binary()), lists, pa.array(sketch.view(np.int64))], ["doc_id", "n_shingles", "class_key", "signature", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, hashes, bounds in tk.shingles(batch.column(1), width):
                out += [np.unique(hashes[bounds[i] : bounds[i + 1]]).view(np.int64) for i in range(len(bounds) - 1)]
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["rep", "members"])

    return run


def _confirm(percent: int):
    """Keeps the pairs whose whole sets pass; a set is its hashes, sorted as unsigned numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, cfg: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (columns doc_id and text, others ignored).

    Null and blank texts have no shingles and are linked with nothing.  Rows that repeat a doc_id are one document with
    several texts: what is linked to either text has the same component.  A row without doc_id can't be named as a
    component: its component_id is null and it is kept.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "near-dedup")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        return _run(scratch, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cfg)


def _run(scratch: Scratch, docs: DataFrame, cfg: NearDedup) -> DataFrame:
    found = scratch.keep(docs.mapInArrow(_signatures(cfg), _SETS), "signatures")
    named = found.where("n_shingles > 0 and doc_id is not null")
    # Members of a class have one size and signature; copies are summed up before the shuffle, however many they are.
    reps = scratch.keep(named.groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")), "classes")

    # Postings: tokens of one class only can't make a pair, and being the rarest they fill the prefix first.
    tokens = reps.select("rep", "class_key", "n", "sketch", F.posexplode("signature").alias("coordinate", "value")).select("rep", "class_key", "n", "sketch", F.xxhash64("value", "coordinate").alias("token"))
    # A table of its own, as below, so that a join that meets a hot token can be split at run time.
    often = scratch.keep(tokens.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1"), "often")
    rarest = W.partitionBy("rep", "class_key").orderBy("freq", "token")
    prefix = cfg.coordinates - cfg.matches + 1
    shared = tokens.join(often, "token").withColumn("place", F.row_number().over(rarest)).withColumn("alone", cfg.coordinates - F.count("*").over(W.partitionBy("rep", "class_key")))
    posted = scratch.keep(shared.where(F.col("place") + F.col("alone") <= prefix).select("token", "rep", "n", "sketch"), "postings")

    open_docs = posted.select(F.col("rep").alias("doc_id")).distinct()
    members = scratch.keep(docs.join(open_docs, "doc_id", "left_semi").mapInArrow(_sets(cfg.width), "rep long, members array<long>").where("size(members) > 0"), "members")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that pass on whole sets."""
        x, y = (members.select(F.col("rep").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
        # A table first: a text that very many pairs have can then be split at run time.
        pairs = scratch.keep(pairs, f"{name}-pairs")
        return scratch.keep(pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(cfg.percent), "a long, b long").distinct(), name)

    # A leader goes with its size and sketch: what is too large or too small for it, or can't agree with it on enough coordinates,
    # makes no pair.  Coordinates that agree have equal bits, and of others three in four have not.
    leaders = scratch.keep(posted.groupBy("token").agg(*[F.min(F.struct(F.col("rep").bitwiseXOR(F.lit(s)).alias("k"), "n", "sketch")).alias(f"l{i}") for i, s in enumerate(cfg.leaders)]), "leaders")
    each = F.array_distinct(F.array(*[F.struct(F.col(f"l{i}.k").bitwiseXOR(F.lit(s)).alias("leader"), F.col(f"l{i}.n").alias("m"), F.col(f"l{i}.sketch").alias("other")) for i, s in enumerate(cfg.leaders)]))

    def fits(x: Column) -> Column:
        differs = F.col("sketch").bitwiseXOR(x["other"])
        differs = F.bit_count(differs.bitwiseOR(F.shiftrightunsigned(differs, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        sizes = 100 * F.least("n", x["m"]) >= cfg.percent * F.greatest("n", x["m"])
        return (x["leader"] != F.col("rep")) & sizes & (differs <= cfg.coordinates - cfg.matches)

    led = posted.select("token", "rep", "n", "sketch").join(leaders, "token").select("rep", F.explode(F.filter(each, fits)).alias("x"))
    pairs = led.select(F.least("rep", "x.leader").alias("a"), F.greatest("rep", "x.leader").alias("b"))
    pairs = scratch.keep(pairs.distinct(), "led")
    x, y = (reps.select(F.col("rep").alias(c), F.col("signature").alias(f"sig_{c}")) for c in "ab")
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    alike = pairs.join(x, "a").join(y, "b").where(agree >= cfg.matches)
    first = confirmed(alike.select("a", "b").distinct(), "links-1")
    stars = scratch.keep(components(first, scratch, "stars"), "star-components")

    # Classes that share a list and are still apart meet under the rarest of their shingles.
    known = scratch.keep(posted.join(stars.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("component")), "known")
    mixed = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    apart = known.join(mixed, "token", "left_semi").select("rep", "component").distinct()
    own = members.join(apart, "rep").select("rep", "component", F.size("members").alias("n"), F.explode("members").alias("shingle"))
    common = scratch.keep(own.groupBy("shingle").agg(F.count("*").alias("freq")), "common")
    ranked = own.join(common, "shingle").withColumn("place", F.row_number().over(W.partitionBy("rep", "n").orderBy("freq", "shingle")))
    # At most that many shingles of a set may be missing from a set that it is linked with, of its size or larger; of any.
    n, allowed = F.col("n"), lambda share: F.col("n") - F.ceil(F.col("n") * share) + 1
    left = scratch.keep(ranked.where((F.col("freq") > 1) & (F.col("place") <= allowed(cfg.percent / 100 - 1e-9))).drop("freq"), "prefixes")
    few = scratch.keep(left.where(F.col("place") <= allowed(2 * cfg.percent / (100 + cfg.percent) - 1e-9)), "short-prefixes")
    other = left.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("rep", "component", "n", "place")])
    shared = F.least(n - F.col("place"), F.col("n_b") - F.col("place_b")) + 1
    enough = (100 + cfg.percent) * shared >= cfg.percent * (n + F.col("n_b"))
    ordered = (n < F.col("n_b")) | ((n == F.col("n_b")) & (F.col("rep") < F.col("rep_b")))
    meet = few.join(other, "shingle").where(ordered & (100 * n >= cfg.percent * F.col("n_b")) & (F.col("component") != F.col("component_b")) & enough)
    rest = confirmed(meet.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct(), "links-2")
    parts = components(first.unionByName(rest), scratch, "parts")
    parts = scratch.keep(parts, "components")

    by_class = scratch.keep(reps.select("class_key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("class_key", F.coalesce("component", "rep").alias("component")), "by-class")
    joined = found.select("doc_id", "n_shingles", "class_key").join(by_class, "class_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
