"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size, a doubling of distinct shingles a partition, and each has a bottom-k MinHash sketch: its k
smallest hashes, with k following the size.  An item with n shingles is contained in a document that has at least 80 % of
them, so a document may miss n - ceil(0.8 n); of one sketch value more than that it must have one.  What is compared with
a sketch are the hashes of the whole document: a sketch of a document of 20,000 words would nearly never share a value with
that of 40 words inside it.  So no contained item can be overlooked, however long the document; a document that hits a
sketch is verified on the item's whole set.

A partition is cut in blocks of bounded size: its items are at most so large, so a fixed number of them makes a block.  As
many blocks as fit the bound together are searched in one pass over all documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.llm import textkernel as tk
from driftwell.llm.rows import without
from driftwell.llm.scratch import Scratch, settings

WIDTH, PERCENT = 5, 80
#: Distinct shingles that one block of items holds at most, 8 bytes each; an item that has more is a block of its own.
BLOCK_SHINGLES = 4_000_000
#: Parts in which the items of a size are numbered.
_PARTS = 64


def _item_sets(width: int):
    """(item_id, width, members): items with fewer words than ``width`` are one shingle of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wide, sets = [], [], []
            data, offsets = tk.buffers(batch.column(1))
            starts, ends, firsts = tk.words(data, offsets, tk.NOT_ALNUM)
            hashes = tk.word_hashes(data, starts, ends)
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = hashes[firsts[i] : firsts[i + 1]]
                if len(own):
                    w = min(width, len(own))
                    ids.append(item)
                    wide.append(w)
                    sets.append(np.unique(tk.shingle_hashes(own, np.array([0, len(own)]), w)[0]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(wide, pa.int32()), pa.array(sets, pa.binary())], ["item_id", "width", "members"])

    return run


def sketch_size(n: int, percent: int) -> int:
    """Shingles of an item of which a document that contains it must have one."""
    return n - -(-n * percent // 100) + 1


class _Block:
    """The sketches and sets of some items, by shingle width."""

    def __init__(self, rows: list, percent: int):
        self.percent = percent
        self.widths: dict[int, tuple] = {}
        for width in sorted({r["width"] for r in rows}):
            items = [(r["item_id"], np.frombuffer(r["members"], np.uint64)) for r in rows if r["width"] == width]
            posts = np.concatenate([s[: sketch_size(len(s), percent)] for _, s in items])
            owner = np.repeat(np.arange(len(items)), [sketch_size(len(s), percent) for _, s in items])
            order = np.argsort(posts, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[posts & np.uint64((1 << 20) - 1)] = True
            self.widths[width] = (items, posts[order], owner[order], maybe)

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item_id, shared, item shingles) of all items that the texts contain."""
        for width, (items, posts, owner, maybe) in self.widths.items():
            for row, hashes, bounds in tk.shingles(column, width, tk.NOT_ALNUM):
                at = np.flatnonzero(maybe[hashes & np.uint64((1 << 20) - 1)])
                lo, hi = np.searchsorted(posts, hashes[at], "left"), np.searchsorted(posts, hashes[at], "right")
                at, lo, hi = (x[hi > lo] for x in (at, lo, hi))
                doc = np.searchsorted(bounds, at, "right") - 1
                for d in np.unique(doc):
                    own = hashes[bounds[d] : bounds[d + 1]]
                    mine = doc == d
                    for item in np.unique(np.concatenate([owner[a:b] for a, b in zip(lo[mine], hi[mine], strict=True)])):
                        item_id, members = items[item]
                        shared = int(np.isin(members, own).sum())
                        if 100 * shared >= self.percent * len(members):
                            yield row + int(d), item_id, shared, len(members)


_PAIRS = "doc_id long, item_id long, shared_shingles long, item_shingles long"


def _blocks(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """``sets`` with ``number``, the block that an item is searched in.

    Items of one size partition are numbered part by part; a block has as many as fit with the largest size there is in it.
    """
    n = F.length("members") / 8
    sized = scratch.keep(sets.withColumn("size", F.floor(F.log2(n)).cast("int")).withColumn("part", F.pmod(F.xxhash64("item_id", "members"), F.lit(_PARTS)).cast("int")), "sized")
    parts = sized.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("size", "part").orderBy("item_id", F.xxhash64("members"))) - 1
    per_block = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2), F.col("size") + 1)))
    placed = sized.withColumn("own", own).join(parts.select("size", "part", before.alias("before")), ["size", "part"])
    return placed.withColumn("number", F.floor((F.col("before") + F.col("own")) / per_block)).select("item_id", "width", "members", "size", "number")


def _passes(blocks: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """(size, number, shingles) of all blocks as (size, number) by pass, together within the bound, or alone."""
    out: list[list[tuple[int, int]]] = []
    left = 0
    for size, number, n in sorted(blocks):
        if n > left or not out:
            out.append([])
            left = BLOCK_SHINGLES
        out[-1].append((size, number))
        left -= n
    return out


def contained_items(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row (doc_id, item_id, shared_shingles, item_shingles, containment) for each document and item it contains.

    Words are runs of letters and digits, A-Z folded; ``docs`` has doc_id and text, ``items`` item_id and text, other
    columns are ignored.  An item with fewer words than ``width`` is one shingle of all of them.  Null, empty or
    unpunctuated-to-nothing texts and items match nothing; equal items each match; rows that repeat a doc_id give a row
    each.  A null doc_id or item_id is carried through.  An empty table on either side gives an empty result.
    """
    scratch = Scratch(spark, "decontaminate")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [spark.createDataFrame([], _PAIRS)]
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        sets = scratch.keep(_blocks(scratch, own.mapInArrow(_item_sets(width), "item_id long, width int, members binary")), "items")
        blocks = sets.groupBy("size", "number").agg(F.sum(F.length("members") / 8).cast("long")).collect()  # one row a block
        for i, own in enumerate(_passes(list(map(tuple, blocks)))):
            one = spark.createDataFrame(own, "size int, number long")
            shared = spark.sparkContext.broadcast(_Block(sets.join(F.broadcast(one), ["size", "number"], "left_semi").select("item_id", "width", "members").collect(), percent))

            def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    hits = list(shared.value.matches(batch.column(1)))
                    row, item, count, n = (list(x) for x in zip(*hits, strict=True)) if hits else ([], [], [], [])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(count, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "shared_shingles", "item_shingles"])

            found.append(scratch.keep(texts.mapInArrow(probe, _PAIRS), f"found-{i}"))
            shared.unpersist()
    return reduce(DataFrame.unionByName, found).withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def clean_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that contain an item, columns as they are.

    Of rows that repeat a doc_id all go when one contains an item; rows without doc_id can't be named and stay.
    """
    hits = Scratch(spark, "leaks").keep(contained_items(spark, docs, items, width, percent).select("doc_id").distinct(), "documents")
    return without(docs, hits)


#: DuckDB twin of ``contained_items`` at five words and 80 %.
ORACLE = r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, text FROM benchmark WHERE text IS NOT NULL),
words AS (
  SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM texts),
widths AS (SELECT DISTINCT least(5, len(w)) AS n FROM words WHERE kind = 1 AND len(w) > 0),
grams AS (
  SELECT DISTINCT kind, id, n, unnest(list_transform(range(1, (len(w) - n + 2)::BIGINT), lambda i: array_to_string(w[i:i+n-1], ' '))) AS g
  FROM words JOIN widths ON CASE WHEN kind = 1 THEN n = least(5, len(w)) ELSE n <= len(w) END),
sizes AS (SELECT id AS item_id, count(*) AS n FROM grams WHERE kind = 1 GROUP BY id),
hits AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM grams d JOIN grams i ON d.g = i.g AND d.n = i.n AND d.kind = 0 AND i.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, shared AS shared_shingles, n AS item_shingles, shared / n AS containment
FROM hits JOIN sizes USING (item_id) WHERE 100 * shared >= 80 * n
"""
