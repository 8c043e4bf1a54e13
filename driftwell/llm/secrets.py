"""Secret scan with corpus-wide ownership frequency.

Patterns propose spans in every whole text.  The hash of each candidate value is counted over the corpus, by distinct
repositories and by distinct owners: a value that many owners have is a copied example, one that a single owner has is
live-looking.  Nothing but hashes leaves a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.scratch import Scratch

#: Fixed patterns: (kind, pattern, group of the value, fewest characters of the value).  The first three are the base.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("forge", r"gh[opsur]_[A-Za-z0-9]{30,}", 0, 34),
    ("web", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
BASE = 3
#: A value that this many owners have is a copied example.
COPIED_OWNERS = 3


#: Matches that are placed together: their list is copied for each of them, and no longer list is.
CHUNK = 500


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _placed(zipped: Column, number: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of the matches, each after the piece and the matches before it.

    Chunks of matches are placed from 0, their lengths added up, and the chunks moved there, so that the work follows the
    number of matches.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["piece"])
        end = begin + F.char_length(x["whole"])
        one = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.char_length(x["value"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def add(acc: Column, chunk: Column) -> Column:
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    local = lambda z: F.aggregate(z, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)
    chunks = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda c: local(F.slice(z, c * CHUNK + 1, CHUNK)))
    starts = lambda k: F.aggregate(k, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add)["out"]
    moved = lambda chunk, at: F.transform(chunk["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["value"].alias("value")))
    return _bound(zipped, lambda z: _bound(chunks(z), lambda k: F.flatten(F.zip_with(k, starts(k), moved))))


def _spans(text: Column, number: int) -> Column:
    """array<struct<start, kind, end, value>> of one kind, in order, positions in code points.

    What lies between the matches is split off; a match starts where the pieces and matches before it end.
    """
    _, pattern, group, least = KINDS[number]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("piece"), whole.alias("whole"), value.alias("value"))
    return F.when(text.rlike(pattern), _placed(zipped, number, least)).otherwise(empty)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, owner, and ``found``: all spans of a row by start, then kind; values as SHA-256 only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), text.alias("_t"))
    each = each.select("doc_id", "owner", *[_spans(F.col("_t"), i).alias(f"k{i}") for i in range(len(KINDS))])
    spans = F.array_sort(F.concat(*[F.col(f"k{i}") for i in range(len(KINDS))]))
    return each.select("doc_id", "owner", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value"))).alias("found"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, owners, repositories): distinct owners and documents of each candidate hash.

    Counted in steps, (value, owner, document), (value, owner), (value), each summed before it is shuffled on, so that a
    value that a third of all documents have is no large group anywhere.  Null owners are one owner.
    """
    each = candidates.groupBy("value", "owner", "doc_id").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secret_report(spark: SparkSession, docs: DataFrame, owner: str = "source", copied: int = COPIED_OWNERS) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text and the owner column; others ignored).

    doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_live and n_copied: the document's distinct values that
    one or two owners have, and those that ``copied`` owners or more have.  Null texts count as empty; a text of any length
    is scanned whole, in time that follows its length and matches.  Rows that repeat a doc_id share n_live and n_copied and
    are one repository; rows without doc_id are one document there, rows without owner one owner.  An empty table gives
    an empty result.
    """
    scratch = Scratch(spark, "secrets")
    found = scratch.keep(scan(docs, owner), "spans")
    candidates = found.select("doc_id", "owner", F.explode("found").alias("s")).where(F.col("s.kind") != len(KINDS) - 1).select("doc_id", "owner", F.col("s.value").alias("value"))
    # Both sides are tables, so that a value that a third of all documents have can be split at run time.
    uses = scratch.keep(candidates.select("doc_id", "value").distinct(), "uses")
    counts = scratch.keep(ownership(candidates), "ownership")
    own = uses.join(counts, "value")
    by_doc = own.groupBy("doc_id").agg(F.count(F.when(F.col("owners") < copied, 1)).alias("live"), F.count(F.when(F.col("owners") >= copied, 1)).alias("copied")).withColumnRenamed("doc_id", "_id")
    base = F.filter("found", lambda s: s["kind"] < BASE)

    def number(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k][0]}")

    joined = found.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", *map(number, range(BASE)), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), F.coalesce("live", F.lit(0)).alias("n_live"), F.coalesce("copied", F.lit(0)).alias("n_copied"))


def _duck_spans(number: int) -> str:
    kind, pattern, group, least = KINDS[number]
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, {number} AS kind, '{kind}' AS name, part.start AS start, part.start + length(part.whole) AS "end", part.value AS value
  FROM (
    SELECT doc_id, source, unnest(list_transform(range(1, len(whole) + 1), lambda i: struct_pack(
             start := list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0),
             whole := whole[i], value := vals[i]))) AS part
    FROM (SELECT doc_id, source, regexp_extract_all(t, '{p}', 0) AS whole, regexp_extract_all(t, '{p}', {group}) AS vals, string_split_regex(t, '{p}') AS pieces
          FROM texts WHERE regexp_matches(t, '{p}')))
  WHERE length(part.value) >= {least}"""


#: DuckDB twin over documents.
ORACLE = f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_duck_spans(i) for i in range(len(KINDS)))}),
owners AS (SELECT sha256(value) AS value, count(DISTINCT coalesce(source, chr(0))) AS owners FROM found WHERE kind <> {len(KINDS) - 1} GROUP BY 1),
uses AS (SELECT DISTINCT doc_id, sha256(value) AS value FROM found WHERE kind <> {len(KINDS) - 1}),
live AS (SELECT doc_id, count(*) FILTER (owners < {COPIED_OWNERS}) AS n_live, count(*) FILTER (owners >= {COPIED_OWNERS}) AS n_copied FROM uses JOIN owners USING (value) GROUP BY 1),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         coalesce(string_agg(name || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind) FILTER (kind < {BASE}), '') AS base,
         string_agg(name || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN live USING (doc_id)
"""
