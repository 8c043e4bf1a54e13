"""Token counts as delta-maintained rollups.

A batch of changes (insert, delete, revise) becomes signed rows: what a document counted before with a minus, what it
counts now with a plus.  Totals by source, language and tokenizer version are the totals before plus the batch's signed
sums.

The ledger says what every document counts.  It is a few tables of falling size, each dealt to buckets by document: a batch
reads the buckets of its own documents only, and tables that the later ones have caught up with are folded into one, so
that there are few of them and a row is folded a logarithmic number of times.

A batch is committed by its manifest, one row that names the tables of the ledger and the totals, written last.  What an
interrupted batch has left is named by no manifest and never read.  Committing a batch again is no work and changes nothing.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.scratch import Scratch, settings

#: Tokenizer versions counted by default: name of the version and vocabulary file in the folder.
VERSIONS = {"bpe-50k": "byte_bpe_50k.tiktoken", "bpe-multi-50k": "byte_bpe_multi_50k.tiktoken"}
FOLDER = "/opt/tokenizers"
#: Fewest and most buckets of a ledger table, and the rows from which on there are twice as many: what is written and folded in
#: one task doesn't grow with the ledger.
BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 64, 65_536, 250_000

_KEYS = ["source", "lang", "version"]
_LEDGER = "doc_id long, source string, lang string, version string, tokens long, copies long, bucket int"
_ROW = ["doc_id", "source", "lang", "version", "tokens", "copies"]
_TOTALS = "source string, lang string, version string, documents long, tokens long"
_MANIFEST = "batch long, parts array<struct<path:string,rows:long,buckets:int>>, totals string"


@functools.lru_cache(4)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("counted", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: the public pre-tokenizer pattern that belongs to the vocabularies.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(folder: str, file: str) -> bytes:
    """A vocabulary file, some MB, read by the driver; the executors get it from there."""
    try:
        with open(f"{folder}/{file}", "rb") as f:
            return f.read()
    except FileNotFoundError as gone:
        raise ValueError(f"no vocabulary {file} in {folder}; pass the folder that has it") from gone


def count_tokens(docs: DataFrame, versions: dict[str, str] = VERSIONS, folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, lang, version, tokens): a row for each row of ``docs`` and version; null texts count 0."""
    shared = docs.sparkSession.sparkContext.broadcast({name: vocabulary(folder, file) for name, file in versions.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {name: _encoder(data) for name, data in shared.value.items()}
        for batch in batches:
            for name, e in encoders.items():
                tokens = pa.array([len(e.encode_ordinary(t.as_py() or "")) for t in batch.column(3)], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * batch.num_rows, pa.string()), tokens], ["doc_id", *_KEYS, "tokens"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")]]
    return docs.select(*columns).mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long")


def buckets_for(rows: int) -> int:
    """How many buckets a table of so many rows has: as few as there may be, doubled as often as needed."""
    n = BUCKETS
    while n < MOST_BUCKETS and rows > n * BUCKET_ROWS:
        n *= 2
    return n


def _bucket(buckets: int) -> F.Column:
    """By document; rows without an id, which nothing can take back, by what they count."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(*_KEYS, "tokens")).otherwise(F.xxhash64("doc_id"))
    return F.pmod(key, F.lit(buckets)).cast("int").alias("bucket")


def _summed(signed: DataFrame) -> DataFrame:
    """What is left of signed ledger rows."""
    return signed.groupBy("doc_id", *_KEYS, "tokens").agg(F.sum("copies").alias("copies")).where("copies <> 0")


class TokenRollup:
    """Totals kept at ``root`` in the shared folder; see the module.  One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, versions: dict[str, str] = VERSIONS, folder: str = FOLDER):
        self.spark, self.root, self.versions, self.folder = spark, root.rstrip("/"), dict(versions), folder

    def _manifests(self) -> list[tuple[int, int, str]]:
        """(sequence, batch, path) of every manifest that was begun, ascending: one listing."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted((int(n.split("-")[0]), int(n.split("-")[1]), f"{self.root}/commits/{n}") for n in names)

    def _done(self, manifest: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{manifest}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def committed(self) -> list[int]:
        """Committed batches, ascending."""
        return sorted({batch for _, batch, path in self._manifests() if self._done(path)})

    def _state(self) -> tuple[list[tuple[str, int, int]], str | None]:
        """The ledger's tables with their rows and buckets, largest first, and the table of totals, after the last commit."""
        for _, _, path in reversed(self._manifests()):
            if self._done(path):
                row = self.spark.read.schema(_MANIFEST).parquet(path).first()
                return [(p["path"], p["rows"], p["buckets"]) for p in row["parts"]], row["totals"]
        return [], None

    def _ledger(self, paths: list[str]) -> DataFrame:
        each = [self.spark.read.schema(_LEDGER).parquet(p) for p in paths]
        return functools.reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], _LEDGER)

    def _write(self, signed: DataFrame, most: int) -> tuple[str, int, int]:
        """A table of signed rows, about ``most``, in as many buckets as they need."""
        path, buckets = f"{self.root}/ledger/{uuid.uuid4().hex}", buckets_for(most)
        signed.select(*_ROW, _bucket(buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)
        return path, self.spark.read.schema(_LEDGER).parquet(path).count(), buckets

    def ledger(self) -> DataFrame:
        """What each document counts now: (doc_id, source, lang, version, tokens, copies)."""
        return _summed(self._ledger([p for p, *_ in self._state()[0]]))

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) over all committed batches; what has gone to nothing is left out."""
        path = self._state()[1]
        return self.spark.read.schema(_TOTALS).parquet(path) if path else self.spark.createDataFrame([], _TOTALS)

    def counted_before(self, ids: DataFrame) -> DataFrame:
        """Ledger rows of the documents in ``ids`` (doc_id, different ones), from their buckets only."""
        parts = self._state()[0]
        if not parts:
            return _summed(self._ledger([]))
        # Numbers of buckets are multiples of each other: the most buckets tell the others.
        finest = max(n for *_, n in parts)
        own = {r["bucket"] for r in ids.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(finest)).cast("int").alias("bucket")).distinct().collect()}
        each = [self._ledger([path]).where(F.col("bucket").isin(sorted({b % n for b in own}))) for path, _, n in parts]
        return _summed(functools.reduce(DataFrame.unionByName, each).join(ids, "doc_id", "left_semi"))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies (action, doc_id, source, lang, text) under the number ``batch``; False where it was committed before.

        ``delete`` takes back what the document counts, ``revise`` does so and counts the new text, ``insert`` counts it
        in addition; other actions are ignored.  Deletes and revisions of unknown documents take nothing back.  Null
        sources and languages are groups of their own; rows without doc_id can be inserted but not taken back.  An empty
        batch is committed and changes nothing.
        """
        manifests = self._manifests()
        if any(b == batch and self._done(path) for _, b, path in manifests):
            return False
        parts, totals = self._state()
        new = count_tokens(changes.where("action in ('insert', 'revise')"), self.versions, self.folder).withColumn("copies", F.lit(1).cast("long"))
        gone = changes.where("action in ('delete', 'revise')").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        old = self.counted_before(gone).withColumn("copies", -F.col("copies"))
        with settings(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
            # A change takes a document's rows back and adds as many, about.
            most = 2 * changes.count() * len(self.versions)
            parts = [*parts, self._write(new.unionByName(old), most)]
        sums = self._ledger([parts[-1][0]]).groupBy(*_KEYS).agg(F.sum("copies").alias("documents"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
        before = self.spark.read.schema(_TOTALS).parquet(totals) if totals else self.spark.createDataFrame([], _TOTALS)
        path = f"{self.root}/totals/{uuid.uuid4().hex}"
        both = before.unionByName(sums).groupBy(*_KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        both.where("documents <> 0 or tokens <> 0").write.parquet(path)

        caught_up = [i for i in range(len(parts) - 1) if sum(rows for _, rows, _ in parts[i + 1 :]) >= parts[i][1]]
        if caught_up:
            parts = [*parts[: caught_up[0]], self._write(_summed(self._ledger([p for p, *_ in parts[caught_up[0] :]])), sum(rows for _, rows, _ in parts[caught_up[0] :]))]
        sequence = manifests[-1][0] + 1 if manifests else 0
        row = (batch, parts, path)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.parquet(f"{self.root}/commits/{sequence:09d}-{batch}")
        return True


def corpus_rollup(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after three batches: all documents in, the toxic ones out, the bad ones cleaned; the last sent twice.

    Reads doc_id, source, lang and text of ``docs`` and all of ``labels`` (doc_id, toxic, quality); other columns are
    ignored.  Of several labels of a document the largest count, null ones not at all.  A null text counts 0 tokens and is a
    document; rows that repeat a document count as often, and go and are revised together: each is counted again as the
    row that it is.  Rows without doc_id stay as they are.  Empty tables give an empty result.
    """
    scratch = Scratch(spark, "rollup")
    rollup = TokenRollup(spark, scratch.path("store"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"), F.max("quality").alias("_quality"))
    plain = docs.select("doc_id", "source", "lang", "text")
    rollup.commit(1, plain.withColumn("action", F.lit("insert")))
    gone = docs.select("doc_id").join(known.where("_toxic = 1"), "doc_id", "left_semi")
    rollup.commit(2, gone.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")], F.lit("delete").alias("action")))
    # A merge join at any size: the labels grow with the corpus.
    bad = plain.join(known.where("_quality = 0 and coalesce(_toxic, 0) <> 1").hint("merge"), "doc_id", "left_semi")
    cleaned = scratch.keep(bad, "bad").withColumn("text", F.regexp_replace("text", r"[#$%&*!|]+", "")).withColumn("action", F.lit("revise"))
    for _ in range(2):
        rollup.commit(3, cleaned)
    return rollup.totals()
