"""Exact vector retrieval: unit vectors, cosine top-k, grounded selection of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.sources.tables import digest


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def check_vectors(df: DataFrame, vector: str, size: int) -> None:
    """All vectors have ``size`` finite numbers and are not zero."""
    v = F.col(vector)
    wrong = v.isNull() | (F.size(v) != size) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))) | (norm(v) == 0)
    n = df.where(F.coalesce(wrong, F.lit(True))).count()
    if n:
        raise ValueError(f"{n} vectors of a wrong size, not finite or zero")


def unit(df: DataFrame, vector: str) -> DataFrame:
    length = norm(F.col(vector))
    return df.withColumn(vector, F.transform(F.col(vector), lambda x: x.cast("double") / length))


def top_similar(df: DataFrame, query: list[float], k: int, floor: float | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest rows by cosine, equal ones by key; then those of at least ``floor``: the limit comes first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = F.try_divide(dot(F.col(vector), q), norm(F.col(vector)) * norm(q))
    best = df.select(*[c for c in df.columns if c != vector], sim.alias("similarity")).where("similarity is not null").orderBy(F.col("similarity").desc(), key).limit(k)
    return best if floor is None else best.where(F.col("similarity") >= floor)


#: Query vectors that are searched for in one pass over the rows, and cells of a batch's table of similarities.
BLOCK, CELLS = 4096, 1 << 22


def top_similar_each(df: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, key, similarity, place): the k nearest rows of every query vector, by cosine to nine places and then key.

    Queries go in blocks of bounded size, each one pass over all rows.  A batch of rows keeps its own k best of each query,
    and what equals the last of them, so a query's window sees about k rows a batch, not the table.  Null and zero vectors
    match nothing.
    """
    named = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), vector)
    blocks = max(1, -(-named.count() // BLOCK))
    out = None
    for i in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        ids = np.array([r["query_id"] for r in rows], np.int64)
        q = np.array([r[vector] for r in rows], float).reshape(len(rows), -1)
        length = np.linalg.norm(q, axis=1)
        ids, q = ids[length > 0], q[length > 0] / length[length > 0, None]

        def best(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                there = batch.filter(batch.column(1).is_valid())
                if not there.num_rows or not len(ids):
                    continue
                own = there.column(0).to_numpy(zero_copy_only=False)
                x = there.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
                size = np.linalg.norm(x, axis=1)
                own, x = own[size > 0], x[size > 0] / size[size > 0, None]
                step = max(1, CELLS // len(ids))
                for a in range(0, len(own), step):
                    similar = np.round(q @ x[a : a + step].T, 9)
                    least = np.partition(similar, -k, axis=1)[:, [-k]] if similar.shape[1] > k else similar.min(axis=1, keepdims=True)
                    row, at = np.nonzero(similar >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[a : a + step][at]), pa.array(similar[row, at])], ["query_id", key, "similarity"])

        found = df.select(F.col(key).cast("long").alias(key), vector).mapInArrow(best, f"query_id long, {key} long, similarity double")
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), key))
    return out.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def documents_of(policies: list[dict], rules) -> list[dict]:
    """One document a policy and one a rule; ids unique, texts of 1 to 6000 characters."""
    docs = [dict(d) for d in policies] + [{"id": f"rule:{r.id}", "title": r.id, "text": r.description, "source": "rules", "kind": "rule"} for r in rules.rules]
    for d in docs:
        if set(d) != {"id", "title", "text", "source", "kind"} or not all(isinstance(v, str) and v.strip() for v in d.values()) or len(d["text"]) > 6000:
            raise ValueError(f"bad document: {d.get('id')!r}")
    if len({d["id"] for d in docs}) != len(docs):
        raise ValueError("document ids repeat")
    return docs


@dataclass
class Index:
    """Documents with their vectors in a table; stale when the documents' digest has changed."""

    table: DataFrame
    corpus: str
    size: int

    @staticmethod
    def build(spark: SparkSession, docs: list[dict], embed: Callable[[list[str]], list[list[float]]]) -> Index:
        vectors = embed([d["text"] for d in docs])
        size = len(vectors[0])
        rows = [(d["id"], d["title"], d["text"], d["source"], d["kind"], [float(x) for x in v]) for d, v in zip(docs, vectors, strict=True)]
        df = spark.createDataFrame(rows, "id string, title string, text string, source string, kind string, embedding array<double>")
        check_vectors(df, "embedding", size)
        return Index(unit(df, "embedding"), digest(docs), size)

    def save(self, path: str) -> None:
        self.table.withColumns({"_corpus": F.lit(self.corpus), "_size": F.lit(self.size)}).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, docs: list[dict]) -> Index:
        df = spark.read.parquet(path)
        facts = df.select("_corpus", "_size").first()
        if facts is None or facts["_corpus"] != digest(docs):
            raise ValueError("the index is stale: the documents have changed")
        return Index(df.drop("_corpus", "_size"), facts["_corpus"], facts["_size"])

    def search(self, query: list[float], k: int = 4, floor: float = 0.0) -> list[dict]:
        if len(query) != self.size or not any(query):
            raise ValueError("the query vector has a wrong size or is zero")
        return [r.asDict() for r in top_similar(self.table, query, k, floor, key="id").orderBy(F.col("similarity").desc(), "id").collect()]


class BadReply(RuntimeError):
    """The selector gave no reply that could be used (502)."""


@dataclass
class Grounded:
    """Picks sources among the hits by an injected selector; only hits may be named, each once, or none by abstaining."""

    select: Callable[[str, list[dict]], dict]
    attempts: int = 2
    trace: list[str] = field(default_factory=list)

    def sources(self, question: str, hits: list[dict], matched_rules: frozenset[str] | None = None) -> list[dict]:
        # Filtered after the limit, and not refilled: a rule that didn't match is no evidence.
        usable = [h for h in hits if h["kind"] != "rule" or matched_rules is None or h["id"].removeprefix("rule:") in matched_rules]
        if not usable:
            return []
        by_id = {h["id"]: h for h in usable}
        for _ in range(self.attempts):
            reply = self.select(question, usable)
            ids = reply.get("source_ids") if isinstance(reply, dict) else None
            if isinstance(ids, list) and set(reply) == {"source_ids", "abstain"} and type(reply["abstain"]) is bool and len(set(map(str, ids))) == len(ids) and all(i in by_id for i in ids) and reply["abstain"] == (not ids):
                return [by_id[i] for i in ids]
            self.trace.append("refused reply")
        raise BadReply("the selector gave no valid sources")


#: Words of the answers.
_WORDS = {"en": ("No supporting source was found.", "Sources"), "tr": ("Destekleyen kaynak bulunamadı.", "Kaynaklar")}


def answer(sources: list[dict], language: str = "en") -> str:
    """A deterministic answer: each source's text as it is."""
    if language not in _WORDS:
        raise ValueError(f"unknown language: {language}")
    nothing, title = _WORDS[language]
    return nothing if not sources else "\n".join([f"{title}:", *[f"[{s['id']}] {s['title']}: “{s['text']}”" for s in sources]])
