"""Requests: score, explain, evaluate rules, ask; and the coordinator that runs them in order and keeps a trace."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import context, forest, history, layers
from driftwell.operators.prefix import ranks_among
from driftwell.operators.ranking import RankReference
from driftwell.operators.retrieval import BadReply, Grounded, Index, answer, documents_of
from driftwell.operators.rules import RuleSet
from driftwell.sources.shared import folder
from driftwell.sources.snapshot import Snapshot
from driftwell.sources.tables import TRANSACTION, plain


class Profile(StrEnum):
    RAW = "raw"
    BEHAVIOR_CONTEXT = "behavior_context"
    PRODUCT_RISK = "product_risk"


class NotFound(KeyError):
    """No transaction of that id (404)."""


class BadRequest(ValueError):
    """A request that can't be answered as it is (422)."""


class Unavailable(RuntimeError):
    """A model or index that isn't there (503)."""


#: The status that an HTTP front would give each kind of failure.
STATUS = {NotFound: 404, BadRequest: 422, BadReply: 502, Unavailable: 503}


@dataclass
class Fitted:
    """What scoring needs of the training rows."""

    references: dict[str, layers.Robust]
    forest: forest.Forest | None
    ranks: RankReference
    products: DataFrame | None = None
    risk: tuple[DataFrame, context.ProductRisk] | None = None
    context: context.Context = field(default_factory=context.Context)


def fit(train: DataFrame, cfg: context.Context | None = None, trees: forest.ForestConfig | None = None, multivariate: bool = True) -> Fitted:
    """Fits all layers on training features; the scored training rows are the reference of the ranks."""
    cfg = cfg or context.Context()
    references = layers.fit_references(train)
    grown = forest.fit(train, trees or forest.ForestConfig()) if multivariate else None
    scored = layers.raw_layers(train, references, forest.scores(grown) if grown else None)
    ranks = RankReference.write(scored, [f"{x}_raw" for x in layers.LAYERS], folder(train.sparkSession, "ranks"))
    return Fitted(references, grown, ranks, context.product_reference(train, cfg), None, cfg)


def save(fitted: Fitted, path: str) -> None:
    """A folder with the references and the forest as one JSON row, and the ranked training scores and usual amounts as tables."""
    spark = fitted.ranks.spark
    facts = {"references": {k: [v.centre, v.scale] for k, v in fitted.references.items()}, "forest": fitted.forest.state() if fitted.forest else None, "context": asdict(fitted.context), "products": fitted.products is not None}
    spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")
    fitted.ranks.copied(f"{path}/ranks")
    if fitted.products is not None:
        fitted.products.write.mode("overwrite").parquet(f"{path}/products")


def load(spark: SparkSession, path: str) -> Fitted:
    facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
    references = {k: layers.Robust(*v) for k, v in facts["references"].items()}
    grown = forest.Forest.restored(facts["forest"]) if facts["forest"] else None
    products = spark.read.parquet(f"{path}/products") if facts["products"] else None
    return Fitted(references, grown, RankReference(spark, f"{path}/ranks"), products, None, context.Context(**facts["context"]))


def score(features: DataFrame, fitted: Fitted, profile: Profile = Profile.BEHAVIOR_CONTEXT, external: DataFrame | None = None, one: bool = False) -> DataFrame:
    """Features to layer scores, their ranks, the raw score and the adjusted score of a profile.

    With ``one``, the features are those of one row: its layers are looked up in one block of the ranked training scores each.
    """
    raw = layers.raw_layers(features, fitted.references, forest.scores(fitted.forest) if fitted.forest else None, check=True)
    names = {f"{x}_raw": f"{x}_normalized" for x in layers.LAYERS}
    if one:
        shares = fitted.ranks.shares(raw.select(*names).first().asDict())
        ranked = raw.withColumns({name: F.lit(shares[c]).cast("double") for c, name in names.items()})
    else:
        ranked = ranks_among(fitted.ranks.values(), raw, names)
    whole = layers.combined(ranked)
    if profile is Profile.PRODUCT_RISK:
        if fitted.risk is None:
            raise Unavailable("no product-risk policy is fitted")
        return context.apply_product_risk(whole, *fitted.risk, fitted.context, external, check=True)
    cfg = fitted.context.at(0.0) if profile is Profile.RAW else fitted.context
    return context.apply_context(whole, cfg, fitted.products, external)


@dataclass
class Service:
    """One answer for one request; ``features`` are the saved features of known transactions, a table or a snapshot by id, of which a
    request reads one block."""

    spark: SparkSession
    fitted: Fitted
    rules: RuleSet
    features: DataFrame | Snapshot
    index: Index | None = None
    embed: Callable[[str], list[float]] | None = None
    grounded: Grounded | None = None
    most_history: int = 1000

    def _rows(self, request: dict) -> DataFrame:
        known = {"transaction_id", "transaction", "history", "reference", "external", "profile"}
        if set(request) - known or ("transaction_id" in request) == ("transaction" in request):
            raise BadRequest("a request names a transaction_id or a transaction, and nothing unknown")
        if "transaction_id" in request:
            if request.get("history") or request.get("reference"):
                raise BadRequest("a saved transaction takes no history or reference")
            key = request["transaction_id"]
            found = self.features.find(key) if isinstance(self.features, Snapshot) else self.features.where(F.col("TransactionID") == key)
            rows = found.limit(2).collect()
            if not rows:
                raise NotFound(key)
            if len(rows) > 1:
                raise ValueError(f"TransactionID {key} is not unique")
            return self.spark.createDataFrame(rows, found.schema)
        past, row = list(request.get("history") or []), request["transaction"]
        names = set(TRANSACTION.fieldNames())
        if len(past) > self.most_history or any(set(r) != names for r in [*past, row]) or len({r["TransactionID"] for r in [*past, row]}) != len(past) + 1:
            raise BadRequest("history has too many rows, wrong fields or repeated ids")
        if any(r["TransactionDT"] >= row["TransactionDT"] for r in past):
            raise BadRequest("history must be strictly earlier")
        df = self.spark.createDataFrame([tuple(r[n] for n in TRANSACTION.fieldNames()) for r in [*past, row]], TRANSACTION)
        made = history.features(df, request.get("reference")).where(F.col("TransactionID") == row["TransactionID"])
        return self.spark.createDataFrame(made.collect(), made.schema)

    def scored(self, request: dict) -> DataFrame:
        external = None
        if request.get("external"):
            if "TransactionID" in request["external"]:
                raise BadRequest("external context carries no id of its own")
            key = request.get("transaction_id", (request.get("transaction") or {}).get("TransactionID"))
            external = self.spark.createDataFrame([{**request["external"], "TransactionID": key}])
        return score(self._rows(request), self.fitted, Profile(request.get("profile", Profile.BEHAVIOR_CONTEXT)), external, one=True)

    def score(self, request: dict) -> dict:
        return plain(self.scored(request).first().asDict())

    @contextmanager
    def _held(self, request: dict) -> Iterator[DataFrame]:
        """The scored row of a request, kept until it is answered."""
        scored = self.scored(request).cache()
        try:
            yield scored
        finally:
            scored.unpersist()

    def evaluate_rules(self, request: dict) -> dict:
        with self._held(request) as scored:
            return self.rules.explain(scored)

    def query(self, question: str, matched: frozenset[str] | None = None, language: str = "en") -> dict:
        if self.index is None or self.embed is None or self.grounded is None:
            raise Unavailable("no retrieval index is loaded")
        sources = self.grounded.sources(question, self.index.search(self.embed(question)), matched)
        return {"answer": answer(sources, language), "sources": [s["id"] for s in sources]}

    def explain(self, request: dict, question: str | None = None) -> dict:
        """Scoring, rules and, with a question, retrieval, in this order; every step leaves a line in the trace."""
        trace: list[dict] = []

        def step(name: str, work: Callable[[], dict]) -> dict:
            began = time.perf_counter()
            event = {"sequence": len(trace) + 1, "task": name, "status": "failed"}
            trace.append(event)
            try:
                out = work()
                event["status"] = "completed"
                return out
            finally:
                event["duration_ms"] = round(1000 * (time.perf_counter() - began), 3)

        with self._held(request) as scored:
            result = {"score": step("scoring", lambda: plain(scored.first().asDict())), "rules": step("rules", lambda: self.rules.explain(scored))}
        if question is not None:
            matched = frozenset(r["id"] for r in result["rules"]["rules"] if r["matched"])
            result["answer"] = step("retrieval", lambda: self.query(question, matched))
        return {**result, "trace": trace}

    def indexed(self, policies: list[dict], embed: Callable[[list[str]], list[list[float]]]) -> Index:
        """The retrieval index of the policies and of the rules in force; the service answers from it from now on."""
        self.index = Index.build(self.spark, documents_of(policies, self.rules), embed)
        self.embed = lambda question: embed([question])[0]
        return self.index

    def health(self) -> dict:
        return {"status": "ok", "rules": len(self.rules.rules), "retrieval": self.index is not None}
