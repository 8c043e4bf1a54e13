"""All registered queries of the transaction engine and the SQL that says the same."""

from __future__ import annotations

from driftwell.plans.oracles import ORACLES
from driftwell.plans.queries import QUERIES

FLAGSHIP = "full_rule_decisions"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
