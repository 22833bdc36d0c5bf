"""All registered queries of the reference's operators, with their SQL."""

from __future__ import annotations

from . import audit, evaluation, imaging, modeling, release, rules, series

#: Which runs beat the baseline, and by how much, on paired bootstrap replicates.
FLAGSHIP = "bootstrap_deltas"
_PLANS = (evaluation, release, series, audit, rules, imaging, modeling)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
