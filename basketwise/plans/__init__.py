"""The registered queries, each with the SQL that another engine runs on the same tables."""

from . import cleaning, dimensions, evaluation, features, insights, learning, sampling

_MODULES = (cleaning, dimensions, features, sampling, insights, evaluation, learning)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
