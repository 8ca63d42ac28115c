"""All registered queries of the engine's own operators, with their SQL."""

from cartoflow.plans import analysis_queries, relational_queries, search_queries  # noqa: F401  (they register)
from cartoflow.plans.carriers import ORACLE_SQL, QUERIES  # noqa: F401
