"""All registered queries: importing the binding modules fills the registry."""

from . import bind_counts, bind_fitting, bind_graph, bind_relations, bind_solvers, bind_sources, bind_stats, bind_streaming  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
