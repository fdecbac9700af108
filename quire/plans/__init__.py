"""All registered queries."""

from quire.plans import evaluation, facts, functions, incremental, layout, match, score, series, streaming, text
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "facts", "functions", "incremental", "layout", "match", "score", "series", "streaming", "text"]
