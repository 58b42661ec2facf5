"""All queries of this subpackage."""

import corpus_pipeline
from emulant.llm import (  # noqa: F401
    queries_clean,
    queries_leaks,
    queries_lines,
    queries_output,
    queries_pairs,
    queries_runs,
    queries_safety,
)
from emulant.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
