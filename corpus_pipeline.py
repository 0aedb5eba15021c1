"""The corpus pipeline: documents in, packed training sequences out. Its stages are in sitespan.llm.pipeline."""

from sitespan.llm.pipeline import STAGES, run

#: Hashed features, learned models and packing have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
