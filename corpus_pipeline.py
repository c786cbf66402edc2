"""The corpus pipeline over the documents table; see inkwell.llm.pipeline."""

from inkwell.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
