"""The corpus-cleaning pipeline: its stages and the function that runs them (see ``siftwright.llm.pipeline``)."""

from siftwright.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
