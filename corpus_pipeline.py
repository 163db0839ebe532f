"""Corpus preparation: quality filter, near duplicates, benchmark decontamination, secrets, packing."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
