"""The corpus pipeline: its stages, the SQL for its rows (none), and run(spark, sf_dir)."""

from __future__ import annotations

from mesograph.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
