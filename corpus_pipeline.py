"""The corpus pipeline's entry: ``STAGES``, ``run`` and ``ORACLE_SQL`` of ``sitelore.llm.pipeline``."""

from __future__ import annotations

from sitelore.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
