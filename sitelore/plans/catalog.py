"""All registered queries and their SQL."""

from __future__ import annotations

from . import flows, inputs, verdicts

QUERIES = {**inputs.QUERIES, **verdicts.QUERIES, **flows.QUERIES}
ORACLES: dict[str, str] = {**inputs.ORACLES, **verdicts.ORACLES, **flows.ORACLES}
