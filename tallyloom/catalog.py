"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from tallyloom.plans import aggregation, algebra, answers, attachments, breakdowns, checking, corrections, datasets, diversity, estimation, files, openings, plugins, policies, relations, resampled, rollups, scoring, streams, texts, tokens  # noqa: F401
from tallyloom.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "a12_step_rollup"
