"""All registered queries of the library (those of the corpus package aside)."""

from __future__ import annotations

from casewise.plans import metrics, selection, voxels

MODULES = [selection, voxels, metrics]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
