"""Formats and their normalisers.

A normaliser is a function raw DataFrame -> sessions DataFrame.  It never fails on bad
input: a file it cannot use has no session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.sources import claude_code, codex, cursor, native, swe_agent
from stepwell.sources.sessions import HEADER, STEP

Normalizer = Callable[[DataFrame], DataFrame]

FORMATS: dict[str, Normalizer] = {
    "atif": native.normalize,
    "claude_code": claude_code.normalize,
    "codex": codex.normalize,
    "cursor": cursor.normalize,
    "swe_agent": swe_agent.normalize,
}


def register_format(name: str, normalizer: Normalizer) -> None:
    FORMATS[name] = normalizer


def normalize_all(
    raw: DataFrame, source_format: str = "source_format", only: set[str] | None = None
) -> DataFrame:
    """Sessions of all known formats from raw rows whose format has been detected.

    ``only`` names the formats that occur; the others get no part in the plan.
    """
    parts = [
        normalizer(raw.filter(F.col(source_format) == name)).select("path", "header", "steps")
        for name, normalizer in FORMATS.items()
        if only is None or name in only
    ]
    if not parts:
        return raw.sparkSession.createDataFrame([], f"path string, header {HEADER}, steps array<{STEP}>")
    sessions = parts[0]
    for part in parts[1:]:
        sessions = sessions.unionByName(part)
    return sessions
