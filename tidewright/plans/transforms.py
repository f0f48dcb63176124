"""SQL transforms at the three stages of a record's way: when it is landed, when its window is drained, when it is read.

A transform is one SELECT over ``{rows}``. There is no other plug-in interface.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewright.plans.guards import check_select
from tidewright.types import InvalidInput


def transformed(rows: DataFrame, text: str | None) -> DataFrame:
    """``rows`` through the transform; without one, as they are. Anything but a SELECT over {rows} is refused."""
    if text is None:
        return rows
    if "{rows}" not in text:
        raise InvalidInput("a transform selects from {rows}")
    check_select(rows.sparkSession, text.replace("{rows}", "rows"))
    return rows.sparkSession.sql(text, rows=rows)


def checked(rows: DataFrame, text: str | None, system: list[str]) -> DataFrame:
    """The same for stored rows: the system's columns must come out as they went in (by name)."""
    out = transformed(rows, text)
    if lost := [c for c in system if c not in out.columns]:
        raise InvalidInput(f"the transform drops {', '.join(lost)}")
    return out
