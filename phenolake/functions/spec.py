"""Panel specification: how the columns of any table map to the canonical panel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolake.functions.expr import add_calendar, denan, source_code


@dataclass(frozen=True)
class PanelSpec:
    """Column names of a panel.

    ``sources`` are wide value columns in priority order; ``values`` of other columns can ride along in ``extra``
    (canonical name -> column).
    """
    entity: str = "pid"
    date: str = "date"
    sources: tuple[str, str, str] = ("s1", "s2", "s3")
    category: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


def as_panel(df: DataFrame, p: PanelSpec) -> DataFrame:
    """Canonical panel: pid, date, s1..s3, value, source, calendar columns; NaN becomes NULL.

    The input must hold one row per (entity, date): aggregate first, so that the rows of an entity are bounded by
    the calendar and windows over an entity stay small however much raw data it has.
    """
    out = df.select(F.col(p.entity).alias("pid"), F.col(p.date).cast("date").alias("date"),
                    *[denan(F.col(c)).alias(f"s{i + 1}") for i, c in enumerate(p.sources)],
                    *([F.col(p.category).alias("category")] if p.category else []),
                    *[F.col(c).alias(n) for n, c in p.extra.items()])
    return add_calendar(out.withColumns({"value": F.coalesce("s1", "s2", "s3"), "source": source_code()}))
