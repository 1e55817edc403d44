"""Imports every query module once and lists the registered names."""

from phenolake.plans import q_scan, q_aggregate, q_window, q_join, q_season, q_context, q_gap, q_features, q_pixel, q_report  # noqa: F401
from phenolake.plans.registry import QUERIES


def names() -> list[str]:
    return list(QUERIES)
