"""Data frames of rows whose whole numbers may be missing."""

from __future__ import annotations

import pandas as pd


def frame(rows: list[tuple], columns: list[str], whole: set[str]) -> pd.DataFrame:
    """A frame whose columns in ``whole`` are nullable integers, never rounded by way of floats."""
    parts = list(zip(*rows)) or [()] * len(columns)
    return pd.DataFrame({c: pd.array(list(v), dtype="Int64") if c in whole else pd.Series(list(v), dtype=object) for c, v in zip(columns, parts)})
