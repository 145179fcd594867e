"""Rows of two engines in one form."""

from __future__ import annotations

import numpy as np
import pandas as pd


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v.tolist()]
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        v = round(float(v), 6) if isinstance(v, (float, np.floating)) else int(v)
        return int(v) if v == int(v) else v
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)
