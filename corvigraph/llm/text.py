"""Shared text expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def normal_form(text: str | None) -> str | None:
    """NFKC, lower case, each run of white space one blank, trimmed; None where nothing is left."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).lower().split()) or None


@F.pandas_udf(StringType())
def normal_form_col(texts: pd.Series) -> pd.Series:
    """:func:`normal_form` of a string column (no built-in expression does NFKC)."""
    known = {t: normal_form(t) for t in texts.unique() if isinstance(t, str)}
    return texts.map(lambda t: known.get(t) if isinstance(t, str) else None)


@F.pandas_udf(ArrayType(StringType()))
def normal_list_col(lists: pd.Series) -> pd.Series:
    """Normal forms of an array of strings, empty ones left out, repeats kept; null stays null."""
    known: dict[str, str | None] = {}

    def one(items):
        if items is None:
            return None
        out = []
        for t in items:
            if t is not None:
                if t not in known:
                    known[t] = normal_form(t)
                if known[t] is not None:
                    out.append(known[t])
        return np.array(out, dtype=object)

    return lists.map(one)
