"""Likeness of names: the matching-blocks ratio of the standard library, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, GOOD = 0.60, 0.80


def best_ratio(query: str, name: str, qualified_name: str) -> float:
    """The largest ratio (any smaller number if it is below ``LEAST``) of the lower-cased query with the name and, if it has a dot, with as long a tail of the qualified name and with the whole."""
    against = [name.lower()]
    if "." in query:
        full = qualified_name.lower()
        parts = full.split(".")
        count = query.count(".") + 1
        if len(parts) >= count:
            against.append(".".join(parts[-count:]))
        against.append(full)
    best = 0.0
    for a in against:
        m = SequenceMatcher(None, query, a)
        least = max(best, LEAST - 1e-9)  # what can't count, or can't be the best, isn't worked out
        if m.real_quick_ratio() >= least and m.quick_ratio() >= least:
            best = max(best, m.ratio())
    return best


def fuzzy_score(ratio: float) -> float | None:
    if ratio >= GOOD:
        return round(0.70 + (ratio - GOOD) * 0.45, 3)
    if ratio >= LEAST:
        return round(0.45 + (ratio - LEAST) * 0.70, 3)
    return None


def may_reach(query: str, name: Column, qualified_name: Column) -> Column:
    """False where lengths alone keep every ratio below the least that counts; evaluated in the JVM, before any Python."""
    n = len(query)
    bound = lambda c: 2.0 * F.least(F.length(c), F.lit(n)) / (F.length(c) + n) >= LEAST - 1e-9
    out = bound(name)
    if "." in query:
        tail = F.substring_index(qualified_name, ".", -(query.count(".") + 1))
        out = out | bound(tail) | bound(qualified_name)
    return out


def ratio_udf(query: str):
    @F.pandas_udf("struct<raw:double,score:double>")
    def ratios(name: pd.Series, qualified_name: pd.Series) -> pd.DataFrame:
        raw = [best_ratio(query, a or "", b or "") for a, b in zip(name, qualified_name)]
        return pd.DataFrame({"raw": raw, "score": pd.Series([fuzzy_score(r) for r in raw], dtype="float64")})

    return ratios
