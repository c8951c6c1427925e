"""String similarities and JSON merges that Spark lacks, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib
import json
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio without the junk heuristic; 1 for two empty strings."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def dice(a: str, b: str) -> float:
    """Dice coefficient of the bigram multisets; strings of one character compare as equal or not."""
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


def best_ratio(left: list[str], right: list[str], containment: float) -> float:
    """Similarity of two sets of normalised terms: 1 if one is common, ``containment`` or more if one contains another, else the best ratio."""
    best = 0.0
    for a in left:
        for b in right:
            if not a or not b:
                continue
            if a == b:
                return 1.0
            if a in b or b in a:
                best = max(best, containment)
            if 2 * min(len(a), len(b)) / (len(a) + len(b)) > best:  # the ratio cannot exceed this
                best = max(best, ratio(a, b))
    return best


def merge_json(base, new):
    """Fill empty values, recurse into objects, unite arrays as strings, concatenate differing strings, else keep the base."""
    empty = lambda v: v is None or v == "" or v == [] or v == {}
    if empty(base):
        return new
    if empty(new):
        return base
    if isinstance(base, dict) and isinstance(new, dict):
        return {k: merge_json(base.get(k), new.get(k)) for k in [*base, *(k for k in new if k not in base)]}
    if isinstance(base, list) and isinstance(new, list):
        text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return list(dict.fromkeys(t for t in (text(v).strip() for v in [*base, *new]) if t))
    if isinstance(base, str) and isinstance(new, str) and base.strip() != new.strip():
        return f"{base.strip()}\n\n{new.strip()}"
    return base


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def term_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    from quern.schemas import CONTAINMENT

    return pd.Series([best_ratio(list(x) if x is not None else [], list(y) if y is not None else [], CONTAINMENT) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def merge_json_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        return json.dumps(merge_json(json.loads(x) if x else None, json.loads(y) if y else None), ensure_ascii=False)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def merge_json_list_udf(a: pd.Series) -> pd.Series:
    """All objects of a list merged in order; null and empty ones add nothing."""
    return a.map(lambda x: json.dumps(reduce(merge_json, (json.loads(v) for v in x if v), None), ensure_ascii=False))


@F.pandas_udf(T.StringType())
def nfkc_udf(a: pd.Series) -> pd.Series:
    import unicodedata

    return a.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def bigrams(c):
    return F.when(F.char_length(c) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def dice_column(a, b):
    """``dice`` as an expression: the smaller count of every bigram of ``a`` in both."""
    x, y = bigrams(a), bigrams(b)
    times = lambda v, g: F.size(F.filter(v, lambda h: h == g))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(times(x, g), times(y, g)))
    n = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2 * shared / n)


def character_similarity(a, b):
    """The larger of normalised edit similarity (built in) and the bigram Dice coefficient; 0 if either is empty."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    empty = (F.char_length(a) == 0) | (F.char_length(b) == 0)
    return F.when(empty, 0.0).otherwise(F.greatest(1 - F.levenshtein(a, b) / n, dice_column(a, b)))
