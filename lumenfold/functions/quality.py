"""Data-quality functions."""

from __future__ import annotations

import math
import random as _random
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col


#: Patterns of what counts as valid.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
SSN = r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"
PHONE = r"^(\+?1[ .-]?)?(\([2-9]\d{2}\)|[2-9]\d{2})[ .-]?[2-9]\d{2}[ .-]?\d{4}$"


def digit(s) -> Column:
    return F.regexp_replace(col(s), "[^0-9]", "")


def whitespace_index(s) -> Column:
    """0-based place of the first white space, -1 without any."""
    return F.regexp_instr(col(s), F.lit(r"\s")) - 1


def random(s, seed: int | None = None) -> Column:
    """The text's characters in random order."""

    @F.pandas_udf("string")
    def mixed(s: pd.Series) -> pd.Series:
        rng = _random.Random(seed)
        return s.map(lambda t: "".join(rng.sample(t, len(t))), na_action="ignore")

    return (mixed if seed is not None else mixed.asNondeterministic())(col(s))


def valid_credit_card(s) -> Column:
    """Luhn's check over 13 to 19 digits; blanks and dashes may part them."""
    plain = F.regexp_replace(col(s), "[ -]", "")
    digits = F.transform(F.split(F.reverse(plain), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    return F.when(plain.rlike("^[0-9]{13,19}$"), total % 10 == 0).when(col(s).isNotNull(), F.lit(False))


def valid_ssn(s) -> Column:
    return col(s).rlike(SSN)


def valid_phone(s) -> Column:
    return col(s).rlike(PHONE)


def valid_email(s) -> Column:
    return col(s).rlike(EMAIL)


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def jaccard_distance(a, b) -> Column:
    """One minus the share of distinct characters that both have."""
    x, y = _characters(col(a)), _characters(col(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(x, y)) / F.when(union > 0, union))


def levenshtein_distance(a, b) -> Column:
    """Edits over the longer length."""
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(col(a), col(b)) / F.when(longest > 0, longest))


def cosine(a: str, b: str) -> float:
    p, q = Counter(a.split()), Counter(b.split())
    if not p or not q:
        return 0.0 if not p and not q else 1.0
    return 1 - sum(n * q[w] for w, n in p.items()) / math.sqrt(sum(n * n for n in p.values()) * sum(n * n for n in q.values()))


def cosine_distance(a, b) -> Column:
    """One minus the cosine of the word counts."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else cosine(x, y) for x, y in zip(a, b)], dtype="float64")

    return distance(col(a), col(b))


def jaro_winkler(x: str, y: str) -> float:
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    reach = max(len(x), len(y)) // 2 - 1
    left, right = [False] * len(x), [False] * len(y)
    for i, c in enumerate(x):
        last = max(0, i + reach + 1)
        j = y.find(c, max(0, i - reach), last)
        while j >= 0 and right[j]:
            j = y.find(c, j + 1, last)
        if j >= 0:
            left[i] = right[j] = True
    p, q = [c for c, m in zip(x, left) if m], [c for c, m in zip(y, right) if m]
    if not p:
        return 0.0
    moved = sum(c != d for c, d in zip(p, q)) / 2
    jaro = (len(p) / len(x) + len(p) / len(y) + (len(p) - moved) / len(p)) / 3
    same = next((k for k, (c, d) in enumerate(zip(x[:4], y[:4])) if c != d), min(4, len(x), len(y)))
    return jaro + 0.1 * same * (1 - jaro)


def jaro_winkler_distance(a, b) -> Column:
    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else 1 - jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")

    return distance(col(a), col(b))
