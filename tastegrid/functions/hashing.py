"""Reproducible randomness: md5 of the row's own key, the same in every run and in plain SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13                      # 52 bits: exact in a double
_SPAN = float(16 ** _DIGITS)


def _columns(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def hash_key(*cols, seed: int = 42) -> Column:
    """Uniform 32-digit hex key; sorting by it is a seeded shuffle."""
    parts = [c.cast("string") for c in _columns(cols)]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hex_number(key: Column, start: int = 1, digits: int = _DIGITS) -> Column:
    """Hex digits of ``key`` as a bigint."""
    return F.conv(F.substring(key, start, digits), 16, 10).cast("bigint")


def u01(*cols, seed: int = 42) -> Column:
    """Uniform double in [0, 1) from the given columns and the seed."""
    return hex_number(hash_key(*cols, seed=seed)) / F.lit(_SPAN)


def below(share: float, *cols, seed: int = 42) -> Column:
    """u01(*cols) < share, decided by the hex digits as they are."""
    bound = max(math.ceil(share * _SPAN), 0)
    return F.lit(True) if bound >= _SPAN else F.substring(hash_key(*cols, seed=seed), 1, _DIGITS) < F.lit(f"{bound:0{_DIGITS}x}")


def unit_of(key: Column, start: int = 1) -> Column:
    """Uniform double in [0, 1) from 13 digits of a hex key."""
    return hex_number(key, start) / F.lit(_SPAN)


def exponential_of(key: Column, start: int = 1) -> Column:
    """Exp(1) draw from 13 digits of a hex key; the argument of the logarithm is kept above zero."""
    return -F.log((hex_number(key, start) + F.lit(0.5)) / F.lit(_SPAN))
