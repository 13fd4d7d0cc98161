"""Integers in text: an optional sign and ASCII digits that fit 64 bits; anything else is no integer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2**63), 2**63 - 1
_INT = re.compile(r"[+-]?[0-9]+\Z")


def parse_int(text: str) -> int | None:
    if not _INT.match(text):
        return None
    n = int(text)
    return n if INT_MIN <= n <= INT_MAX else None


def int_value(v: Column) -> Column:
    """The integer or null.  The pattern comes first, as a cast alone accepts spaces."""
    return F.when(v.rlike(r"^[+-]?[0-9]+\z"), v.try_cast("bigint"))


def int_bucket(n: Column) -> Column:
    """A monotone class of an integer: the number of binary digits, negative below zero."""
    low = F.bitwise_not(n)
    return F.when(n > 0, F.length(F.bin(n))).when(n == 0, 0).when(low == 0, -1).otherwise(-1 - F.length(F.bin(low)))


def bucket_of(n: int) -> int:
    return n.bit_length() if n >= 0 else -1 - (~n).bit_length()
