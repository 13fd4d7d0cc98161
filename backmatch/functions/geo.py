"""H3 cells as bits of a long, and great-circle distances, in Python and as columns.

Fixed values are those of the public H3 cell layout: from the high end, one
reserved bit, 4 bits of mode (1 for cells), 3 reserved bits, 4 bits of
resolution, 7 bits of base cell (below 122), then 15 digits of 3 bits, 7
where unused.  Twelve base cells are pentagons without a subsequence whose
first non-zero digit is 1.  The radius is that of the authalic sphere.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6371007.180918475
#: The base cells that are pentagons.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
_CELL = re.compile(r"[0-9a-fA-F]{1,16}\Z")
_REAL = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_POINT = re.compile(rf"({_REAL}),({_REAL})\Z")
POINT_PATTERN = rf"^({_REAL}),({_REAL})\z"
_RADIUS = re.compile(rf"({_REAL},{_REAL}),([0-9]+)\Z")
ONES = (1 << 45) - 1


def resolution(cell: int) -> int:
    return cell >> 52 & 15


def valid_cell(c: int) -> bool:
    res = resolution(c)
    digits = [c >> 3 * (14 - i) & 7 for i in range(15)]
    if c >> 59 != 1 or c >> 56 & 7 or (base := c >> 45 & 127) > 121:
        return False
    if any(d == 7 for d in digits[:res]) or any(d != 7 for d in digits[res:]):
        return False
    return base not in PENTAGONS or next((d for d in digits[:res] if d), 0) != 1


def parse_cell(text: str) -> int | None:
    if not _CELL.match(text):
        return None
    c = int(text, 16)
    return c if valid_cell(c) else None


def parent(cell: int, res: int) -> int | None:
    if resolution(cell) < res:
        return None
    return cell & ~(15 << 52) | res << 52 | (1 << 3 * (15 - res)) - 1


def parse_point(text: str) -> tuple[float, float] | None:
    m = _POINT.match(text)
    if not m:
        return None
    at = float(m[1]), float(m[2])
    return at if all(map(math.isfinite, at)) else None


def parse_within(text: str) -> tuple[float, float, int] | None:
    m = _RADIUS.match(text)
    at = m and parse_point(m[1])
    return (*at, int(m[2])) if at and int(m[2]) < 2**63 else None


def distance(a: tuple[float, float], b: tuple[float, float]) -> float:
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def cell_value(v: Column) -> Column:
    """The cell as a long, or null if the text is no valid cell."""
    c = F.when(v.rlike(r"^[0-9a-fA-F]{1,16}\z"), F.conv(v, 16, 10).try_cast("bigint"))
    res = F.shiftright(c, 52).bitwiseAND(F.lit(15))
    digits = c.bitwiseAND(F.lit(ONES))
    base = F.shiftright(c, 45).bitwiseAND(F.lit(127))
    # the digits as octal text, padded: 15 characters, those beyond the resolution are 7
    octal = F.lpad(F.conv(digits.cast("string"), 10, 8), 15, "0")
    used, rest = F.left(octal, res), F.right(octal, F.lit(15) - res)
    well = (F.shiftright(c, 59) == 1) & (F.shiftright(c, 56).bitwiseAND(F.lit(7)) == 0) & (base < 122) & ~used.contains("7") & (F.translate(rest, "7", "") == "")
    return F.when(well & ~(base.isin(*PENTAGONS) & used.rlike("^0*1")), c)


def cell_parent(c: Column, res: Column) -> Column:
    """The ancestor at ``res`` (0 to 15), null if the cell is coarser."""
    own = F.shiftright(c, 52).bitwiseAND(F.lit(15))
    kept = c.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.call_function("shiftleft", res.cast("bigint"), F.lit(52)))
    return F.when(own >= res, kept.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(3) * (F.lit(15) - res)).cast("int")) - F.lit(1)))


def point_value(v: Column) -> Column:
    """lat, lng of ``"lat,lng"``, or null."""
    lat, lng = F.substring_index(v, ",", 1).try_cast("double"), F.substring_index(v, ",", -1).try_cast("double")
    return F.when(v.rlike(POINT_PATTERN) & (F.abs(lat) < math.inf) & (F.abs(lng) < math.inf), F.struct(lat.alias("lat"), lng.alias("lng")))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return F.lit(2 * RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
