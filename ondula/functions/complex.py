"""Complex numbers as ``struct<re,im>`` columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def multiply(a: Column, b: Column) -> Column:
    return pack(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conjugate(a: Column) -> Column:
    return pack(a["re"], -a["im"])


def modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def unit(phi: Column) -> Column:
    """exp(i phi)."""
    return pack(F.cos(phi), F.sin(phi))


def scale(a: Column, k: Column) -> Column:
    return pack(a["re"] * k, a["im"] * k)


def shift_phase(s: Column, df: Column, dp: Column, time: Column) -> Column:
    """s exp(2 pi i df t + i dp)."""
    return multiply(s, unit(2 * math.pi * df * time + dp))
