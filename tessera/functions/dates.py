"""Date, time and coordinate-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col


def date_part(c: Column | str) -> Column:
    """``YYYY-MM-DD`` of a timestamp."""
    return F.date_format(col(c), "yyyy-MM-dd")


def date_text(c: Column | str) -> Column:
    """``YYYY-MM-DD`` of text such as ``2017-6-7 10:00``: parts zero-padded, time dropped."""
    parts = F.split(F.split(F.trim(col(c)), " ").getItem(0), "-")
    two = lambda i: F.lpad(parts.getItem(i), 2, "0")
    return F.concat(parts.getItem(0), F.lit("-"), two(1), F.lit("-"), two(2))


def time_part(c: Column | str) -> Column:
    """``HH h MM m SS.ss s``; seconds five wide, their hundredths rounded in binary as C's ``round`` does (1.005 s: 100.49... of them)."""
    hundredths = (F.date_format(col(c), "ss").cast("int") + F.date_format(col(c), "SSSSSS").cast("double") / 1e6) * 100
    seconds = F.floor(hundredths) + (hundredths - F.floor(hundredths) >= 0.5).cast("int")
    return F.format_string("%s h %s m %6.2f s", F.date_format(col(c), "HH"), F.date_format(col(c), "mm"), seconds / 100)


def add_interval(c: Column | str, hours: int = 0, days: int = 0) -> Column:
    return col(c) + F.make_dt_interval(F.lit(days), F.lit(hours))


def _parts(c: Column) -> tuple[Column, Column, Column]:
    """Whole degrees, minutes and seconds of the absolute value, seconds to a millionth."""
    total = F.round(F.abs(c) * 3600, 6)
    return F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600.0)) / 60), F.pmod(total, F.lit(60.0))


def to_dms(c: Column | str, longitude: bool = True, use_sign: bool = False, use_quad: bool = True) -> Column:
    """``D-M-SS.ss`` with a sign or a quadrant letter."""
    v = col(c)
    d, m, s = _parts(v)
    quad = F.when(v < 0, "W" if longitude else "S").otherwise("E" if longitude else "N")
    sign = F.when(v < 0, "-").otherwise("")
    return F.concat(sign if use_sign else F.lit(""), F.format_string("%d-%d-%05.2f", d, m, s), quad if use_quad else F.lit(""))


def to_dms_symbols(c: Column | str) -> Column:
    """``DDD° MM' SS.ssss"`` with the sign on the degrees."""
    v = col(c)
    d, m, s = _parts(v)
    return F.concat(F.when(v < 0, "-").otherwise(" "), F.format_string("%03d° %02d' %07.4f\"", d, m, s))


def to_dmm(c: Column | str, longitude: bool = True) -> Column:
    """``D M.mm' Q``: degrees, decimal minutes, quadrant."""
    v = col(c)
    d = F.floor(F.abs(v))
    quad = F.when(v < 0, "W" if longitude else "S").otherwise("E" if longitude else "N")
    return F.concat(F.format_string("%d %.2f' ", d, (F.abs(v) - d) * 60), quad)


def from_text(c: Column | str, separator: str = " ") -> Column:
    """Degrees of ``D M.m`` or ``D M S.s``; positive only where the degrees are above zero."""
    parts = F.transform(F.split(F.trim(col(c)), separator), lambda p: p.cast("double"))
    d = parts.getItem(0)
    rest = F.coalesce(F.get(parts, 1), F.lit(0.0)) / 60 + F.coalesce(F.get(parts, 2), F.lit(0.0)) / 3600
    return F.when(d > 0, 1.0).otherwise(-1.0) * (F.abs(d) + rest)
