"""Text expressions: every function takes Columns or names and returns a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_null(c: Column | str, value: object) -> Column:
    return F.coalesce(col(c), F.lit(value))


def at_least(c: Column | str, value: object) -> Column:
    """The calculator's "greater than", which takes equal values too."""
    return col(c) >= value


def at_most(c: Column | str, value: object) -> Column:
    """The calculator's "less than", which takes equal values too."""
    return col(c) <= value


def reclass_contains(c: Column | str, pairs: list[tuple[str, object]], default: object = -9) -> Column:
    """The value of the last pair whose text the column contains."""
    out = F.lit(default)
    for text, value in pairs:
        out = F.when(col(c).contains(text), F.lit(value)).otherwise(out)
    return out


def concatenate(columns: list[Column | str], separator: str = " ", strip: list[str] | None = None) -> Column:
    """Values with the tokens of ``strip`` removed and trimmed; nulls are empty and keep their separators.

    ``separator``: ``space``, ``comma``, ``none``, or any text."""
    sep = {"space": " ", "comma": ", ", "none": ""}.get(separator, separator)
    parts: list[Column] = []
    for c in columns:
        v = F.coalesce(col(c).cast("string"), F.lit(""))
        for token in strip or []:
            v = F.replace(v, F.lit(token), F.lit(""))
        parts += [F.lit(sep), F.trim(v)]
    return F.concat(*parts[1:])


def join_non_null(columns: list[Column | str], trailing: bool = False) -> Column:
    """Values that aren't null, empty or zero, joined by spaces."""
    kept = [F.when(~F.coalesce(col(c).cast("string"), F.lit("")).isin("", "0", "0.0"), col(c).cast("string")) for c in columns]
    if trailing:
        return F.concat(*[F.coalesce(F.concat(k, F.lit(" ")), F.lit("")) for k in kept])
    return F.concat_ws(" ", *kept)


def split_parts(c: Column | str, separator: str, width: int) -> list[Column]:
    """Trimmed parts; missing ones are empty."""
    parts = F.transform(F.split(col(c), re.escape(separator)), F.trim)
    return [F.coalesce(F.get(parts, i), F.lit("")) for i in range(width)]


def strip_characters(c: Column | str, tokens: list[str] | None = None, punctuation: bool = False, whitespace: bool = False, extra: bool = False, new: str = "") -> Column:
    """Tokens replaced; optionally all punctuation, all whitespace, or runs of 4, 3 and 2 spaces, one pass each."""
    out = col(c)
    for t in tokens or []:
        out = F.replace(out, F.lit(t), F.lit(new))
    if punctuation:
        out = F.regexp_replace(out, "[" + re.escape(PUNCTUATION + "_") + "]", new)
    if whitespace:
        out = F.regexp_replace(out, r"[ \t\n\r\x0b\f]", new)
    if extra:
        for n in (4, 3, 2):
            out = F.replace(out, F.lit(" " * n), F.lit(" "))
    return out


def de_punctuate(c: Column | str, char: str = "_") -> Column:
    """Punctuation other than the underscore, and spaces, become ``char``."""
    return F.regexp_replace(col(c), "[" + re.escape(PUNCTUATION + " ") + "]", char)


def leading_int(c: Column | str) -> Column:
    """Leading digits as a number, else null."""
    return F.when(col(c).rlike("^[0-9]"), F.regexp_extract(col(c), "^([0-9]{1,18})", 1).cast("long"))


def strip_digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[0-9]", "")


def remove_word(c: Column | str, index: int = -1, separator: str = " ") -> Column:
    """Without the word at ``index`` (negative: from the end), joined by single spaces; empty where there is no such word."""
    words = F.split(col(c), re.escape(separator))
    n = F.size(words)
    at = n + index if index < 0 else F.lit(index)
    return F.when((at >= 0) & (at < n), F.array_join(F.filter(words, lambda x, i: i != at), " ")).otherwise(F.lit(""))


def partition_text(c: Column | str) -> Column:
    """The first three characters, ``+``, the rest; cut where the rest first occurs."""
    rest = F.substring(col(c), 4, 1 << 20)
    cut = F.position(rest, col(c))
    return F.when(F.length(col(c)) > 3, F.concat(F.substr(col(c), F.lit(1), cut - 1), F.lit("+"), rest))


def natural_pad(c: Column | str, pad: str = "0000") -> Column:
    """Zeros before the digits: a1 -> a001, a10 -> a010."""
    prefix, digits = F.regexp_extract(col(c), r"^([^0-9]*)", 1), F.regexp_extract(col(c), r"^[^0-9]*(.*)$", 1)
    return F.concat(prefix, F.substr(F.lit(pad), F.lit(1), F.greatest(F.lit(len(pad)) - F.length(col(c)), F.lit(0))), digits)


def natural_key(c: Column | str) -> Column:
    """A sort key under which digit runs compare as numbers: an array of (text, number)."""
    parts = F.regexp_extract_all(col(c), F.lit(r"([0-9]{1,18}|[^0-9]+)"), 1)
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike("^[0-9]"), "").otherwise(p).alias("text"), F.when(p.rlike("^[0-9]"), p.cast("long")).otherwise(F.lit(-1)).alias("number")))


def keep_letters(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^\p{L} ]", "")


def keep_digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^0-9 ]", "")


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def numbers_list(c: Column | str) -> Column:
    """All-digit words, joined by a comma and a space."""
    return F.array_join(F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w.rlike("^[0-9]+$")), ", ")


def letters_label(n: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, ... 701 -> ZZ."""
    one = lambda k: F.char(F.lit(65) + k)
    return F.when(n < 26, one(n)).otherwise(F.concat(one(F.floor(n / 26) - 1), one(n % 26)))


def grid_code(column: Column, row: Column) -> Column:
    """A01, B01, ...: letters by 0-based column, at least two digits by row number."""
    number = row.cast("string")
    return F.concat(letters_label(column), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))


def if_elif_else(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds, else the default."""
    out = F.lit(default)
    for condition, value in reversed(cases):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out
