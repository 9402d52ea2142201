"""String columns: cleaning, delimited lists, identifiers, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Line breaks become spaces, runs of spaces one, ends trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n|\r|\n", " "), " +", " "))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def missing_to_null(c: Column) -> Column:
    """Null, blank and the literal 'nan' are one kind of missing."""
    t = F.trim(c)
    return F.when((t == "") | (F.lower(t) == "nan"), F.lit(None)).otherwise(c)


def entity_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(Q\d+)$", 1), F.lit(""))


def minutes(c: Column) -> Column:
    """Comma list of seconds as whole minutes (truncated); blank gives no element."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.floor(x.try_cast("double") / 60).cast("int"))


def tokens(c: Column) -> Column:
    """Lower-cased white-space tokens."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")


def split_list(c: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def genre_tokens(c: Column) -> Column:
    """Comma list, lower-cased, the word film removed, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.lower(c), ","), lambda x: F.trim(F.regexp_replace(x, "film", ""))), lambda x: x != "")


def file_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, " ", "_"), r'[<>:"/\\|?*]', ""), "_+", "_"), "^_|_$", "")


def short_name(c: Column, most: int = 120) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 10), F.lit("__"), F.substring(F.md5(c), 1, 8))).otherwise(c)


def contains_all(columns: list[Column], keywords: list[str], case_sensitive: bool = False) -> Column:
    """Every keyword (literal, blanks skipped) stands in at least one of the columns; null never matches."""
    out = F.lit(True)
    for k in (k for k in keywords if k.strip()):
        hit = F.lit(False)
        for c in columns:
            c = c if case_sensitive else F.lower(c)
            hit = hit | F.coalesce(F.contains(c, F.lit(k if case_sensitive else k.lower())), F.lit(False))
        out = out & hit
    return out
