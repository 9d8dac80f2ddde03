"""File-safe names and model tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(c: Column, style: str = "strict") -> Column:
    """A file-safe name.

    strict: runs of anything but letters, digits, `_`, `-` and `.` become `_`, ends are freed of `_`, 100 characters;
    paths: slashes and blanks become `_`; readable: only letters, digits, blanks, `.` and `_` stay, no blank at the end.
    """
    if style == "strict":
        return F.left(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit(100))
    if style == "paths":
        return F.translate(c, "/ ", "__")
    if style == "readable":
        return F.rtrim(F.regexp_replace(c, r"[^\p{L}\p{N} ._]", ""))
    raise ValueError(f"unknown style {style!r}")


def model_tag(path: Column, tags: tuple[str, ...] = ("vocal", "violin"), otherwise: str = "unknown") -> Column:
    """The first `_`-separated token of the file name that is a tag, whatever its case."""
    name = F.element_at(F.split(path, "/"), -1)
    tokens = F.split(F.regexp_replace(F.lower(name), r"\.[^.]*$", ""), "_")
    return F.coalesce(F.get(F.filter(tokens, lambda t: t.isin(*tags)), F.lit(0)), F.lit(otherwise))
