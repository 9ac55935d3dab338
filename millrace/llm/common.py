"""Helpers shared by the operators: records of build, sources, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.broadcast import bounded  # noqa: F401
from ..operators.ranking import ranked  # noqa: F401

def clean_path(path: Column) -> Column:
    """One separator, lower case, no leading ./ ."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"[\\/]+", "/"), r"^(\./)*/?", "")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(clean_path(path), r"/?[^/]*$", "")


def source_of(path: Column) -> Column:
    """The first two folders of a path."""
    return F.regexp_extract(folder_of(path), r"^[^/]*(/[^/]*)?", 0)


ASCII_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, *ASCII_DIGITS)
