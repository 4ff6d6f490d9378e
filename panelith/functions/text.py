"""Names: attributes, tickers and their vendor forms. Columns in, columns out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vendor suffixes of tickers.
SUFFIXES = ("EQUITY", "INDEX", "COMDTY", "CURNCY")


def attribute(c: Column) -> Column:
    """Upper case, blanks as underscores."""
    return F.regexp_replace(F.upper(c), " ", "_")


def attribute_py(x):
    """The same for a Python string or a list of them."""
    if isinstance(x, (list, tuple)):
        return [attribute_py(y) for y in x]
    return x.upper().replace(" ", "_") if isinstance(x, str) else x


def add_suffix(c: Column, suffix: str = "EQUITY") -> Column:
    """Appends the suffix unless one is there."""
    up = F.upper(F.trim(c))
    there = F.lit(False)
    for s in SUFFIXES:
        there = there | up.endswith(F.lit(f" {s}"))
    return F.when(there, up).otherwise(F.concat(up, F.lit(f" {suffix}")))


def remove_suffix(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), rf" ({'|'.join(SUFFIXES)})$", "")


def fx_ticker(price: Column, base: Column) -> Column:
    return F.concat(F.upper(price), F.lit("_"), F.upper(base), F.lit(".FX"))


def fx_to_quote(c: Column) -> Column:
    """``A_B.FX`` as ``BA=X``, or ``A=X`` if the base is USD; other tickers as they are."""
    price, base = F.split(F.regexp_replace(c, r"\.FX$", ""), "_")[0], F.get(F.split(F.regexp_replace(c, r"\.FX$", ""), "_"), F.lit(1))
    return F.when(c.endswith(F.lit(".FX")), F.concat(F.when(base == "USD", F.lit("")).otherwise(base), price, F.lit("=X"))).otherwise(c)


def fx_to_terminal(c: Column) -> Column:
    """``A_B.FX`` as ``BA BGN CURNCY``; other tickers as they are."""
    parts = F.split(F.regexp_replace(c, r"\.FX$", ""), "_")
    return F.when(c.endswith(F.lit(".FX")), F.concat(F.get(parts, F.lit(1)), parts[0], F.lit(" BGN CURNCY"))).otherwise(c)


def split_list(c: Column) -> Column:
    """Comma-separated entries, trimmed, inner blanks as one."""
    return F.transform(F.split(c, ","), lambda x: F.regexp_replace(F.trim(x), r"\s+", " "))


def is_number(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def expiry_of(description: Column) -> Column:
    """The date in ``EXPIRY yyyy-mm-dd``."""
    return F.get(F.split(description, " "), F.lit(1)).try_cast("date")


def snake(name: str) -> str:
    """CamelCase as a table name."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def sheet_name(name: str) -> str:
    """At most 31 characters."""
    return name[:31]


def join_tickers(c: Column) -> Column:
    return F.concat_ws(" ", F.array_sort(F.collect_list(c)))
