"""Scalar column expressions used by the cleaning operators (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and tokens of the listing format.
NUMBER_PATTERN = r"(\d+(\.\d+)?)"
MONEY_STRIP_PATTERN = r"[$,]"
TRUE_FLAG = "t"
FALSE_FLAG = "f"
# Tokens a pandas CSV reader turns into missing values by default.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                    "nan", "null")


def _to_double(c: Column, lenient: bool) -> Column:
    return c.try_cast("double") if lenient else c.cast("double")


def percent_to_fraction(c: Column, lenient: bool = False) -> Column:
    """'95%' -> 0.95; null stays null.  ANSI cast raises on junk unless lenient."""
    return _to_double(F.regexp_replace(c, r"%+$", ""), lenient) / F.lit(100.0)


def flag_to_int(c: Column) -> Column:
    """'t' -> 1, 'f' -> 0, anything else -> null."""
    return F.when(c == F.lit(TRUE_FLAG), F.lit(1)).when(c == F.lit(FALSE_FLAG), F.lit(0)) \
        .otherwise(F.lit(None).cast("int"))


def flag_default_false(c: Column) -> Column:
    """'t'/true -> 1, everything else (including null) -> 0."""
    s = c.cast("string")
    return F.when(s.isin(TRUE_FLAG, "true"), F.lit(1)).otherwise(F.lit(0))


def extract_number(c: Column, lenient: bool = False) -> Column:
    """First decimal number inside the text, as double; null when there is none."""
    return _to_double(F.nullif(F.regexp_extract(c, NUMBER_PATTERN, 1), F.lit("")), lenient)


def parse_money(c: Column, lenient: bool = False) -> Column:
    """'$1,234.00' -> 1234.0."""
    return _to_double(F.regexp_replace(c, MONEY_STRIP_PATTERN, ""), lenient)


def na_to_null(c: Column, tokens=PANDAS_NA_TOKENS) -> Column:
    """Map the missing-value tokens of a pandas reader to SQL NULL."""
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(c: Column) -> Column:
    """NaN is a value in Spark; statistics want it as NULL."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def quoted(name: str) -> str:
    """A column name for ``F.col`` that may hold dots and backticks."""
    return "`" + name.replace("`", "``") + "`"


def x_of(name: str) -> Column:
    """A numeric column as double with NaN as NULL."""
    return nan_to_null(F.col(quoted(name)).cast("double"))
