"""Cleaning operators (B1-B20) and the ListingCleaner / PriceCap estimators.

Every step is a projection or filter over the input plan, so a whole cleaning
run compiles into one scan plus whole-stage-codegen projections; only the price
cap (an exact quantile) and deduplication need a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructField, StructType, StringType, LongType, BooleanType

from staylens.functions import scalar
from staylens.functions.stats import exact_quantiles
from staylens.operators.params import Persistable

# Default columns the cleaner drops.
DEFAULT_DROP_COLS = ["id", "name", "description", "amenities", "host_name", "host_id",
                     "host_since", "first_review", "last_review", "calendar_last_scraped",
                     "latitude", "longitude", "bathrooms_text"]
RATE_COLS = ["host_response_rate", "host_acceptance_rate"]
FLAG_COLS = ["host_is_superhost"]
KEY_COLS = ["price", "room_type", "neighbourhood"]


def drop_columns(df: DataFrame, cols: Sequence[str] = DEFAULT_DROP_COLS) -> DataFrame:
    """B1: drop the listed columns that exist."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present)


def percent_to_fraction(df: DataFrame, cols: Sequence[str] = RATE_COLS, lenient: bool = False) -> DataFrame:
    """B2: '95%' -> 0.95 for the listed columns that exist."""
    return df.withColumns({c: scalar.percent_to_fraction(F.col(c), lenient) for c in cols if c in df.columns})


def flag_to_int(df: DataFrame, cols: Sequence[str] = FLAG_COLS) -> DataFrame:
    """B3: 't' -> 1, 'f' -> 0, else null."""
    return df.withColumns({c: scalar.flag_to_int(F.col(c)) for c in cols if c in df.columns})


def extract_number(df: DataFrame, src: str = "bathrooms_text", dst: str = "bathrooms",
                   lenient: bool = False) -> DataFrame:
    """First number inside ``src`` into ``dst`` (double, null if none)."""
    if src not in df.columns:
        return df
    return df.withColumn(dst, scalar.extract_number(F.col(src), lenient))


def parse_money(df: DataFrame, col: str = "price", lenient: bool = False) -> DataFrame:
    """Strip '$' and ',' and cast to double."""
    if col not in df.columns:
        return df
    return df.withColumn(col, scalar.parse_money(F.col(col), lenient))


def positive_filter(df: DataFrame, col: str = "price") -> DataFrame:
    """Keep rows with a positive value (nulls fall out)."""
    return df.where(F.col(col) > 0)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Drop fully duplicated rows.  Partial aggregation collapses copies map-side,
    so a value repeated in a third of the table never reaches one task as rows."""
    return df.dropDuplicates()


def dropna_key_columns(df: DataFrame, cols: Sequence[str] = KEY_COLS) -> DataFrame:
    """Drop rows with a null in any of the key columns (that exist)."""
    present = [c for c in cols if c in df.columns]
    return df.dropna(subset=present) if present else df


def dropna_report(df: DataFrame, cols: Sequence[str] = KEY_COLS) -> DataFrame:
    """B9 report (Q14): rows and null cells before and after the drop, in one aggregate."""
    present = [c for c in cols if c in df.columns]
    kept = F.lit(True)
    cells = F.lit(0)
    for c in present:
        kept = kept & F.col(c).isNotNull()
        cells = cells + F.when(F.col(c).isNull(), F.lit(1)).otherwise(F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after"),
                  F.sum(cells).cast("bigint").alias("null_cells_before"),
                  F.sum(F.when(kept, cells).otherwise(F.lit(0))).cast("bigint").alias("null_cells_after"))


def log_target(df: DataFrame, col: str = "price", out: str = "log_price") -> DataFrame:
    """``out = log1p(col)``."""
    return df.withColumn(out, F.log1p(F.col(col)))


def select_existing(df: DataFrame, candidates: Sequence[str], target: str | None = None) -> DataFrame:
    """Keep the candidate columns that exist (plus the target)."""
    keep = [c for c in candidates if c in df.columns]
    if target is not None and target in df.columns and target not in keep:
        keep.append(target)
    return df.select(*keep)


def flag_default_false(df: DataFrame, cols: Sequence[str] = FLAG_COLS) -> DataFrame:
    """Flag to 0/1 with missing as 0."""
    return df.withColumns({c: scalar.flag_default_false(F.col(c)) for c in cols if c in df.columns})


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of all numeric columns (every NumericType), minus ``exclude``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]


def select_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """B13 as a frame: the numeric columns only."""
    return df.select(*numeric_columns(df, exclude))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls (and NaN) to 0 in the listed columns."""
    return df.withColumns({c: F.coalesce(scalar.nan_to_null(F.col(c)) if _is_fractional(df, c) else F.col(c),
                                         F.lit(0).cast(df.schema[c].dataType))
                           for c in cols if c in df.columns})


def _is_fractional(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("double", "float")


def ensure_column(df: DataFrame, cols: Sequence[str], value: int = 0) -> DataFrame:
    """Add constant columns for names that are absent."""
    return df.withColumns({c: F.lit(value) for c in cols if c not in df.columns})


def segment_filter(df: DataFrame, segment_id, col: str = "cluster") -> DataFrame:
    """Rows of one segment (prunes partitions when the table is partitioned by ``col``)."""
    return df.where(F.col(col) == F.lit(segment_id))


def min_segment_size(df: DataFrame, col: str = "cluster", n: int = 20) -> DataFrame:
    """Segment sizes with a ``keep`` flag (size >= n); one grouped count."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows")) \
        .withColumn("keep", F.col("rows") >= F.lit(n))


def rename_prediction(df: DataFrame, new: str, old: str = "prediction") -> DataFrame:
    """B18."""
    return df.withColumnRenamed(old, new)


def residuals(df: DataFrame, label: str, prediction: str = "prediction", out: str = "residual") -> DataFrame:
    """``label - prediction``."""
    return df.withColumn(out, F.col(label) - F.col(prediction))


def shape_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns before and after, as one small frame (two count jobs)."""
    spark = before.sparkSession
    b = before.agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit("before")) \
        .withColumn("columns", F.lit(len(before.columns)).cast("bigint"))
    a = after.agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit("after")) \
        .withColumn("columns", F.lit(len(after.columns)).cast("bigint"))
    return b.unionByName(a)


# --------------------------------------------------------------------------------------
# Estimators


class _PriceCapParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "column to cap")
    quantile = Param(Params._dummy(), "quantile", "quantile learned as the cap")
    cap = Param(Params._dummy(), "cap", "learned cap value")


class PriceCap(Estimator, _PriceCapParams, Persistable):
    """Learn the exact q-quantile of ``inputCol`` (over positive values); keep rows <= cap."""

    def __init__(self, inputCol: str = "price", quantile: float = 0.99):
        super().__init__()
        self._set(inputCol=inputCol, quantile=float(quantile))

    def _fit(self, df: DataFrame) -> "PriceCapModel":
        col = self.getOrDefault("inputCol")
        q = self.getOrDefault("quantile")
        row = exact_quantiles(positive_filter(df, col), col, {"cap": q}).first()
        cap = None if row is None else row["cap"]
        return PriceCapModel(col, q, cap)


class PriceCapModel(Model, _PriceCapParams, Persistable):
    def __init__(self, inputCol: str = "price", quantile: float = 0.99, cap: float | None = None):
        super().__init__()
        self._set(inputCol=inputCol, quantile=float(quantile))
        if cap is not None:
            self._set(cap=float(cap))

    @property
    def cap_value(self) -> float | None:
        return self.getOrDefault("cap") if self.isDefined("cap") else None

    def _transform(self, df: DataFrame) -> DataFrame:
        col = self.getOrDefault("inputCol")
        cap = self.cap_value
        if cap is None:  # nothing positive was seen: no row can pass
            return df.where(F.lit(False))
        return df.where((F.col(col) > 0) & (F.col(col) <= F.lit(cap)))


class _CleanerParams(Params):
    dropCols = Param(Params._dummy(), "dropCols", "columns to drop")
    priceQuantile = Param(Params._dummy(), "priceQuantile", "quantile used as price cap")
    logTarget = Param(Params._dummy(), "logTarget", "add log_price")
    lenient = Param(Params._dummy(), "lenient", "unparseable text becomes null instead of failing")
    cap = Param(Params._dummy(), "cap", "learned price cap")
    keyCol = Param(Params._dummy(), "keyCol", "row key kept through cleaning ('' = none)")


def _parse(df: DataFrame, lenient: bool, drop_cols: Sequence[str], key: str = "") -> DataFrame:
    df = extract_number(df, "bathrooms_text", "bathrooms", lenient)  # parse before the drop (Q1)
    df = drop_columns(df, [c for c in drop_cols if c != key])
    df = percent_to_fraction(df, RATE_COLS, lenient)
    df = flag_to_int(df, FLAG_COLS)
    return parse_money(df, "price", lenient)


class ListingCleaner(Estimator, _CleanerParams, Persistable):
    """The cleaning sequence as an Estimator: the price cap is learned once in ``fit``."""

    def __init__(self, dropCols: Sequence[str] | None = None, priceQuantile: float = 0.99,
                 logTarget: bool = True, lenient: bool = False, keyCol: str = ""):
        super().__init__()
        self._set(dropCols=list(dropCols or DEFAULT_DROP_COLS), priceQuantile=float(priceQuantile),
                  logTarget=bool(logTarget), lenient=bool(lenient), keyCol=keyCol)

    def _fit(self, df: DataFrame) -> "ListingCleanerModel":
        parsed = _parse(df, self.getOrDefault("lenient"), self.getOrDefault("dropCols"))
        cap = PriceCap("price", self.getOrDefault("priceQuantile")).fit(parsed).cap_value
        return ListingCleanerModel(self.getOrDefault("dropCols"), self.getOrDefault("priceQuantile"),
                                   self.getOrDefault("logTarget"), self.getOrDefault("lenient"), cap,
                                   self.getOrDefault("keyCol"))


class ListingCleanerModel(Model, _CleanerParams, Persistable):
    def __init__(self, dropCols=None, priceQuantile: float = 0.99, logTarget: bool = True,
                 lenient: bool = False, cap: float | None = None, keyCol: str = ""):
        super().__init__()
        self._set(dropCols=list(dropCols or DEFAULT_DROP_COLS), priceQuantile=float(priceQuantile),
                  logTarget=bool(logTarget), lenient=bool(lenient), keyCol=keyCol)
        if cap is not None:
            self._set(cap=float(cap))

    @property
    def cap_value(self) -> float | None:
        return self.getOrDefault("cap") if self.isDefined("cap") else None

    def parsed(self, df: DataFrame) -> DataFrame:
        return _parse(df, self.getOrDefault("lenient"), self.getOrDefault("dropCols"), self.getOrDefault("keyCol"))

    def _transform(self, df: DataFrame) -> DataFrame:
        out = PriceCapModel("price", self.getOrDefault("priceQuantile"), self.cap_value).transform(self.parsed(df))
        key = self.getOrDefault("keyCol")
        if key:
            # Duplicates apart from the key collapse to one row carrying the smallest key.
            rest = [F.col(f"`{c}`") for c in out.columns if c != key]
            out = out.groupBy(*rest).agg(F.min(key).alias(key))
        else:
            out = drop_duplicates(out)
        out = dropna_key_columns(out, KEY_COLS)
        if self.getOrDefault("logTarget"):
            out = log_target(out)
        return out
