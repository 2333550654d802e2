"""Scans and catalog checks (A1-A5, A10)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.scalar import PANDAS_NA_TOKENS, na_to_null, quoted
from staylens.session import default_parallelism

# Schema of the raw listings file as our fixture writes it; a production file
# with more columns gets its own schema (the cleaner ignores absent columns).
RAW_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("host_id", T.LongType()), T.StructField("host_name", T.StringType()),
    T.StructField("host_response_rate", T.StringType()), T.StructField("host_acceptance_rate", T.StringType()),
    T.StructField("host_is_superhost", T.StringType()), T.StructField("host_listings_count", T.LongType()),
    T.StructField("calculated_host_listings_count", T.LongType()), T.StructField("neighbourhood", T.StringType()),
    T.StructField("room_type", T.StringType()), T.StructField("property_type", T.StringType()),
    T.StructField("accommodates", T.IntegerType()), T.StructField("bathrooms_text", T.StringType()),
    T.StructField("bedrooms", T.LongType()), T.StructField("beds", T.LongType()),
    T.StructField("minimum_nights", T.LongType()), T.StructField("number_of_reviews", T.LongType()),
    T.StructField("review_scores_rating", T.DoubleType()), T.StructField("price", T.StringType()),
])


def _csv_reader(spark: SparkSession, multiline: bool):
    return (spark.read.option("header", True).option("multiLine", multiline)
            .option("escape", '"').option("quote", '"').option("mode", "FAILFAST"))


def _typed(name: str, kind: T.DataType, na_tokens: Sequence[str], strict: bool) -> Column:
    """A text column as ``kind``; missing-value tokens are NULL.

    Whole numbers may come as ``3.0`` (how a column of integers with gaps is often
    written).  Other text in a numeric column fails the query, or is NULL if not ``strict``.
    """
    text = na_to_null(F.col(quoted(name)), ("", *na_tokens))
    if isinstance(kind, T.StringType):
        return text
    number = F.trim(text)
    if isinstance(kind, T.IntegralType):
        as_double = number.try_cast("double")
        value = F.coalesce(number.try_cast(kind), F.when(as_double == F.floor(as_double), as_double.try_cast(kind)))
    else:
        value = number.try_cast(kind)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
            # "nan" in any spelling is missing, not junk.
            text = F.when(F.lower(number) != "nan", text)
    if not strict:
        return value
    problem = F.concat(F.lit(f"column {name}: not a value of type {kind.simpleString()}: "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(problem).cast(kind)).otherwise(value)


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, value, odd) of the physical lines: the byte range each was read in, its order
    in it, and whether it holds an odd number of quotes.  The ranges are those of Spark's text scan."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("n"), "value", quotes.bitwiseAND(1).alias("odd"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the records of CSV files, found from any place of them; ``first`` marks headers.

    A line end is inside quotes if an odd number of quotes stands before it.  One pass adds up the parity
    of each byte range; the running parity of the few ranges of a file says whether a range begins inside quotes,
    and running parities of its lines where its records begin.  Only the lines of records of several
    lines are brought together, to where their record began.  So a file is read by as many tasks as it has
    ranges, and no group is larger than a range or a record.

    Quotes must be those of RFC 4180: around whole fields, doubled inside.  A record with any other fails the
    query, as its parity would mislead.  Records end by ``\\n`` or ``\\r\\n``; empty ones are left out, and line
    ends inside quotes stay as they stand.
    """
    lines = _csv_lines(spark, path)
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = (lines.groupBy("file", "block").agg(F.bit_xor("odd").alias("odd"))
              .withColumn("opens", F.coalesce(F.sum("odd").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).bitwiseAND(1))
              .select("file", "block", "opens"))
    in_block = Window.partitionBy("file", "block").orderBy("n")
    earlier = F.coalesce(F.sum("odd").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (lines.join(blocks, ["file", "block"])
              .withColumn("inside", (earlier + F.col("opens")).bitwiseAND(1) == 1)
              .withColumn("nth", F.sum((~F.col("inside")).cast("long")).over(in_block.rowsBetween(Window.unboundedPreceding, 0))))
    alone = placed.where("not inside and odd = 0").select(
        "file", ((F.col("block") == 0) & (F.col("nth") == 1)).alias("first"), F.col("value").alias("record"))
    # What stands in a range before its first record belongs to the last record begun in an earlier one.
    parts = placed.where("inside or odd = 1")
    begun = placed.groupBy("file", "block").agg(F.max("nth").alias("last")).select(
        "file", "block", *[F.lag(F.last(F.when(F.col("last") > 0, F.col(c)), True).over(in_file)).over(in_file).alias(name)
                           for c, name in (("block", "of_block"), ("last", "of_nth"))])
    own = F.col("nth") > 0
    owned = (parts.join(begun, ["file", "block"])
             .select("file", F.when(own, F.col("block")).otherwise(F.col("of_block")).alias("of_block"),
                     F.when(own, F.col("nth")).otherwise(F.col("of_nth")).alias("of_nth"), F.struct("block", "n", "value").alias("line")))
    joined = owned.groupBy("file", "of_block", "of_nth").agg(F.array_sort(F.collect_list("line")).alias("lines")).select(
        "file", ((F.col("of_block") == 0) & (F.col("of_nth") == 1)).alias("first"), F.array_join("lines.value", "\n").alias("record"))
    records = alone.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r$", "")).where("record != ''")
    # Quoted parts become one mark: it must fill its field, and no quote may be left.
    bare = F.regexp_replace("record", r'"[^"]*"', "\u0001")
    wrong = F.contains("record", F.lit('"')) & (F.contains(bare, F.lit('"')) | F.rlike(bare, F.lit("[^,\u0001]\u0001|\u0001[^,\u0001]")))
    problem = F.concat(F.lit("quote inside an unquoted field (read it with ranges=False): "), F.substring("record", 1, 200))
    return records.withColumn("record", F.when(wrong, F.raise_error(problem)).otherwise(F.col("record")))


def _records_by_range(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``path`` parsed to text columns, named by its header."""
    head = _csv_reader(spark, True).option("inferSchema", False).csv(path)
    names = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(head.columns))])
    rule = {"multiLine": "true", "escape": '"', "quote": '"', "mode": "FAILFAST", "maxCharsPerColumn": "-1"}
    parsed = F.from_csv("record", names.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), rule)
    rows = csv_records(spark, path).select("first", parsed.alias("r"))
    same = reduce(Column.__and__, [F.col(f"r.c{i}").eqNullSafe(F.lit(None if c == f"_c{i}" else c)) for i, c in enumerate(head.columns)])
    data = rows.where(~F.col("first") | F.when(same | (F.lit(len({c.lower() for c in head.columns})) < len(head.columns)), False)
                      .otherwise(F.raise_error(F.lit(f"headers differ below {path}")).cast("boolean")))
    return data.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(head.columns)])


def scan_raw_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW_SCHEMA,
                 na_tokens: Sequence[str] = PANDAS_NA_TOKENS, multiline: bool = True, strict: bool = True,
                 ranges: bool = True) -> DataFrame:
    """A1: raw CSV bound to ``schema`` by header name, with quoted multi-line text.

    Every column is read as text, so nothing is lost to a failed typed parse, and then cast
    (``_typed``).  Columns the file lacks are NULL; columns the schema lacks are left out.  Each
    path has a header of its own; the files below one path must agree on theirs.  Multi-line files are
    read by byte ranges (``csv_records``); with ``ranges=False``, for files with stray quotes, a file is
    one task to read and its rows are dealt out again.
    """
    frames = []
    for p in [path] if isinstance(path, str) else list(path):
        if multiline and ranges:
            raw = _records_by_range(spark, p)
        else:
            raw = _csv_reader(spark, multiline).option("enforceSchema", False).csv(p)
            raw = raw.repartition(default_parallelism(spark)) if multiline else raw
        have = set(raw.columns)
        frames.append(raw.select(*[
            (_typed(f.name, f.dataType, na_tokens, strict) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields]))
    return reduce(DataFrame.unionByName, frames)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def scan_first_existing(spark: SparkSession, paths: Sequence[str], **opts) -> DataFrame:
    """A2: the first existing candidate path (checked on the Hadoop file system)."""
    for p in paths:
        if path_exists(spark, p):
            return scan_raw_csv(spark, p, **opts)
    raise FileNotFoundError(f"none of {list(paths)} exists")


def scan_csv_infer(spark: SparkSession, path: str) -> DataFrame:
    """A3: header + inferSchema (an extra pass over the file; explicit schemas are preferred)."""
    return _csv_reader(spark, False).option("inferSchema", True).csv(path)


def column_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, present, non_null): the rows with a value in each column, in one aggregate; 0 if absent."""
    have = set(df.columns)
    counts = [(F.count(quoted(c)) if c in have else F.lit(0).cast("bigint")).alias(f"n{i}") for i, c in enumerate(names)]
    items = [F.struct(F.lit(c).alias("column_name"), F.lit(c in have).alias("present"), F.col(f"n{i}").alias("non_null"))
             for i, c in enumerate(names)]
    return df.agg(F.count(F.lit(1)).alias("_rows"), *counts).select(F.inline(F.array(*items)))


def require_columns(df: DataFrame, required: Sequence[str], raise_missing: bool = True) -> DataFrame:
    """A5: fail if a required column is missing; otherwise (column_name, present, non_null) of each."""
    missing = [c for c in required if c not in df.columns]
    if missing and raise_missing:
        raise ValueError(f"missing required columns: {missing}")
    return column_counts(df, required)


def save_feature_catalog(spark: SparkSession, features: Sequence[str], path: str) -> None:
    """A10: the feature list as a (position, feature) parquet table."""
    spark.createDataFrame(list(enumerate(features)), "position int, feature string") \
        .coalesce(1).write.mode("overwrite").parquet(path)


def load_feature_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def infer_feature_names(df: DataFrame, exclude: Sequence[str] = ("price", "log_price")) -> list[str]:
    """The numeric columns besides the targets, in column order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def load_or_infer_features(spark: SparkSession, path: str, df: DataFrame) -> list[str]:
    """A10: the saved feature list if there is one and ``df`` has all of its columns; otherwise
    the numeric columns of ``df``, which are saved in its place."""
    if path_exists(spark, path):
        # One row per feature: a list of column names, as long as the schema at most.
        saved = [r["feature"] for r in load_feature_catalog(spark, path).orderBy("position").collect()]
        if saved and set(saved) <= set(df.columns):
            return saved
    names = infer_feature_names(df)
    save_feature_catalog(spark, names, path)
    return names


def validate_feature_catalog(catalog: DataFrame, df: DataFrame) -> DataFrame:
    """A10: (position, feature, present, non_null) of every catalogued feature."""
    names = [r["feature"] for r in catalog.orderBy("position").collect()]
    counts = column_counts(df, names).withColumnRenamed("column_name", "feature")
    return catalog.join(counts, "feature").select("position", "feature", "present", "non_null")
