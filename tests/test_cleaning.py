"""Cleaning: parsing rules, edge values, CSV tokens, the fitted cap."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from staylens.operators import cleaning as C
from staylens.sources import readers, sinks
from staylens.sources.fixtures import listings_raw

from conftest import SF_SMALL


def test_scalar_parsers(spark):
    df = spark.createDataFrame(
        [("95%", "t", "1.5 shared baths", "$1,234.00"), ("0%", "f", "Half-bath", "$0.00"),
         (None, None, None, None), ("100%", "x", "2 baths", "$12.5")],
        "rate string, flag string, baths string, price string")
    out = C.parse_money(C.extract_number(C.flag_to_int(C.percent_to_fraction(df, ["rate"]), ["flag"]),
                                         "baths", "bathrooms"), "price").collect()
    assert [r.rate for r in out] == [0.95, 0.0, None, 1.0]
    assert [r.flag for r in out] == [1, 0, None, None]
    assert [r.bathrooms for r in out] == [1.5, None, None, 2.0]
    assert [r.price for r in out] == [1234.0, 0.0, None, 12.5]


def test_lenient_junk_becomes_null(spark):
    df = spark.createDataFrame([("abc%",)], "rate string")
    assert C.percent_to_fraction(df, ["rate"], lenient=True).first().rate is None
    with pytest.raises(Exception):
        C.percent_to_fraction(df, ["rate"]).collect()


def test_cleaner_on_fixture(spark):
    raw = listings_raw(spark, SF_SMALL)
    model = C.ListingCleaner().fit(raw)
    clean = model.transform(raw)
    rows = clean.count()
    assert rows < raw.count()
    assert clean.where("price <= 0 OR price IS NULL OR room_type IS NULL OR neighbourhood IS NULL").count() == 0
    assert clean.agg(F.max("price")).first()[0] <= model.cap_value
    assert clean.distinct().count() == rows                       # no duplicates left
    assert "bathrooms" in clean.columns and "bathrooms_text" not in clean.columns   # parsed, then dropped
    keyed = C.ListingCleaner(keyCol="id").fit(raw).transform(raw)
    assert keyed.count() == rows and keyed.select("id").distinct().count() == rows


def test_zero_row_table(spark):
    raw = listings_raw(spark, SF_SMALL).where(F.lit(False))
    model = C.ListingCleaner().fit(raw)
    assert model.cap_value is None
    assert model.transform(raw).count() == 0


def test_csv_tokens_and_multiline(spark):
    d = tempfile.mkdtemp(prefix="staylens-csv-")
    path = os.path.join(d, "in.csv")
    with open(path, "w") as f:
        f.write('id,name,price,review_scores_rating\n'
                '1,"two\nlines",$5.00,4.5\n'
                '2,"say ""hi""",N/A,NaN\n'
                '3,NA,,\n')
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("price", T.StringType()), T.StructField("review_scores_rating", T.DoubleType())])
    rows = readers.scan_raw_csv(spark, path, schema=schema).orderBy("id").collect()
    assert rows[0].name == "two\nlines" and rows[0].price == "$5.00"
    assert rows[1].name == 'say "hi"' and rows[1].price is None and rows[1].review_scores_rating is None
    assert rows[2].name is None and rows[2].price is None


def test_require_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="c"):
        readers.require_columns(df, ["a", "c"])
    assert {r.column_name: r.present for r in readers.require_columns(df, ["a", "c"], False).collect()} == \
        {"a": True, "c": False}


def test_dropna_report_counts_rows_and_cells(spark):
    df = spark.createDataFrame([(1.0, "a", None), (None, None, "x"), (2.0, "b", "y")],
                               "price double, room_type string, neighbourhood string")
    r = C.dropna_report(df).first()
    assert (r.rows_before, r.rows_after, r.null_cells_before, r.null_cells_after) == (3, 1, 3, 0)
