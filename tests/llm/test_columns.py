"""Columns of the input keep their names and values, also those that helper columns would have."""

from frames import odd_docs
from pyspark.sql import functions as F

from staylens.llm.mixing import mix_sources
from staylens.llm.near_duplicates import drop_near_duplicates
from staylens.llm.repeated_passages import remove_repeated

NAMES = ["_mix_source", "_mix_cdf", "_mix_u", "_MIX_N", "_mark", "_id", "_Digest", "_n", "_spans"]


def clashing(spark):
    df = odd_docs(spark)
    for i, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(i))
    return df


def checked(df, got):
    rows = got.select(*df.columns).collect()
    assert rows and all([r[name] for name in NAMES] == list(range(len(NAMES))) for r in rows)
    return len(rows)


def test_mixing_keeps_columns(spark):
    df = clashing(spark)
    assert checked(df, mix_sources(df)) == mix_sources(odd_docs(spark)).count()


def test_near_duplicates_keep_columns(spark):
    df = clashing(spark)
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert checked(df, got) == drop_near_duplicates(odd_docs(spark)).count()


def test_repeated_passages_keep_columns(spark):
    df = clashing(spark)
    got = remove_repeated(df)
    assert got.columns == df.columns
    assert checked(df, got) == remove_repeated(odd_docs(spark)).count()
