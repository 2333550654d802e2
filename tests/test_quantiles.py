"""Exact distributed quantiles: equal to numpy/pandas linear interpolation, also with a hot group."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from staylens.functions.stats import exact_quantiles


def _np_q(v, q):
    return float(np.quantile(np.asarray(v, dtype=float), q))


def test_hot_group_and_singletons(spark):
    rng = np.random.default_rng(7)
    hot = rng.integers(0, 500, 3000).astype(float)            # a third of all rows in one group
    rest = rng.normal(100, 30, 6000).round(2)
    groups = ["hot"] * len(hot) + [f"g{i % 50}" for i in range(len(rest))] + ["single"]
    values = list(hot) + list(rest) + [42.0]
    pdf = pd.DataFrame({"g": groups, "v": values})
    df = spark.createDataFrame(pdf).repartition(7)
    out = exact_quantiles(df, "v", {"q1": 0.25, "med": 0.5, "q99": 0.99}, by=["g"], count_col="n").toPandas()
    assert len(out) == pdf.g.nunique()
    for _, r in out.iterrows():
        vals = pdf.loc[pdf.g == r.g, "v"]
        assert r.n == len(vals)
        for name, q in (("q1", 0.25), ("med", 0.5), ("q99", 0.99)):
            assert r[name] == pytest.approx(_np_q(vals, q), rel=1e-12, abs=1e-9)


def test_nulls_nan_and_empty_group(spark):
    pdf = pd.DataFrame({"g": ["a", "a", "a", "b", "b"], "v": [1.0, None, 3.0, None, float("nan")]})
    df = spark.createDataFrame(pdf)
    out = {r.g: r.m for r in exact_quantiles(df, "v", {"m": 0.5}, by=["g"]).collect()}
    assert out == {"a": 2.0}


def test_global(spark):
    v = list(np.arange(1, 1002, dtype=float))
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    r = exact_quantiles(df, "v", {"p": 0.99, "z": 0.0, "o": 1.0}).first()
    assert (r.p, r.z, r.o) == (_np_q(v, 0.99), 1.0, 1001.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.floats(0, 1))
def test_property_matches_numpy(spark, values, q):
    df = spark.createDataFrame([(float(x),) for x in values], "v double")
    got = exact_quantiles(df, "v", {"q": q}).first().q
    assert got == pytest.approx(_np_q(values, q), rel=1e-12, abs=1e-12)
