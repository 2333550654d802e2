"""Small helper for pyspark.ml Estimators/Models written in Python."""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable


class Persistable(DefaultParamsReadable, DefaultParamsWritable):
    """Mixin: save/load through the ML writer (state must live in Params)."""
