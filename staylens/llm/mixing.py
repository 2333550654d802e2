"""Mixing sources to target weights by Poisson replication.  DataFrame functions only.

A source's repetition rate is its target share of the mixture over its share of the input (both in
characters).  Every document draws a Poisson count with that mean: a uniform number from a hash of
seed and document id is put through the inverse of the Poisson distribution function.  Documents
are exploded by their count, and the copies shuffled globally by another hash.

The table of rates (one row per source, with the distribution function up to where it can't be
told from 1 by the 52-bit uniform number) is written first; the planner then joins it by its known
size, broadcasting only below the session's threshold.

Defined results: rows with a null source are a source of their own, and so are empty names;
null and empty texts count no characters; a source without characters repeats at rate 1; rows with
one id (also null ids) draw one count; a source missing from ``weights`` gets weight 0 and is left
out; an empty table gives an empty result; columns named ``mix_copy`` and ``mix_key`` are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import stored, unused

SEED = 20
#: Without given weights, a source's target share is its share to this power, normalised.
TEMPERATURE = 0.5
HEX_DIGITS, UNIT = 13, 2.0**-52


def uniform(*parts):
    """A number in (0, 1) from a hash of the parts."""
    digest = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, HEX_DIGITS)
    return (F.conv(digest, 16, 10).cast("long") + 0.5) * UNIT


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = 1.0,
                 source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, chars, rate): each source's repetition rate for a mixture of ``size`` times the input."""
    by = (docs.groupBy(F.col(source_col).alias("source"))
          .agg(F.sum(F.coalesce(F.length(F.col(text_col)), F.lit(0))).cast("double").alias("chars")))
    if weights is None:
        target = F.when(F.col("chars") > 0, F.pow(F.col("chars"), TEMPERATURE)).otherwise(0.0)
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(target)
    by = by.withColumn("target", target)
    # The totals are one row; ties in summation order don't matter for whole numbers of characters.
    totals = by.where("chars > 0").agg(F.sum("chars").alias("c"), F.sum("target").alias("t"))
    rate = F.when(F.col("chars") > 0, F.col("target") / totals.select("t").scalar()
                  * totals.select("c").scalar() * size / F.col("chars")).otherwise(F.lit(1.0))
    if weights is not None:
        rate = F.when(F.col("target") > 0, rate).otherwise(0.0)
    return by.select("source", "chars", F.round(rate, 9).alias("rate"))


def poisson_cdf(rate):
    """P(X <= k) for k = 0, 1, ... as an array, up to where it is 1 to 52 bits."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")

    def step(s, k):
        log_factorial = s["f"] + F.log(k.cast("double"))
        p = F.exp(-rate + k * F.log(rate) - log_factorial)
        return F.struct(F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"), log_factorial.alias("f"))

    first = F.struct(F.array(F.exp(-rate)).alias("cdf"), F.lit(0.0).alias("f"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), first, step, lambda s: s["cdf"])).otherwise(F.array(F.lit(1.0)))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = 1.0, seed: int = SEED,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, with ``mix_copy`` (from 1) and ``mix_key``; rows are in the order of ``mix_key``."""
    docs = docs.drop("mix_copy", "mix_key")
    source, cdf, draw, n = unused(docs, "_mix_source", "_mix_cdf", "_mix_u", "_mix_n")
    rates = stored(source_rates(docs, weights, size, source_col, text_col)
                   .select(F.col("source").alias(source), poisson_cdf(F.col("rate")).alias(cdf)), "mix-rates")
    u = uniform(F.lit(seed), F.col(id_col))
    drawn = (docs.join(rates, F.col(source_col).eqNullSafe(F.col(source)))
             .withColumn(draw, u)
             .withColumn(n, F.size(F.filter(cdf, lambda c: c < F.col(draw))))
             .drop(source, cdf, draw).where(F.col(n) > 0))
    copies = drawn.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                            F.col("mix_copy").cast("string")))
    return copies.withColumn("mix_key", key).orderBy("mix_key", "mix_copy")
