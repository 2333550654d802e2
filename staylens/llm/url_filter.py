"""URL filter: host and path rules, then a character language-model ratio.  DataFrame functions only.

URLs that a rule judges are the training rows: one smoothed variable-order Markov model of the
characters of host and path for accepted URLs, one for rejected ones.  The order-k probability
interpolates with the order below it (Witten-Bell):

    P_k(c | h) = (n(h c) + t(h) P_{k-1}(c | h')) / (n(h) + t(h)),   h' = h without its first character,

with t(h) the distinct characters seen after h, P_k = P_{k-1} where h was never seen, and the
uniform distribution over ``ALPHABET`` below order 0.  A URL scores the mean over its characters
of ln P(accepted) - ln P(rejected).  The threshold is calibrated on a fold of the ruled URLs that
the models don't count: halfway between the score buckets with the best balanced accuracy and
the bucket below it.

All counting runs over distinct (host, path) pairs with their row counts, pre-aggregated, so a
hot URL or host is one row; n-gram tables are joined by shuffles (``by_shuffle``), never broadcast.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and verdict
allow; ties between buckets go to the lowest one; with no accepted or no rejected URL to calibrate
on every unruled URL is allowed; repeated rows are judged alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import stored

#: Rules (verdict, pattern); a pattern is a host, then the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
ORDER = 4
ALPHABET = 256
#: The calibration fold: one in FOLDS of the ruled (host, path) pairs, by hash.
FOLDS = 5
#: Score buckets of 1 / BUCKETS nats a character.
BUCKETS = 100
PAD = "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATTERN, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATTERN, 2)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null: none fits)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, pattern in sorted(rules, key=lambda r: len(r[1])):
        at = pattern.find("/")
        h, p = (pattern, "") if at < 0 else (pattern[:at], pattern[at:])
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as one side of a sort-merge join.  The planner takes a stored table for as large as its compressed file
    and exploded rows for no more than the row they come from, so without a hint it collects millions of rows for
    a broadcast."""
    return df.hint("merge")


def position_grams(texts: DataFrame, order: int) -> DataFrame:
    """One row per character: the character with the ``order`` characters before it."""
    padded = F.concat(F.lit(PAD * order), F.col("host"), F.col("path"))
    length = F.length(F.col("host")) + F.length(F.col("path"))
    return texts.where(length > 0).withColumn("padded", padded).withColumn(
        "gram", F.explode(F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(F.col("padded"), i, F.lit(order + 1))))
    ).drop("padded")


def gram_ratios(grams: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): ln P(accepted) - ln P(rejected) of the last character of every gram seen."""
    counts = stored(grams.groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")), "url-grams")
    below = None
    for k in range(order + 1):
        table = (counts.groupBy(F.right(F.col("gram"), F.lit(k + 1)).alias("gram"))
                 .agg(F.sum("a").alias("a"), F.sum("r").alias("r")) if k < order else counts)
        after = Window.partitionBy("context")  # holds one row a character at most
        table = table.withColumn("context", F.left(F.col("gram"), F.lit(k)))
        for c in "ar":
            table = (table.withColumn(f"n{c}", F.sum(c).over(after))
                     .withColumn(f"t{c}", F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(after)))
        if k == 0:
            table = table.withColumns({f"q{c}": F.lit(1.0 / ALPHABET) for c in "ar"})
        else:
            table = by_shuffle(table.withColumn("tail", F.right(F.col("gram"), F.lit(k)))).join(
                below.select(F.col("gram").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr")), "tail")
        below = table.select("gram", *[
            F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"t{c}")))
            .otherwise(F.col(f"q{c}")).alias(f"p{c}") for c in "ar"])
    return below.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def calibrated(scored: DataFrame) -> DataFrame:
    """One row: the lowest bucket that is allowed, by the best balanced accuracy on the calibration fold."""
    by = scored.where("calibrates and score is not null").groupBy("bucket").agg(
        F.sum("accepted_rows").alias("a"), F.sum("rejected_rows").alias("r"))
    # Buckets are bounded by the scores' range: |score| < ln(ALPHABET * rows) nats.
    below = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    middle = F.ceil((F.col("bucket") + F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.col("bucket"))) / 2)
    lifted = by.select("bucket", middle.alias("middle"), F.coalesce(F.sum("r").over(below), F.lit(0)).alias("blocked"),
                       F.coalesce(F.sum("a").over(below), F.lit(0)).alias("lost"),
                       F.sum("a").over(every).alias("all_a"), F.sum("r").over(every).alias("all_r"))
    gain = F.round(F.col("blocked") / F.col("all_r") - F.col("lost") / F.col("all_a"), 9)
    return (lifted.where("all_a > 0 and all_r > 0").select("bucket", "middle", gain.alias("gain"))
            .agg(F.max(F.struct("gain", (-F.col("bucket")).alias("low"), "middle")).alias("best"))
            .select(F.col("best.middle").alias("threshold")))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row of ``pages``; score is null for empty URLs."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    texts = (rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"))
             .withColumn("rule", rule).withColumn("ruled", verdict)
             .withColumn("calibrates", F.col("ruled").isNotNull() & (
                 F.conv(F.substring(F.md5(F.concat("host", "path")), 1, 7), 16, 10).cast("long") % FOLDS == 0))
             .withColumn("accepted_rows", F.when(F.col("ruled") == "allow", F.col("rows")).otherwise(0))
             .withColumn("rejected_rows", F.when(F.col("ruled") == "block", F.col("rows")).otherwise(0)))
    texts = stored(texts.select("host", "path", "rule", "ruled", "calibrates", "accepted_rows", "rejected_rows"), "url-texts")
    trains = ~F.col("calibrates")
    grams = position_grams(texts.select(
        "host", "path", F.when(trains, F.col("accepted_rows")).otherwise(0).alias("accepted"),
        F.when(trains, F.col("rejected_rows")).otherwise(0).alias("rejected")), order)
    ratios = gram_ratios(grams, order)
    scores = (by_shuffle(position_grams(texts.select("host", "path"), order)).join(ratios, "gram")
              .groupBy("host", "path").agg(F.avg("ratio").alias("score")))
    scored = stored(by_shuffle(texts).join(scores, ["host", "path"], "left")
                    .withColumn("bucket", F.floor(F.col("score") * BUCKETS)), "url-scores")
    judged = scored.select("host", "path", "rule", "score", F.coalesce(
        "ruled", F.when(F.col("bucket") < calibrated(scored).scalar(), "block").otherwise("allow")).alias("verdict"))
    return by_shuffle(rows).join(judged, ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score")
