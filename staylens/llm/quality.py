"""Quality rules: word and repetition rules, and bands of n-gram perplexity per language.

The language model is a modified Kneser-Ney model of character 4-grams (lower case, the four code
points of a gram packed into one 64-bit key), one per language, counted by Spark over the whole
corpus: tasks count the grams of their rows, a shuffle sums them, and the lower orders, discounts
and interpolation weights follow from the table of distinct grams by DataFrame operations.  As the
model is counted over the very texts it scores, every gram that is looked up is in it; its own
occurrence is left out of the counts that give its probability, lest every text predict itself.

Scoring looks grams up in sorted arrays of keys.  The model is cut into shards of at most
``SHARD_GRAMS`` grams, so what is broadcast at a time has a fixed bound; one pass over the texts
adds the log-probabilities of one shard.  A document's score is its log-perplexity, the mean of
-ln p over its characters.  Each language accepts a band around the median of its documents that
pass the word rules; documents above (unlike the language) or below (machine-like repetition) go.
The band's width comes from the median absolute deviation, and documents with equal figures (copies)
count once, so neither an unlike source with a third of a language's rows nor a crowd of copies
moves the centre out of the usual writing or widens the band beyond it.  As the model is counted over
the corpus itself, it also knows writing that many documents share: the bands reject what is unlike
the rest of its language, not a large source of another kind (code, tables) as such.

Defined results: null texts hold no word; a text without words fails the word rules; null languages
form a language of their own; a language whose documents all fail the word rules has no band and
rejects none by perplexity; repeated rows are judged alike (one row each); code points beyond
U+FFFF count as U+FFFD in the model; an empty table gives an empty result; further columns stay
as they are in ``filter_quality`` and are ignored by ``judge_quality``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import drop_memos, map_arrow, scratch, slices, stored

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The band reaches so many median absolute deviations from the median, at least FLOOR nats.
BAND_DEVIATIONS, BAND_FLOOR = 12.0, 0.4
SHARD_GRAMS = 4_000_000
#: Characters whose grams are held at a time.
WINDOW_CHARS = 400_000
START, END = 2, 3  # code points of text borders inside the model


def word_rules(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text."""
    words = raw.split()
    n = len(words)
    inside = raw.translate(None, SPACES)
    chars = len(inside.decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if n > 3:
        codes: dict[bytes, int] = {}
        c = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
        if len(codes) < 1 << 21:
            key = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        else:
            _, key = np.unique((c[:-2] << 31) | c[1:-1], return_inverse=True)
            _, key = np.unique((key.astype(np.int64) << 31) | c[2:], return_inverse=True)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= again
        repeats = int(covered.sum())
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats


def gram_windows(texts: list[str]):
    """(numbers of texts, start of each in the keys, keys) over bounded runs of characters.

    A key packs four code points; keys whose last one is a start sign are left out.  A long text
    comes in several windows that overlap by three characters."""
    def keys(parts: list[np.ndarray], numbers: list[int]):
        joined = np.concatenate(parts)
        k = (joined[:-3] << 48) | (joined[1:-2] << 32) | (joined[2:-1] << 16) | joined[3:]
        sizes = np.array([len(p) - 3 for p in parts])
        starts = np.cumsum(sizes + 3) - (sizes + 3)
        keep = np.ones(len(k), bool)
        for d in range(3):  # windows that reach over the border of two parts
            at = starts[1:] - 3 + d
            keep[at] = False
        return numbers, np.cumsum(sizes) - sizes, k[keep]

    parts, numbers, held = [], [], 0
    pad, end = np.full(3, START, np.uint64), np.full(1, END, np.uint64)
    for i, text in enumerate(texts):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        points[points > 0xFFFF] = 0xFFFD
        points = np.concatenate([pad, points, end])
        for low in range(0, len(points) - 3, WINDOW_CHARS):
            part = points[low:low + WINDOW_CHARS + 3]
            parts.append(part)
            numbers.append(i)
            held += len(part)
            if held >= WINDOW_CHARS:
                yield keys(parts, numbers)
                parts, numbers, held = [], [], 0
    if parts:
        yield keys(parts, numbers)


def by_language(langs: list) -> dict:
    groups: dict = {}
    for i, lang in enumerate(langs):
        groups.setdefault(lang, []).append(i)
    return groups


def added(keys: np.ndarray, counts: np.ndarray, more: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with counts, and those of ``more``, as one."""
    k = np.concatenate([keys, *[m[0] for m in more]])
    if not len(k):
        return keys, counts
    c = np.concatenate([counts, *[m[1] for m in more]])
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(c, first).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of ``docs`` (lang, text), summed by task and then by Spark."""
    def run(batches):
        drop_memos()
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1)
            for lang, rows in by_language(langs).items():
                keys, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
                for low in range(0, len(rows), 512):
                    for _, _, k in gram_windows([t or "" for t in texts.take(pa.array(rows[low:low + 512])).to_pylist()]):
                        waiting.append(np.unique(k, return_counts=True))
                        if len(waiting) == 4:
                            keys, counts = added(keys, counts, waiting)
                            waiting = []
                keys, counts = added(keys, counts, waiting)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    return (map_arrow(docs.select("lang", "text"), run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, gram, logp) of modified Kneser-Ney interpolation over the stored table (lang, gram, n), each
    gram's probability in the counts without one of its occurrences (the one that is looked up).

    The counts and probabilities of each lower order are stored, as the next one and its discounts read them:
    as one plan they would be computed several times, with some thirty shuffles waiting in the driver at once."""
    # Counts by order: corpus counts for 4-grams, numbers of distinct left neighbours below.
    tables = {4: grams}
    for k in (3, 2, 1):
        tables[k] = stored(tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram"))
                           .agg(F.count(F.lit(1)).alias("n")), "quality-counts")
    same_lang = F.col("lang").eqNullSafe(F.col("of"))
    types = tables[1].groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("v"))
    below = None
    for k in (1, 2, 3, 4):
        n = F.col("n")
        of = tables[k].groupBy(F.col("lang").alias("of")).agg(
            *[F.sum(F.when(n == c, 1).otherwise(0)).cast("double").alias(f"n{c}") for c in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # Where a count of counts is missing, the plain discount n1 / (n1 + 2 n2), or one half.
        plain = F.when(F.col("n1") > 0, y).otherwise(0.5)
        usual = F.least(*[F.col(f"n{c}") for c in (1, 2, 3, 4)]) > 0
        d = [F.when(usual, F.least(F.greatest(c - (c + 1) * y * F.col(f"n{c + 1}") / F.col(f"n{c}"), F.lit(0.05)), F.lit(c - 0.05)))
             .otherwise(plain).alias(f"d{c}") for c in (1, 2, 3)]
        discounts = of.select("of", *d)
        table = (tables[k].withColumn("context", F.shiftrightunsigned("gram", 16))
                 .join(discounts, same_lang).drop("of"))
        cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        after = Window.partitionBy("lang", "context")  # one row for each following character at most
        table = (table.withColumn("cut", cut).withColumn("total", F.sum("n").over(after))
                 .withColumn("rest", F.sum("cut").over(after) / F.col("total")))
        if k == 1:
            even = 1 / (F.col("v") + 1)
            table = table.join(types, same_lang).withColumn("lower", even).withColumn("lower_without", even).drop("of", "v")
        else:
            mask = F.lit((1 << (16 * (k - 1))) - 1)
            low = below.select(F.col("lang").alias("of"), F.col("gram").alias("tail"), F.col("p").alias("lower"),
                               F.col("q").alias("lower_without"))
            table = table.join(low, same_lang & (F.col("gram").bitwiseAND(mask) == F.col("tail"))).drop("of", "tail")
        fewer = n - 1
        cut_fewer = F.when(fewer == 0, 0).when(fewer == 1, F.col("d1")).when(fewer == 2, F.col("d2")).otherwise(F.col("d3"))
        # A gram seen once is gone without this time, and its tail then has one left neighbour less.
        lower = F.when(n == 1, F.col("lower_without")).otherwise(F.col("lower"))
        without = F.when(F.col("total") > 1, (fewer - cut_fewer) / (F.col("total") - 1) + F.col("rest") * lower).otherwise(lower)
        below = table.select("lang", "gram", ((n - F.col("cut")) / F.col("total") + F.col("rest") * F.col("lower")).alias("p"),
                             without.alias("q"))
        if k < 4:
            below = stored(below, "quality-lower")
    return below.select("lang", "gram", F.log("q").alias("logp"))


def _lookup(df: DataFrame, schema: str, model: DataFrame, shard: int) -> DataFrame:
    """Add to ``cost`` the -ln p of the grams whose probability this shard holds."""
    spark = df.sparkSession
    arrow = model.where(F.col("shard") == shard).select("lang", "gram", "logp").toArrow()
    arrays = {}
    for lang in set(arrow.column("lang").to_pylist()):
        mine = arrow.filter(pc.is_null(arrow["lang"]) if lang is None else pc.equal(arrow["lang"], lang))
        key, value = mine["gram"].to_numpy().view(np.uint64), mine["logp"].to_numpy()
        order = np.argsort(key)
        arrays[lang] = (key[order], value[order].astype(np.float32))
    sent = spark.sparkContext.broadcast(arrays)

    def run(batches):
        drop_memos()
        for b in slices(batches, 512):
            langs, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            cost = np.array(b.column(3).to_pylist(), np.float64)
            size = np.zeros(len(langs), np.int64)
            for lang, rows in by_language(langs).items():
                key, value = sent.value.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
                for numbers, starts, k in gram_windows([texts[i] or "" for i in rows]):
                    if len(key):
                        at = np.searchsorted(key, k)
                        at[at == len(key)] = 0
                        logp = np.where(key[at] == k, value[at], 0.0).astype(np.float64)
                    else:
                        logp = np.zeros(len(k))
                    sums, ends = np.add.reduceat(logp, starts), np.append(starts[1:], len(k))
                    for i, s, e0, e1 in zip(numbers, sums, starts, ends):
                        cost[rows[i]] -= s
                        size[rows[i]] += e1 - e0
            stats = b.column(4) if shard else pa.array([dict(zip(RULES, word_rules((t or "").encode("utf-8", "surrogatepass"))))
                                                        for t in texts], RULE_TYPE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cost), stats, pa.array(size)],
                                             ["id", "lang", "text", "cost", "rules", "grams"])

    return map_arrow(df, run, schema)


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULE_TYPE = pa.struct([(c, pa.int64()) for c in RULES])
_RULES_SQL = "struct<" + ", ".join(f"{c}: bigint" for c in RULES) + ">"


def perplexity_bands(judged: DataFrame) -> DataFrame:
    """(of, low, high) of every language ``of`` of the rows (lang, the five counts, log_perplexity)."""
    # Scores have three decimals, so a language has few different ones, whatever its number of rows.
    scores = (judged.select("lang", *RULES, "log_perplexity").distinct()
              .groupBy(F.col("lang").alias("of"), "log_perplexity").agg(F.count(F.lit(1)).alias("n")))
    centres = scores.groupBy(F.col("of").alias("lang")).agg(F.percentile("log_perplexity", F.lit(0.5), F.col("n")).alias("centre"))
    away = scores.join(centres, F.col("of").eqNullSafe(F.col("lang"))).drop("lang")
    reach = F.greatest(F.lit(BAND_FLOOR), BAND_DEVIATIONS * F.percentile(F.abs(F.col("log_perplexity") - F.col("centre")), F.lit(0.5), F.col("n")))
    return (away.groupBy("of").agg(F.first("centre").alias("centre"), reach.alias("reach"))
            .select("of", (F.col("centre") - F.col("reach")).alias("low"), (F.col("centre") + F.col("reach")).alias("high")))


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rest: list[str] | None) -> DataFrame:
    """(id, row, text, the five counts, base_failed, log_perplexity, kept); ``row`` and ``text`` with ``rest`` only."""
    carried = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.col(id_col)
    rows = docs.select(carried.alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession):
        grams = stored(count_grams(rows), "quality-grams")
        model = kneser_ney(grams)
        shards = max(1, -(-grams.count() // SHARD_GRAMS))
        model = stored(model.withColumn("shard", F.pmod(F.xxhash64("lang", "gram"), F.lit(shards)).cast("int")), "quality-model", keep=True)
    schema = f"id {dict(rows.dtypes)['id']}, lang string, text string, cost double, rules {_RULES_SQL}, grams long"
    scored = rows.withColumn("cost", F.lit(0.0)).withColumn("rules", F.lit(None).cast(_RULES_SQL)).withColumn("grams", F.lit(0))
    for shard in range(shards):
        scored = _lookup(scored, schema, model, shard)
        if shard < shards - 1:
            scored = stored(scored, "quality-pass")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # Three decimals: the exact quartiles then need a bounded number of distinct values.
    judged = stored(scored.select("id", "lang", *(["text"] if rest else []), "rules.*",
                                  F.round(F.col("cost") / F.col("grams"), 3).alias("log_perplexity"))
                    .withColumn("base_failed", failed), "quality-scores")
    bands = perplexity_bands(judged.where(~F.col("base_failed")))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return (judged.join(stored(bands, "quality-bands"), F.col("lang").eqNullSafe(F.col("of")), "left")
            .withColumn("kept", ~F.col("base_failed") & inside))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, the five counts, base_failed, log_perplexity, kept) of every row of ``docs``."""
    return _judged(docs, id_col, text_col, lang_col, None).select(
        F.col("id").alias(id_col), *RULES, "base_failed", "log_perplexity", "kept")


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The kept rows of ``docs``, with all their columns."""
    rest = [c for c in docs.columns if c != text_col]
    kept = _judged(docs, id_col, text_col, lang_col, rest).where("kept")
    return kept.select(*[(F.col("text") if c == text_col else F.col("id")[c]).alias(c) for c in docs.columns])
