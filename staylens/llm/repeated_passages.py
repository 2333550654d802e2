"""Repeated passages across documents with sparse suffixes.

Only suffixes at content-selected positions are retained: the minimisers (smallest hash of eight
words in every window of sixteen positions).  Two copies of a passage of at least ``MIN_WORDS``
words select the same positions in it, the first of them among its first sixteen words, so the
copies share at least ``KEY_WORDS`` = 35 words to the right of it.  Suffixes that share these words
with no other document are dropped early.  Around each of the others (the key) stand up to sixteen windows
of ``MIN_WORDS`` words: k words left of the key, the key, and 15 - k words right of it.  A window is
shared if another document has the same key, left and right words, and a duplicate if an earlier one has;
every window of a longer match has such a position of its own, so the union of these windows is the whole
repeated passage and no context longer than 65 words is ever carried.

Equal texts are collapsed first, and so are suffixes with equal context.  The suffixes of keys with at most
``GROUP_ROWS`` contexts are sorted (key, then the words after it).  Neighbours of one key are compared and their match
is extended right and left; that settles keys of two contexts.  Where a key has more, a suffix's best partners need not
be its neighbours: all windows around the key are compared.  Those of keys with still more contexts are grouped by hash,
aggregated before the shuffle, so a passage that many documents share is not gathered anywhere.

The earliest document (smallest id, then smallest hash of the text) keeps a passage; its later
occurrences in other documents are duplicates.  Repeats within one document are left alone.

Defined results: texts without words (null, empty) and texts below ``MIN_WORDS`` words have no
passages; rows with equal id and text count as one document; null ids sort first; an empty table
gives an empty result; further columns are ignored (``repeated_passages``) or kept
(``remove_repeated``).
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, scratch, slices, stored, unused
from staylens.llm.shingles import digest, range_hashes, with_digest, word_hashes

MIN_WORDS = 50
GRAM, WINDOW = 8, 16
KEY_WORDS = MIN_WORDS - WINDOW + 1
#: Words of context carried on either side of the key.
SIDE = WINDOW - 1
#: Bytes of a word's hash in a context.
WORD_BYTES = 6
#: Contexts of a key that are compared in one task; those of other keys are compared by shuffles.
GROUP_ROWS = 256
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def anchors(words: np.ndarray) -> np.ndarray:
    """Positions of the minimisers with at least ``KEY_WORDS`` words from there on."""
    n = len(words)
    if n < MIN_WORDS:
        return np.zeros(0, np.int64)
    grams = range_hashes(words, np.arange(n - GRAM + 1), GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = windows.argmin(axis=1) + np.arange(len(windows))
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at[at <= n - KEY_WORDS]


def _anchor_rows(plain: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            digests, sizes, keys, at = [], [], [], []
            for raw in b.column(1).to_pylist():
                w = word_hashes(raw or b"")
                p = anchors(w)
                digests.append(digest(raw) if len(w) else None)
                sizes.append(len(w))
                keys.append(range_hashes(w, p, KEY_WORDS).view(np.int64) if len(p) else [])
                at.append(p.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(at, pa.list_(pa.int32()))], ["id", "digest", "n_words", "keys", "at"])

    return map_arrow(plain, run, f"id {kind}, digest binary, n_words int, keys array<long>, at array<int>")


def _contexts(texts: DataFrame) -> DataFrame:
    """(node, at, key, lefts, rights): the key and the words beside it, for the wanted positions of each text.

    Words are ``WORD_BYTES`` of their hashes, big end first; ``lefts`` goes from the key outwards."""
    def run(batches):
        for b in slices(batches, 64):
            cols: list[list] = [[], [], [], [], []]
            for node, raw, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = word_hashes(raw)
                cut = np.ascontiguousarray(w.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES:])
                at = np.sort(np.array(wanted, np.int64))
                cols[0] += [node] * len(at)
                cols[1] += at.tolist()
                cols[2] += range_hashes(w, at, KEY_WORDS).view(np.int64).tolist()
                cols[3] += [cut[max(0, p - SIDE):p][::-1].tobytes() for p in at]
                cols[4] += [cut[p + KEY_WORDS:p + KEY_WORDS + SIDE].tobytes() for p in at]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["node", "at", "key", "lefts", "rights"])

    return map_arrow(texts, run, "node long, at int, key long, lefts binary, rights binary")


def context_windows(lefts: bytes, rights: bytes):
    """(words left of the key, left words, right words) of each window of ``MIN_WORDS`` words around a key."""
    w = WORD_BYTES
    for k in range(max(0, SIDE - len(rights) // w), min(SIDE, len(lefts) // w) + 1):
        yield k, lefts[:w * k], rights[:w * (SIDE - k)]


def common_words(a: bytes, b: bytes) -> int:
    """Words that two contexts share, from the key outwards."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k:k + WORD_BYTES] == b[k:k + WORD_BYTES]:
        k += WORD_BYTES
    return k // WORD_BYTES


def compare_neighbours(lo: list[int], hi: list[int], lefts: list[bytes], rights: list[bytes]):
    """What ``compare_windows`` gives for the two suffixes of a key: the match is extended from the key to both sides."""
    left, right = common_words(*lefts), common_words(*rights)
    match = (left, right) if left + right >= SIDE else (-1, -1)
    result = []
    for i in (0, 1):
        whole = (len(lefts[i]) // WORD_BYTES, len(rights[i]) // WORD_BYTES)
        # A context of several documents matches in all of it, if it holds a window at all.
        if lo[i] < hi[i] and sum(whole) >= SIDE:
            some = whole
        else:
            some = match if min(lo) < max(hi) else (-1, -1)
        result.append([*(match if lo[1 - i] < lo[i] else (-1, -1)), *some])
    return result


def compare_group(lo: list[int], hi: list[int], lefts: list[bytes], rights: list[bytes]):
    """(words left, words right, same of any document) of the counted matches of each suffix of one key, in sorted order.

    ``lo`` and ``hi`` are the first and last document of a context.  The first two are of matches with
    documents before ``lo``; -1: none.  Two neighbours are settled by extending their match; among more, a suffix's
    longest match on one side and its earliest partner need not stand beside it, so all windows are compared."""
    return (compare_neighbours if len(lo) == 2 else compare_windows)(lo, hi, lefts, rights)


def compare_windows(lo: list[int], hi: list[int], lefts: list[bytes], rights: list[bytes]):
    """``compare_group`` by the windows of ``MIN_WORDS`` words around the key, exact for any number of contexts."""
    windows = [list(context_windows(a, b)) for a, b in zip(lefts, rights)]
    first: dict[tuple, int] = {}
    last: dict[tuple, int] = {}
    for n, m, own in zip(lo, hi, windows):
        for x in own:
            first[x] = min(first.get(x, n), n)
            last[x] = max(last.get(x, m), m)
    result = []
    for n, own in zip(lo, windows):
        early = [x[0] for x in own if first[x] < n]
        some = [x[0] for x in own if first[x] < last[x]]
        result.append([y for ks in (early, some) for y in ((max(ks), SIDE - min(ks)) if ks else (-1, -1))])
    return result


def _compared(contents: DataFrame) -> DataFrame:
    """(content, early_left, early_right, any_left, any_right) of the rows (key, content, lo, hi, lefts, rights), suffixes in sorted order."""
    def run(batches):
        rows = (r for b in slices(batches, 4096) for r in zip(*[c.to_pylist() for c in b.columns]))
        out: list[list] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            found = compare_group(*[[r[c] for r in group] for c in (2, 3, 4, 5)])
            out += [[r[1], *f] for r, f in zip(group, found) if f[2] >= 0]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)

    return map_arrow(contents, run, "content long, early_left int, early_right int, any_left int, any_right int")


def _compared_windows(contents: DataFrame) -> DataFrame:
    """What ``_compared`` gives, by grouping the windows of all contexts: no group of a key is ever gathered."""
    words = F.lit(WORD_BYTES)
    each = (contents.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SIDE))))
            .where((F.col("k") * words <= F.length("lefts")) & ((SIDE - F.col("k")) * words <= F.length("rights")))
            .select("content", "lo", "hi", "k", F.xxhash64(
                "key", "k", F.substring("lefts", F.lit(1), F.col("k") * words),
                F.substring("rights", F.lit(1), (SIDE - F.col("k")) * words)).alias("window")))
    shared = each.groupBy("window").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last")
    found = each.join(shared, "window")
    early = F.when(F.col("first") < F.col("lo"), F.col("k"))
    return found.groupBy("content").agg(
        F.coalesce(F.max(early), F.lit(-1)).alias("early_left"), F.coalesce(SIDE - F.min(early), F.lit(-1)).alias("early_right"),
        F.max("k").alias("any_left"), (SIDE - F.min("k")).alias("any_right"))


NAMES = ["content", "early_left", "early_right", "any_left", "any_right"]
TYPES = [pa.int64()] + [pa.int32()] * 4


def merged(spans: DataFrame) -> DataFrame:
    """Union of the intervals (low, high) of equal other columns, in one pass over them in order."""
    of = [c for c in spans.columns if c not in ("low", "high")]
    before = Window.partitionBy(*of).orderBy("low", "high")
    reached = F.max("high").over(before.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached >= F.col("low"), 0).otherwise(1)
    numbered = (spans.withColumn("begins", begins)
                .withColumn("part", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0))))
    return numbered.groupBy(*of, "part").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("part")


def passage_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """rows (id, digest, n_words, first, copies) and spans (digest, duplicate, low, high) of their distinct texts."""
    spark = docs.sparkSession
    with scratch(spark):
        with scratch(spark):
            placed, nodes, found = _placed_contexts(docs, id_col, text_col)
        return stored(placed, "placed", keep=True), stored(_spans(nodes, found), "spans", keep=True)


def _placed_contexts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (id, digest, n_words, first, copies), nodes (node, digest, n_words) and the shared suffixes' contexts."""
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = stored(_anchor_rows(plain, kind).where(F.col("n_words") >= MIN_WORDS), "anchors")
    # One node per distinct text, numbered in the order of the documents.
    heads = (rows.groupBy("digest").agg(F.min(F.struct(F.col("id"))).alias("first"), F.count_distinct("id").alias("ids"),
                                        F.min("n_words").alias("n_words")))
    nodes = stored(heads.orderBy("first", "digest").withColumn("node", F.monotonically_increasing_id()), "nodes", keep=True)
    placed = (rows.select("id", "digest", "n_words").distinct().join(nodes.select("digest", "first", "ids"), "digest")
              .select("id", "digest", "n_words", F.col("id").eqNullSafe(F.col("first.id")).alias("first"),
                      (F.col("ids") > 1).alias("copies")))
    placed = stored(placed, "rows", keep=True)
    marks = rows.groupBy("digest").agg(F.min(F.struct("keys", "at")).alias("m")).select("digest", "m.*")
    # Read twice, by the same exchange: cheaper on disk than a written table of its own.
    suffixes = (marks.join(nodes.select("digest", "node"), "digest")
                .select("node", F.explode(F.arrays_zip("keys", "at")).alias("s"))
                .select("node", F.col("s.keys").alias("key"), F.col("s.at").alias("at")))
    shared = (suffixes.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
              .where("lo < hi").select("key"))
    wanted = suffixes.join(shared, "key").groupBy("node").agg(F.collect_list("at").alias("wanted"))
    distinct = with_digest(plain).groupBy("digest").agg(F.min("text").alias("text"))
    texts = (distinct.join(wanted.join(nodes.select("node", "digest"), "node"), "digest").select("node", "text", "wanted"))
    found = _contexts(texts).withColumn("content", F.xxhash64("key", "lefts", "rights"))
    return placed, nodes.select("node", "digest", "n_words"), stored(found, "contexts", keep=True)


def _spans(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(digest, duplicate, low, high) of the matches around the contexts ``found``."""
    contents = found.groupBy("key", "content").agg(F.min("node").alias("lo"), F.max("node").alias("hi"),
                                                   F.min(F.struct("lefts", "rights")).alias("c"))
    contents = stored(contents.select("key", "content", "lo", "hi", "c.*"), "contents")
    hot = contents.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS).select("key", F.lit(True).alias("hot"))
    placed = contents.join(hot, "key", "left")
    few = placed.where("hot is null").drop("hot").repartition("key").sortWithinPartitions("key", "rights", "lefts")
    many = placed.where("hot").drop("hot")
    compared = stored(_compared(few).unionByName(_compared_windows(many)), "compared")

    firsts = contents.select("content", F.col("lo").alias("first_node"))
    judged = (found.select("node", "at", "content").join(firsts, "content").join(compared, "content", "left"))
    copied = F.col("node") > F.col("first_node")
    # Copies of a whole context match in all of it; so do, from the first one's view, its copies.
    left_all, right_all = F.lit(SIDE), F.lit(SIDE)
    early = F.when(copied, F.struct(left_all.alias("l"), right_all.alias("r"))).when(
        F.col("early_left") >= 0, F.struct(F.col("early_left").alias("l"), F.col("early_right").alias("r")))
    shared_all = found.groupBy("content").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(
        "content", F.lit(True).alias("is_shared"))
    judged = judged.join(shared_all, "content", "left")
    some = F.when(F.col("is_shared"), F.struct(left_all.alias("l"), right_all.alias("r"))).when(
        F.col("any_left") >= 0, F.struct(F.col("any_left").alias("l"), F.col("any_right").alias("r")))

    both = judged.select("node", "at", F.explode(F.array(F.struct(F.lit(True).alias("duplicate"), early.alias("e")),
                                                         F.struct(F.lit(False).alias("duplicate"), some.alias("e")))).alias("x"))
    spans = (both.where("x.e is not null").join(nodes, "node").select(
        "digest", "x.duplicate", F.greatest(F.lit(0), F.col("at") - F.col("x.e.l")).alias("low"),
        F.least(F.col("n_words"), F.col("at") + KEY_WORDS + F.col("x.e.r")).alias("high")))
    return merged(spans)


def document_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, low, high, duplicate): passages in words from ``low`` up to ``high``, per document.

    ``duplicate`` spans repeat an earlier document; the others are all passages shared with any document."""
    rows, spans = passage_tables(docs, id_col, text_col)
    whole = rows.where("copies").select("id", "digest", F.lit(0).alias("low"), F.col("n_words").alias("high"))
    parts = rows.join(spans, "digest")
    every = parts.where("not duplicate").select("id", "digest", "low", "high").unionByName(whole).withColumn("duplicate", F.lit(False))
    later = (parts.where("first and duplicate").select("id", "digest", "low", "high")
             .unionByName(rows.where("copies and not first").select("id", "digest", F.lit(0).alias("low"), F.col("n_words").alias("high")))
             .withColumn("duplicate", F.lit(True)))
    return merged(every.unionByName(later)).select("id", "digest", "low", "high", "duplicate")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, n_words, duplicate) of every repeated passage; see ``document_spans``."""
    with scratch(docs.sparkSession):
        found = document_spans(docs, id_col, text_col).select(
            F.col("id").alias(id_col), F.col("low").alias("start_word"), F.col("high").alias("end_word"),
            (F.col("high") - F.col("low")).alias("n_words"), "duplicate")
        return stored(found, "passages", keep=True)


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` (in order) and the white space after them."""
    starts = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    out, low = [], 0
    for a, b in spans:
        out.append(raw[low:starts[a]])
        low = starts[b]
    return b"".join(out + [raw[low:]]) if low < len(raw) else b"".join(out).rstrip()


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` without the duplicate passages; documents that are left without words go.

    ``size_col``, if there is such a column, is the new text's number of code points."""
    own_id, own_digest, mark_col, cuts_col = unused(docs, "_id", "_digest", "_mark", "_spans")
    with scratch(docs.sparkSession):
        spans = (document_spans(docs, id_col, text_col).where("duplicate")
                 .groupBy(F.col("id").alias(own_id), F.col("digest").alias(own_digest))
                 .agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias(cuts_col)))
        spans = stored(spans, "cuts", keep=True)
    columns = docs.columns
    text_at = columns.index(text_col)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def raw_texts(b):
        return [(t or "").encode("utf-8", "surrogatepass") for t in b.column(text_at).to_pylist()]

    def mark(batches):
        for b in slices(batches):
            digests = pa.array([digest(t) if t.split() else None for t in raw_texts(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, digests], [*columns, mark_col])

    def cut(batches):
        for b in slices(batches):
            texts, kept = [], []
            for t, raw, cuts in zip(b.column(text_at).to_pylist(), raw_texts(b), b.column(len(columns)).to_pylist()):
                if cuts:
                    raw = cut_words(raw, [(c["low"], c["high"]) for c in cuts])
                    t = raw.decode("utf-8", "surrogatepass")
                texts.append(t)
                kept.append(not cuts or bool(raw.split()))
            arrays = [pa.array(texts, pa.string()) if i == text_at else b.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(kept, pa.bool_()))

    marked = map_arrow(docs, mark, f"{schema}, {mark_col} binary")
    joined = (marked.join(spans, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mark_col) == F.col(own_digest)), "left")
              .select(*[F.col(f"`{c}`") for c in columns], cuts_col))
    out = map_arrow(joined, cut, schema)
    if size_col not in columns:
        return out
    return out.withColumn(size_col, F.coalesce(F.length(text_col), F.lit(0)).cast(dict(docs.dtypes)[size_col]))
