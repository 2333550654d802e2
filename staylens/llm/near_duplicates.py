"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is the sequence of its runs of five words, labelled with their occurrence number, so that
each is unique in the text.  An Order MinHash sketch samples the ``SAMPLE`` smallest labelled runs
under a hash permutation and keeps them in text order; two texts share it with about the power
``SAMPLE`` of their similarity, and only if the sampled runs come in the same order.  Every sketch
is a band of its own: with 24 of them a pair of long texts of similarity 0.8 is missed once in 300,000.
Of few runs, sketches sample nearly all, so short texts have a further, exact band: near-duplicates of at
most 17 runs together are equal but for one run, and each such text is keyed by its runs and by its runs
without each one.  The worst pair left to sketches (8 of 10 runs in common) is missed once in 17,000.

Two texts are near-duplicates if an alignment of their labelled runs matches at least ``THRESHOLD``
of the union: matched / (runs of one + runs of the other - matched) >= 0.8.  The alignment is the
longest chain of equal runs in increasing positions, within the band that the threshold leaves.

Equal texts (by a 128-bit hash of their words) are first collapsed into one node.  Candidates are
never all pairs of a bucket.  First every node is compared with the smallest node of each of its
buckets (a star); a bucket whose nodes then lie in one component has nothing more to tell.  In the
others every two nodes of different components are looked at by their run parities: for each of
``MARK_BITS`` hash values, whether an odd number of runs has it.  Two texts' parities differ in at most
as many places as their runs do, so a pair that differs in more than the threshold leaves is none, and
only the rest is verified.  A bucket above ``BLOCK`` rows is dealt into blocks; every two blocks meet
in a task group of their own, so a hot bucket spreads over many tasks, and only candidates leave it.
A round verifies a row's ``NEAREST`` candidates first, lest two large components that one link joins
give all their pairs; rounds go on, each with ``NEAREST_GROWTH`` times more, until none was put off.  So every
two texts that share a band are verified, ruled out by a bound, or already of one class.

Defined results: a text without words (null, empty, white space) is a class of its own; a text of
fewer than five words is one run, so it only matches equal word sequences; repeated rows and rows
with equal ids are separate members; the class id is the smallest id of the class (of the row itself
for null ids: null); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, scratch, slices, stored, unused
from staylens.llm.components import components
from staylens.llm.shingles import MULTIPLIER, digest, kmers, labelled, mix, with_digest, word_hashes

WORDS = 5
THRESHOLD = 0.8
SKETCHES = 24
SAMPLE = 4
#: Rows of a mixed bucket that meet in one group, and bits of a text's run parities.
BLOCK = 512
MARK_BITS = 1024
#: Pairs of rows that a task looks at in one go, but for a single group with more.
PAIRS_AT_ONCE = 1 << 18
#: Nearest candidates of a row in the first round over mixed buckets; in later rounds so many times more.
NEAREST, NEAREST_GROWTH = 4, 16


def runs(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The labelled runs of a UTF-8 text, in order."""
    return labelled(kmers(word_hashes(raw), words))


def order_minhash(x: np.ndarray, sketches: int = SKETCHES, sample: int = SAMPLE) -> np.ndarray:
    """One hash per sketch: the ``sample`` smallest runs under its permutation, in text order."""
    n = len(x)
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * MULTIPLIER)
    ranked = (x[None, :] ^ seeds[:, None]) * (seeds[:, None] | np.uint64(1))
    ranked ^= ranked >> np.uint64(32)
    size = min(sample, n)
    at = np.argpartition(ranked, size - 1, axis=1)[:, :size] if size < n else np.tile(np.arange(n), (sketches, 1))
    at.sort(axis=1)
    out = seeds.copy()
    for j in range(size):
        out = mix(out * MULTIPLIER + x[at[:, j]])
    return out


def longest_short(threshold: float = THRESHOLD) -> int:
    """Runs of the longest text that the exact band of short texts holds: with its near-duplicates of fewer
    runs, it has too few runs for two of them to be unmatched."""
    if threshold >= 1:
        return 0
    return int(np.ceil(2 * (1 + threshold) / (1 - threshold) - 1e-9)) // 2


def short_keys(x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Hashes of the sequence of runs, and of it without each of them, as far as the threshold lets one run be unmatched."""
    n = len(x)
    every = np.broadcast_to(x, (n, n))[~np.eye(n, dtype=bool)].reshape(n, n - 1)
    whole, less = np.full(1, n, np.uint64), np.full(n, n - 1, np.uint64)
    for j in range(n):
        whole = mix(whole * MULTIPLIER + x[j:j + 1])
        if j < n - 1:
            less = mix(less * MULTIPLIER + every[:, j])
    fits = [y for y, longer in ((whole, n + 1), (less, n)) if longer - 1 >= threshold * longer - 1e-9]
    return np.unique(np.concatenate([x[:0], *fits]))


def aligned_similarity(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of the union of runs that a banded alignment matches; below ``threshold``, an upper bound of it."""
    total = len(x) + len(y)
    if not total:
        return 0.0
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return min(len(x), len(y)) / max(len(x), len(y))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(i) < threshold * (total - len(i)):
        return len(i) / (total - len(i))
    # Matching m runs leaves total - 2 m unmatched, so no matched pair lies further off the diagonal.
    band = total - 2 * int(np.ceil(threshold * total / (1 + threshold)))
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    chain = j[np.argsort(i)]
    if len(chain) and (np.diff(chain) < 0).any():
        ends: list[int] = []
        for p in chain.tolist():
            k = bisect_left(ends, p)
            ends[k:k + 1] = [p]
        matched = len(ends)
    else:
        matched = len(chain)
    return matched / (total - matched)


def sketch_rows(docs: DataFrame, kind: str, sketches: int, sample: int, words: int, threshold: float) -> DataFrame:
    """(id, digest, bands) of every row; digest and bands are null for texts without words.  What follows
    the sketches in ``bands`` are the keys of a short text."""
    short = longest_short(threshold)

    def run(batches):
        for b in slices(batches):
            digests, bands = [], []
            for raw in b.column(1).to_pylist():
                x = runs(raw or b"", words)
                if len(x):
                    digests.append(digest(raw))
                    band = order_minhash(x, sketches, sample)
                    bands.append((np.concatenate([band, short_keys(x, threshold)]) if len(x) <= short else band).view(np.int64))
                else:
                    digests.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                                             ["id", "digest", "bands"])

    return map_arrow(docs, run, f"id {kind}, digest binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """The pairs (a, b) whose texts are near-duplicates; ``texts`` (node, text) is stored."""
    def run(batches):
        last, x = None, None
        for b in slices(batches, 64):
            a_ids, b_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            kept, scores = [], []
            for i, (node, one, two) in enumerate(zip(a_ids, b.column(2).to_pylist(), b.column(3).to_pylist())):
                if node != last:
                    last, x = node, runs(one, words)
                score = aligned_similarity(x, runs(two, words), threshold)
                if score >= threshold:
                    kept.append(i)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array([a_ids[i] for i in kept], pa.int64()),
                                              pa.array([b_ids[i] for i in kept], pa.int64()), pa.array(scores, pa.float64())],
                                             ["a", "b", "similarity"])

    sided = (pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
             .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
             .select("a", "b", "text_a", "text_b").sortWithinPartitions("a"))
    return map_arrow(sided, run, "a long, b long, similarity double")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Each node of a bucket (key, node) with the bucket's smallest node."""
    leaders = buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a != last").drop("last")
    return buckets.select("key", "node").join(leaders, "key").where("node != a").select("a", F.col("node").alias("b")).distinct()


def mixed_buckets(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, band, node, component) of the buckets whose nodes lie in more than one component."""
    placed = (buckets.join(classes, "node", "left")
              .select("key", "band", "node", F.coalesce("component", "node").alias("component")))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    return placed.join(open_keys, "key")


def parity_rows(texts: DataFrame, words: int) -> DataFrame:
    """(node, n, marks): the number of runs of a text, and for ``MARK_BITS`` hash values whether an odd number of them has it."""
    def run(batches):
        for b in slices(batches):
            sizes, marks = [], []
            for raw in b.column(1).to_pylist():
                x = runs(raw, words)
                odd = np.bincount((x % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1
                sizes.append(len(x))
                marks.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())], ["node", "n", "marks"])

    return map_arrow(texts.select("node", "text"), run, "node long, n long, marks binary")


def possible_pairs(group: np.ndarray, side: np.ndarray, node: np.ndarray, component: np.ndarray, n: np.ndarray,
                   marks: np.ndarray, threshold: float, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cut) of the rows of equal ``group`` (in order) that can be near-duplicates of another component.

    Parities differ only where runs differ, so a pair that differs in more places than the threshold leaves is none;
    no other pair of the group is left out, but for rows marked ``cut``: they had more than the ``limit`` nearest ones."""
    end = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    last = np.repeat(end, np.diff(end, prepend=0)) - 1
    p, step, found = np.arange(len(group)), 0, []
    while True:
        step += 1
        p = p[last[p] - p >= step]
        if not len(p):
            break
        q = p + step
        total = n[p] + n[q]
        spare = total - 2 * np.ceil(threshold * total / (1 + threshold) - 1e-9)
        ok = (component[p] != component[q]) & (np.abs(n[p] - n[q]) <= spare) & ((side[p] < 0) | (side[p] != side[q]))
        x, y, spare = p[ok], q[ok], spare[ok]
        for low in range(0, len(x), 32_768):
            i, j = x[low:low + 32_768], y[low:low + 32_768]
            apart = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64)
            near = apart <= spare[low:low + 32_768]
            found.append(np.stack([node[i[near]], node[j[near]], apart[near], group[i[near]]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    one, two, apart, of = np.concatenate(found, axis=1)
    a, b = np.minimum(one, two), np.maximum(one, two)
    order = np.lexsort((apart, b, of))
    a, b, of = a[order], b[order], of[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (of[1:] != of[:-1])
    at = np.arange(len(b))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    cut = np.append((rank[1:] == limit) & (rank[:-1] == limit - 1), False)
    kept = rank < limit
    return a[kept], b[kept], cut[kept]


def open_pairs(mixed: DataFrame, marks: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(a, b, cut): pairs of mixed buckets that can be near-duplicates; see ``possible_pairs``.

    A bucket above ``BLOCK`` rows is dealt into blocks, and every two blocks meet in a group of their own."""
    sizes = mixed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = (mixed.select("key", "node", "component").join(sizes, "key").join(marks, "node")
            .withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    # With its own block a row meets all others, with another one only the rows of that block.
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "key",
                       F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "marks")

    def run(batches):
        def found(cols):
            key, i, j, own, node, component, n, marks = cols
            new = np.zeros(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            a, b, cut = possible_pairs(np.cumsum(new), np.where(i == j, -1, own), node, component, n, marks, threshold, limit)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.bool_())], ["a", "b", "cut"])

        def in_parts(cols):
            # Candidates of a crowd are about as many as its pairs, so groups are taken a bounded number of pairs at a time.
            key, i, j = cols[:3]
            ends = np.append(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(key))
            low, pairs = 0, 0
            for start, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                size = (end - start) * (end - start - 1) // 2
                if start > low and pairs + size > PAIRS_AT_ONCE:
                    yield found([x[low:start] for x in cols])
                    low, pairs = start, 0
                pairs += size
            yield found([x[low:] for x in cols])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 8)]
            cols.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            cols = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols)]
            key, i, j = cols[:3]
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            done = new[-1] + 1 if len(new) else 0  # the last group may go on in the next batch
            held = [x[done:] for x in cols]
            if done:
                yield from in_parts([x[:done] for x in cols])
        if held is not None:
            yield from in_parts(held)

    dealt = rows.repartition("group").sortWithinPartitions("group", "key", "i", "j")
    return map_arrow(dealt, run, "a long, b long, cut boolean")


def near_duplicate_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                         words: int = WORDS, sketches: int = SKETCHES, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, links): rows (id, digest), nodes (node, digest, least_id), verified links (a, b, similarity)."""
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = stored(sketch_rows(plain, kind, sketches, sample, words, threshold), "sketches")
    nodes = stored(rows.where(F.col("digest").isNotNull()).groupBy("digest")
                   .agg(F.min("id").alias("least_id"), F.min("bands").alias("bands"))
                   .withColumn("node", F.monotonically_increasing_id()), "nodes")

    banded = (nodes.select("node", F.posexplode("bands").alias("band", "value"))
              .withColumn("band", F.least("band", F.lit(sketches))))  # all keys of short texts are one band
    buckets = banded.select(F.xxhash64("band", "value").alias("key"), "band", "node")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = stored(buckets.join(shared, "key"), "buckets")

    # The texts of all nodes that have a candidate, once per node.  A text is found by its row's digest,
    # which is computed again in the pass that reads the texts.
    wanted = buckets.select("node").distinct().join(nodes.select("node", "digest"), "node")
    distinct = with_digest(plain).groupBy("digest").agg(F.min("text").alias("text"))
    texts = stored(distinct.join(wanted, "digest").select("node", "text"), "texts")

    pairs = stored(star_pairs(buckets), "pairs")
    links = stored(verified(pairs, texts, threshold, words), "links")
    seen, limit, marks = pairs, NEAREST, None
    while True:
        # Buckets only become pure from round to round, so the first round's parities serve all.
        mixed = stored(mixed_buckets(buckets, components(links)), "mixed")
        if marks is None:
            marks = stored(parity_rows(texts.join(mixed.select("node").distinct(), "node", "left_semi"), words), "marks")
        found = stored(open_pairs(mixed, marks, threshold, limit).groupBy("a", "b").agg(F.max("cut").alias("cut")), "open")
        more = stored(found.select("a", "b").join(seen, ["a", "b"], "left_anti"), "pairs")
        links, seen = links.unionByName(stored(verified(more, texts, threshold, words), "links")), seen.unionByName(more)
        if found.where("cut").isEmpty():
            break
        limit *= NEAREST_GROWTH
    return rows.select("id", "digest"), nodes.select("node", "digest", "least_id"), links


def _classes(docs: DataFrame, id_col: str, text_col: str, options: dict) -> tuple[DataFrame, DataFrame]:
    """rows (id, digest) and their distinct texts (digest, class_id, head, class_rows, links), stored; ``head`` is
    the digest of the row that stands for the class."""
    rows, nodes, links = near_duplicate_links(docs, id_col, text_col, **options)
    classes = components(links)
    degree = (links.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("node"))
              .groupBy("node").agg(F.count(F.lit(1)).alias("links")))
    placed = (nodes.join(classes, "node", "left").join(degree, "node", "left")
              .select("digest", "least_id", F.coalesce("component", "node").alias("component"),
                      F.coalesce("links", F.lit(0)).alias("links")))
    sizes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    heads = (placed.join(sizes, "digest").groupBy("component")
             .agg(F.min(F.struct("least_id", "digest")).alias("head"), F.sum("n").alias("class_rows")))
    known = placed.join(heads, "component").select("digest", F.col("head.least_id").alias("class_id"),
                                                   F.col("head.digest").alias("head"), "class_rows", "links")
    return rows, stored(known, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, class_id, class_rows, links) of every row: the smallest id of its class of equal and near-equal
    texts, the rows of that class, and the number of different texts its own is verified against."""
    with scratch(docs.sparkSession):
        return stored(_members(docs, id_col, text_col, options), "members", keep=True)


def _members(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    rows, known = _classes(docs, id_col, text_col, options)
    found = rows.where(F.col("digest").isNotNull()).join(known.drop("head"), "digest").select("id", "class_id", "class_rows", "links")
    alone = rows.where(F.col("digest").isNull()).select(
        "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(alone).withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with its columns: the row of the smallest id.  Texts without words all stay."""
    mark_col, id_name, digest_name, n = unused(docs, "_mark", "_id", "_digest", "_n")
    with scratch(docs.sparkSession):
        _, known = _classes(docs, id_col, text_col, options)
        winners = stored(known.where("digest = head").select(F.col("class_id").alias(id_name), F.col("digest").alias(digest_name)),
                         "winners", keep=True)
    columns = docs.columns
    text_at = columns.index(text_col)

    def mark(batches):
        for b in slices(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(text_at).to_pylist()]
            digests = pa.array([digest(t) if t.split() else None for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, digests], [*columns, mark_col])

    marked = map_arrow(docs, mark, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", {mark_col} binary")
    same = (F.col(mark_col) == F.col(digest_name)) & F.col(id_col).eqNullSafe(F.col(id_name))
    # Rows repeated with equal id and text: any one of them.
    one = Window.partitionBy(mark_col, id_col).orderBy(mark_col)
    first = (marked.where(F.col(mark_col).isNotNull()).join(winners, same, "left_semi")
             .withColumn(n, F.row_number().over(one)).where(F.col(n) == 1))
    plain = [F.col(f"`{c}`") for c in columns]
    return first.select(*plain).unionByName(marked.where(F.col(mark_col).isNull()).select(*plain))
