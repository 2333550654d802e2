"""Spelling variants: words grouped under the frequent word that is one edit away.

Words are counted in the scan that reads the texts.  The words in question are then found by a
trie-node pair dictionary:

* the nodes of the trie of all words are numbered, and so are those of the trie of all reversed
  words: a word of n characters has n + 1 prefix nodes and n + 1 suffix nodes;
* each word gives, for every position, the pair (node of the prefix before it, node of the suffix
  after it) with that character skipped, and the pair (prefix node, suffix node) of every place
  where a character may be inserted;
* two words that skip the same pair differ by one replaced character; a word whose insertion pair
  another one skips lacks one character of it.

So all words one edit apart meet under equal pairs of integers, with no candidate to verify.  A pair
is shared by at most one word per letter of the alphabet and one that has none there, so no group of
a pair grows with the data, and its near words are counted and compared as a group, never emitted as
pairs.  Where a run of equal letters allows several places for one insertion, only the run's first
counts.

A trie node of the first ``HEAD`` characters is numbered by these; deeper ones are numbered
where all words with that beginning (or end) stand, sorted: a word takes over the nodes that it shares with
its predecessor and opens the others.  Words stream through; a worker holds one word's nodes.

Defined results: null and empty texts hold no words; a null id counts as the empty string in the
hash; repeated rows count again; further columns are ignored, whatever their names; an empty table gives an
empty result; ties go to the word first in code-point order.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, slices, stored

#: Words in UTF-8, lower-cased in A-Z: letters a-z and U+00C0 to U+00FF.
WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
NO_WORD = re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of a text whose words are counted at a time, and words of a task's counter before it is emptied.
PART_BYTES = 1 << 20
COUNTER_WORDS = 200_000
#: Leading characters whose trie nodes are numbered by their code points.
HEAD = 3

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
DAMAGE = 199


def parts(raw: bytes) -> Iterator[bytes]:
    """``raw`` in parts that end where no word goes on."""
    low = 0
    while low < len(raw):
        m = NO_WORD.search(raw, low + PART_BYTES) if low + PART_BYTES < len(raw) else None
        high = m.start() if m else len(raw)
        yield raw[low:high]
        low = high


def damaged(word: bytes, seed: int, every: int) -> bytes:
    """The word, or, for one hash in ``every``, the word without the character that the hash names."""
    h = zlib.crc32(word, seed)
    if not every or h % every:
        return word
    s = word.decode()
    k = h % len(s)
    return (s[:k] + s[k + 1:]).encode()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 0) -> DataFrame:
    """(word, n) of all texts; with ``damage``, a share of the runs loses one character (by a hash of id and run)."""
    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in slices(batches):
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for part in parts((raw or b"").lower()):
                    for word, n in Counter(WORD.findall(part)).items():
                        counts[damaged(word, seed, damage)] += n
                    if len(counts) > COUNTER_WORDS:
                        yield flush()
        yield flush()

    # A run of A-Z, a-z is lower-cased with the whole text: bytes.lower changes ASCII only.
    found = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")),
                      run, "word string, n long")
    return found.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Numbers of trie nodes for words that come sorted, equal beginnings together."""

    def __init__(self, first: int, head: int = HEAD):
        self.free, self.head, self.last, self.path = first, head, "", [0]

    def nodes(self, word: str) -> list[int]:
        """The nodes from the root to the end of ``word``."""
        same = 0
        for a, b in zip(self.last, word):
            if a != b:
                break
            same += 1
        path, code = [0], 0
        for c in word[:self.head]:
            code = (code << 21) | ord(c)
            path.append(-code)
        path += self.path[len(path):same + 1]
        new = len(word) + 1 - len(path)
        path += range(self.free, self.free + new)
        self.free += new
        self.last, self.path = word, path
        return path


def by_beginning(words: DataFrame, key: Column) -> DataFrame:
    """``words`` with ``key``, sorted by it, all keys of one beginning in one partition, whose number is ``part``."""
    return (words.withColumn("key", key).repartition(F.substring("key", 1, HEAD)).sortWithinPartitions("key")
            .withColumn("part", F.spark_partition_id()))


def prefix_nodes(words: DataFrame) -> DataFrame:
    """(uid, n, word, prefixes) of the words (uid, n, word)."""
    def run(batches):
        trie = None
        for b in slices(batches):
            trie = trie or Trie((b.column(4)[0].as_py() << 40) + 1)
            found = [trie.nodes(w) for w in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["uid", "n", "word", "prefixes"])

    return map_arrow(by_beginning(words, F.col("word")), run, "uid long, n long, word string, prefixes array<long>")


#: What a word does at a pair: a character may be inserted there, or one is skipped, the first of a run of equal ones or a later one.
INSERTS, SKIPS_FIRST, SKIPS_LATER = 0, 1, 2


def word_pairs(word: str, prefixes: list[int], suffixes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Prefix nodes, suffix nodes and kinds of all pairs of a word; ``suffixes`` go from the empty one to the whole word."""
    back = suffixes[::-1]
    later = [SKIPS_FIRST] + [SKIPS_LATER if a == b else SKIPS_FIRST for a, b in zip(word, word[1:])]
    return prefixes + prefixes[:-1], back + back[1:], [INSERTS] * len(prefixes) + later[:len(word)]


def pair_table(words: DataFrame) -> DataFrame:
    """(prefix, suffix, n, uid, kind): every pair of every word (uid, n, word)."""
    def run(batches):
        trie = None
        for b in slices(batches):
            trie = trie or Trie((b.column(5)[0].as_py() << 40) + 1)
            uids, n = b.column(0).to_pylist(), b.column(1).to_pylist()
            columns = [[], [], [], [], []]
            for u, m, word, prefixes, key in zip(uids, n, *(b.column(k).to_pylist() for k in (2, 3, 4))):
                p, s, kinds = word_pairs(word, prefixes, trie.nodes(key))
                for column, values in zip(columns, (p, s, [m] * len(p), [u] * len(p), kinds)):
                    column += values
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.int32())],
                ["prefix", "suffix", "n", "uid", "kind"])

    return map_arrow(by_beginning(prefix_nodes(words), F.reverse("word")), run,
                     "prefix long, suffix long, n long, uid long, kind int")


def near_words(words: DataFrame) -> DataFrame:
    """(uid, n_near, best_n, best): number of words one edit from each word (uid, n, word) that has one, and the
    one of these with the largest n, then the smallest uid."""
    # A group holds at most one word per letter of the alphabet and one that inserts: it is bounded.
    group = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "uid", "kind")))
    met = (pair_table(words).groupBy("prefix", "suffix").agg(group.alias("g")).where(F.size("g") > 1)
           .select("g", F.explode("g").alias("me")))
    def number(*kinds):
        return F.size(F.filter("g", lambda x: x["kind"].isin(*kinds)))
    near = (F.when(F.col("me.kind") == INSERTS, number(SKIPS_FIRST))
            .when(F.col("me.kind") == SKIPS_FIRST, F.size("g") - 1)
            .otherwise(number(SKIPS_FIRST, SKIPS_LATER) - 1))
    other = F.when(F.col("g")[0]["uid"] == F.col("me.uid"), F.col("g")[1]).otherwise(F.col("g")[0])
    return (met.select(F.col("me.uid").alias("uid"), near.cast("long").alias("near"),
                       F.struct(other["rank"].alias("rank"), other["uid"].alias("uid")).alias("best"))
            .groupBy("uid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
            .select("uid", "n_near", (-F.col("best.rank")).alias("best_n"), F.col("best.uid").alias("best")))


def follow(links: DataFrame, longest: int) -> DataFrame:
    """(uid, root) of the stored links (uid, root): the last node of each chain, by pointer doubling."""
    for _ in range(math.ceil(math.log2(max(1, longest)))):
        ahead = links.select(F.col("uid").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(ahead, "root", "left").select("uid", F.coalesce("next", "root").alias("root")), "roots")
    return links


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                    min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int = 0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``min_chars`` characters and ``min_count`` occurrences.

    ``form`` is the near word (one edit away) with the largest n if that is at least ``ratio`` times the
    word's, ``root`` the end of the chain of forms.  ``ratio`` must be over 1, so that chains end.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    counted = count_words(docs, id_col, text_col, damage).where((F.col("n") >= min_count) & (F.char_length("word") >= min_chars))
    # Numbers grow with the words' order, so ties of n go to the smaller number.
    words = stored(counted.orderBy("word").withColumn("uid", F.monotonically_increasing_id()).select("uid", "n", "word"), "words")
    near = stored(near_words(words), "near")
    formed = near.join(words.select("uid", "n"), "uid").where(F.col("best_n") >= ratio * F.col("n"))
    links = stored(formed.select("uid", F.col("best").alias("root")), "forms")
    # Every form is `ratio` times as frequent as the word before it, which bounds the chains.
    most = words.agg(F.max("n")).first()[0] or 1
    roots = follow(links, 1 + int(math.log(max(1, most / max(1, min_count)), ratio)))
    chosen = (near.join(links.withColumnRenamed("root", "form_uid"), "uid", "left").join(roots, "uid", "left"))
    forms = words.select(F.col("uid").alias("form_uid"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = words.select(F.col("uid").alias("root"), F.col("word").alias("root_word"))
    return (words.join(chosen, "uid", "left").join(forms, "form_uid", "left").join(ends, "root", "left")
            .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
