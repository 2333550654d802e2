"""Spelling variants against brute force: counting with damage, near words, forms, roots, awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frames import no_docs, odd_docs, odd_rows
from staylens.llm.spelling import PART_BYTES, Trie, count_words, parts, spelling_groups, word_pairs

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_counts(rows, damage):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if run:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(counts, min_chars, min_count, ratio):
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), form[w] and words[form[w]]) for w, n in words.items())


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


SCHEMA = "doc_id long, text string, uid int, word string, prefix string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", "p", "n") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("alphabet,seed", [("ab", 1), ("abé", 2), ("aÿ×", 3)])
def test_groups_are_brute_force(spark, alphabet, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    weights = [rnd.choice([1, 2, 12, 70, 400]) for _ in vocabulary]
    rows = [(i, " ".join(rnd.choices(vocabulary, weights, k=120))) for i in range(40)] + [(None, "aab AAB"), (3, None), (3, "")]
    got = rows_of(spelling_groups(frame(spark, rows), min_chars=2, min_count=2, ratio=3, damage=7))
    want = brute_groups(brute_counts(rows, 7), 2, 2, 3)
    assert got == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


def test_production_parameters(spark):
    rnd = random.Random(4)
    base = ["hamburger", "hämburger", "sandwiches", "Sandwichès", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "short"]
    words = [w for w, n in zip(base, (900, 30, 800, 9, 700, 60, 6, 50)) for _ in range(n)]
    words += ["hamburgers"] * 5 + ["hamburge"] * 4 + ["Übergröße"] * 30 + ["übergröße"] * 6
    rnd.shuffle(words)
    rows = [(i, ", ".join(words[i::50])) for i in range(50)]
    got = rows_of(spelling_groups(frame(spark, rows), damage=199))
    assert got == brute_groups(brute_counts(rows, 199), 6, 5, 5)


def test_equal_letters_count_one_insertion(spark):
    rows = [(1, " ".join(["aaaaaa"] * 50 + ["aaaaaaa"] * 5 + ["aaabaaa"] * 5))]
    assert rows_of(spelling_groups(frame(spark, rows))) == [
        ("aaaaaa", None, "aaaaaa", 50, 2, None), ("aaaaaaa", "aaaaaa", "aaaaaa", 5, 2, 50), ("aaabaaa", "aaaaaa", "aaaaaa", 5, 2, 50)]


def test_odd_documents_and_empty_table(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = rows_of(spelling_groups(odd_docs(spark), damage=199))
    assert got == brute_groups(brute_counts(rows, 199), 6, 5, 5)
    assert any(len(r[0]) > 30_000 for r in rows_of(spelling_groups(odd_docs(spark), min_count=1)))
    assert spelling_groups(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        spelling_groups(no_docs(spark), ratio=1)


def test_counts_of_parts(spark, monkeypatch):
    text = "Ab é÷ñ×x 1a_b\x00c" * 3
    assert b"".join(parts(text.encode())) == text.encode()
    long = "word " * (PART_BYTES // 4) + "y" * PART_BYTES
    assert [len(RUN.findall(p.decode())) for p in parts(long.encode())][0] > 0
    assert dict(Counter(w for p in parts(long.encode()) for w in RUN.findall(p.decode()))) == dict(Counter(RUN.findall(long)))
    got = {r.word: r.n for r in count_words(frame(spark, [(1, text), (2, long)])).collect()}
    assert got == dict(brute_counts([(1, text), (2, long)], 0))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), max_size=30), st.integers(0, 3))
def test_nodes_stand_for_prefixes(words, head):
    trie = Trie(1, head)
    seen = {}
    for w in sorted(words):
        path = trie.nodes(w)
        assert len(path) == len(w) + 1
        for k, node in enumerate(path):
            assert seen.setdefault(w[:k], node) == node
    assert len(set(seen.values())) == len(seen)


def test_pairs_of_a_word():
    p, s, kinds = word_pairs("aab", [0, 1, 2, 3], [0, 7, 8, 9])
    assert list(zip(p, s, kinds)) == [(0, 9, 0), (1, 8, 0), (2, 7, 0), (3, 0, 0), (0, 8, 1), (1, 7, 2), (2, 0, 1)]
