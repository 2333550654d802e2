"""Near-duplicates and repeated passages against brute force, and their awkward cases."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from frames import no_docs, odd_docs, sentence_text, tuples, words

from staylens.llm import components as graphs
from staylens.llm.common import stored
from staylens.llm.components import components, least_nodes
from staylens.llm.near_duplicates import (aligned_similarity, drop_near_duplicates, longest_short, near_duplicates, order_minhash, runs,
                                           short_keys)
from staylens.llm.repeated_passages import compare_neighbours, compare_windows, cut_words, remove_repeated, repeated_passages


def corpus(seed, n=60):
    """Texts with near copies of near copies, copies, and shared passages."""
    rnd = random.Random(seed)
    texts = [words(rnd, rnd.randint(60, 260)) for _ in range(n)]
    shared = [words(rnd, k) for k in (49, 50, 51, 80, 130)]
    for i in range(n):
        if i % 3 == 0:
            t = texts[rnd.randrange(n)][:]
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = "changed" + str(rnd.randrange(1000))
            texts.append(t)
        if i % 4 == 0:
            t = words(rnd, rnd.randint(30, 90))
            at = rnd.randint(0, len(t))
            texts.append(t[:at] + rnd.choice(shared) + t[at:])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def labelled_runs(text):
    w, seen, out = text.split(), Counter(), []
    for i in range(max(1, len(w) - 4)) if w else []:
        run = tuple(w[i:i + 5])
        out.append((run, seen[run]))
        seen[run] += 1
    return out


def similarity(a, b):
    """Longest common subsequence of the labelled runs over their union."""
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    m = table[-1, -1]
    return m / (len(a) + len(b) - m) if a and b else 0.0


def brute_classes(rows):
    part = {i: i for i, _ in rows}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    sets = {i: labelled_runs(t) for i, t in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) > 0 and similarity(a, b) >= 0.8:
                part[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in part}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicate_classes_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert all(r.class_rows == sum(x.class_id == r.class_id for x in got) for r in got)


def test_alignment_matches_the_dynamic_program():
    rnd = random.Random(9)
    for _ in range(40):
        a = words(rnd, rnd.randint(5, 60))
        b = a[:]
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(b))
            b[k:k + rnd.randint(0, 2)] = words(rnd, rnd.randint(0, 2))
        if rnd.random() < 0.2:
            b = b[len(b) // 2:] + b[:len(b) // 2]
        x, y = " ".join(a), " ".join(b)
        want = similarity(labelled_runs(x), labelled_runs(y))
        got = aligned_similarity(runs(x.encode()), runs(y.encode()))
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_sketches_follow_order():
    x = runs(sentence_text(random.Random(4), 300).encode())
    assert (order_minhash(x) == order_minhash(x.copy())).all()
    assert (order_minhash(x) != order_minhash(x[::-1])).mean() > 0.8


def test_short_texts_share_a_key_whenever_they_are_near():
    rnd = random.Random(12)
    for threshold in (0.6, 0.8, 0.9):
        limit = longest_short(threshold)
        for _ in range(1500):
            a = [rnd.choice("abcd") for _ in range(rnd.randint(5, limit + 6))]
            b = a[:]
            for _ in range(rnd.choice([1, 1, 2])):
                b.insert(rnd.choice([0, len(b)]), rnd.choice("abcd")) if rnd.random() < 0.6 else b.pop(rnd.choice([0, -1]))
            x, y = runs(" ".join(a).encode()), runs(" ".join(b).encode())
            short = len(x) + len(y) < 2 * (1 + threshold) / (1 - threshold) - 1e-9
            if len(x) and len(y) and short and not np.array_equal(x, y) and aligned_similarity(x, y, threshold) >= threshold:
                assert max(len(x), len(y)) <= limit and np.intersect1d(short_keys(x, threshold), short_keys(y, threshold)).size
    assert longest_short() == 9 and longest_short(1.0) == 0
    assert not short_keys(np.arange(3, dtype=np.uint64)).size  # below five runs in all, nothing but equal texts


def test_no_near_pair_of_short_texts_is_missed(spark):
    rnd, rows = random.Random(13), []
    for i in range(2000):
        t = words(rnd, rnd.randint(8, 12))
        longer = [f"one{i}", *t] if rnd.random() < 0.5 else [*t, f"one{i}"]
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(longer))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id == r.doc_id // 2 * 2 and r.class_rows == 2 and r.links == 1 for r in got)


def test_long_chains_and_large_groups_make_one_class(spark):
    rnd = random.Random(11)
    base, rows = words(rnd, 150), []
    for i in range(120):  # copies of one text with one word changed each, and a chain of growing changes
        t = base[:]
        t[rnd.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(t)))
    chain = words(rnd, 150)
    for i in range(15):
        chain = chain[:]
        chain[10 * i] = f"link{i}"
        rows.append((1000 + i, " ".join(chain)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got if r.doc_id < 1000} == {0}
    assert {r.class_id for r in got if r.doc_id >= 1000} == {1000}


def test_pairs_inside_a_crowd_of_similar_texts_are_found(spark):
    """Many texts of about half the similarity share bands with everyone; true pairs hide among them."""
    rnd = random.Random(21)
    base, texts = words(rnd, 200), []
    for i in range(150):
        t = base[:]
        for k in rnd.sample(range(200), 14):
            t[k] = f"w{i}x{k}"
        texts.append(t)
    for i in range(0, 150, 2):
        t = texts[i][:]
        t[rnd.randrange(200)] = f"pair{i}"
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [set(labelled_runs(t)) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                part = [min(part[i], part[j]) if x in (part[i], part[j]) else x for x in part]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(part)) > 100 and [got[i] for i in range(len(rows))] == part


def test_pairs_at_the_threshold_inside_a_hot_crowd_are_all_found(spark, monkeypatch):
    """Texts at 0.66 to 0.78 to each other, and a true pair at 0.8 of every third;
    few bands of one run each make hot buckets, in several blocks and rounds."""
    import staylens.llm.near_duplicates as N
    monkeypatch.setattr(N, "BLOCK", 60, raising=False)
    monkeypatch.setattr(N, "NEAREST", 1, raising=False)
    rnd = random.Random(31)
    base, texts = words(rnd, 200), []
    for i in range(300):
        t = base[:]
        for k in rnd.sample(range(5, 195, 5), 4):
            t[k] = f"w{i}x{k}"
        texts.append(t)
    for i in range(0, 300, 3):
        t = texts[i][:]
        for k in rnd.sample(range(0, 200, 10), 4):
            t[k] = f"pair{i}x{k}"
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [set(labelled_runs(t)) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                part = [min(part[i], part[j]) if x in (part[i], part[j]) else x for x in part]
    # Of six bands all true pairs share one.
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), sketches=6, sample=1).collect()}
    assert len(set(part)) > 150 and [got[i] for i in range(len(rows))] == part


def test_near_duplicates_of_awkward_rows(spark):
    got = Counter(tuples(near_duplicates(odd_docs(spark)), "doc_id", "class_id", "class_rows"))
    assert got[1, 1, 4] == 1 and got[2, 1, 4] == 2 and got[None, 1, 4] == 1
    assert got[3, 3, 1] == got[4, 4, 1] == got[5, 5, 1] == 1
    assert got[7, 7, 2] == got[8, 7, 2] == 1
    kept = drop_near_duplicates(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 0 and ids[3] == ids[4] == ids[5] == 1 and ids[10] == 2 and ids[8] == 0
    assert near_duplicates(no_docs(spark)).count() == drop_near_duplicates(no_docs(spark)).count() == 0


def brute_spans(rows):
    """Words in 50-word windows shared with another document (and with an earlier one)."""
    where = defaultdict(set)
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            where[tuple(w[i:i + 50])].add((d, i))
    shared, late = defaultdict(set), defaultdict(set)
    for found in where.values():
        docs = {d for d, _ in found}
        for d, i in found:
            if len(docs) > 1:
                shared[d].update(range(i, i + 50))
            if d > min(docs):
                late[d].update(range(i, i + 50))
    return shared, late


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_passages_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {True: defaultdict(set), False: defaultdict(set)}
    for r in repeated_passages(df).collect():
        assert r.n_words == r.end_word - r.start_word >= 50
        got[r.duplicate][r.doc_id].update(range(r.start_word, r.end_word))
    shared, late = brute_spans(rows)
    assert got[False] == shared and got[True] == late
    left = {r.doc_id: r.text for r in remove_repeated(df).collect()}
    for d, t in rows:
        w = [x for i, x in enumerate(t.split()) if i not in late.get(d, ())]
        assert left.get(d, "").split() == w and (d in left) == bool(w)


def test_passages_around_a_common_core_are_those_of_brute_force(spark):
    """Documents with a core of 40 words; the last one of a core shares six words on both sides with the second one,
    and seven words on one side with many others, which are nearer to it in any order by that side."""
    rnd = random.Random(17)
    rows = []
    for _ in range(8):
        core, left, right = words(rnd, 40), words(rnd, 7), words(rnd, 7)
        beside = [([], []), (left[1:], right[:6])] + [(left, []), ([], right)] * 12 + [(left, right)]
        rows += [words(rnd, 40) + x + core + y + words(rnd, 40) for x, y in beside]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = {True: defaultdict(set), False: defaultdict(set)}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.duplicate][r.doc_id].update(range(r.start_word, r.end_word))
    shared, late = brute_spans(rows)
    assert len(late) == 8 and got[False] == shared and got[True] == late


@pytest.mark.parametrize("rows", [0, 10**6])
def test_both_ways_to_compare_contexts_agree_with_brute_force(spark, monkeypatch, rows):
    import staylens.llm.repeated_passages as R
    monkeypatch.setattr(R, "GROUP_ROWS", rows, raising=False)
    test_passages_around_a_common_core_are_those_of_brute_force(spark)
    test_repeated_passages_are_those_of_brute_force(spark, 1)


def test_neighbours_extend_to_what_all_windows_give():
    rnd = random.Random(3)
    for _ in range(3000):
        sides = [[b"".join(rnd.choice([b"aaaaaa", b"bbbbbb"]) if rnd.random() < 0.1 else b"cccccc" for _ in range(rnd.choice([0, 4, 15, 15])))
                  for _ in range(2)] for _ in range(2)]
        spans = [sorted(rnd.choices(range(4), k=2)) for _ in range(2)]
        if sides[0][0] == sides[0][1] and sides[1][0] == sides[1][1]:
            continue  # equal contexts are one row
        row = [[a for a, _ in spans], [b for _, b in spans], *sides]
        assert compare_neighbours(*row) == [list(x) for x in compare_windows(*row)]


def test_only_kept_tables_stay(spark, monkeypatch):
    import staylens.llm.common as C
    made = []
    monkeypatch.setattr(C, "scratch_path", lambda s, name, old=C.scratch_path: made.append(old(s, name)) or made[-1])
    df = spark.createDataFrame(corpus(2, 20), "doc_id long, text string").repartition(3)
    for make in (near_duplicates, drop_near_duplicates, repeated_passages, remove_repeated):
        made.clear()
        out = make(df)
        left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
        assert len(made) > 4 and len(left) == 1 and out.count() > 0


def test_repeated_passages_of_awkward_rows(spark):
    docs = odd_docs(spark)
    spans = Counter(tuples(repeated_passages(docs), "doc_id", "start_word", "end_word", "duplicate"))
    assert spans[None, 0, 120, False] == 1 and spans[1, 0, 120, True] == 1  # a null id sorts first
    assert spans[2, 0, 120, True] == 1 and spans[7, 0, 9000, False] == 1 and spans[8, 0, 9000, True] == 1
    assert not any(d in (3, 4, 5, 6, 9, 10) for d, *_ in spans)
    cut = remove_repeated(docs)
    assert cut.columns == docs.columns
    left = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert left[8] == ("tail", 4) and left[3] == (None, 0) and 2 not in left and 1 not in left and None in left
    assert repeated_passages(no_docs(spark)).count() == remove_repeated(no_docs(spark)).count() == 0


def test_cut_words_keeps_the_rest_as_it_is():
    assert cut_words(b"a  b\nc d\te ", [(1, 3)]) == b"a  d\te "
    assert cut_words(b"a b c", [(1, 3)]) == b"a"
    assert cut_words(b"a b c", [(0, 3)]) == b""


def test_components_of_paths_stars_and_cycles(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[202] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def random_graph(seed):
    """Edges (some null, turned round, repeated or from a node to itself) and the smallest node of each one's component."""
    rnd = random.Random(seed)
    path = rnd.sample(range(-500, 500), 120)
    edges = list(zip(path[:60], path[1:60])) + [(path[60], x) for x in path[61:90]] + [(path[90 + i], path[90 + rnd.randrange(30)]) for i in range(30)]
    edges += edges[:5] + [(b, a) for a, b in edges[5:9]]
    part = {x: x for e in edges for x in e}
    for _ in part:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    placed = {x for a, b in edges if a != b for x in (a, b)}
    return edges + [(None, 1), (2, None), (999, 999)], {x: part[x] for x in placed}


@pytest.mark.parametrize("bound", [1 << 18, 40, 0])
def test_components_in_one_task_and_by_stars(spark, monkeypatch, bound):
    monkeypatch.setattr(graphs, "TASK_EDGES", bound)
    for seed in (1, 2):
        edges, want = random_graph(seed)
        rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(rows) == len(want) and {r.node: r.component for r in rows} == want


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graphs, "stored", lambda df, name: (written.append(name), stored(df, name))[1])
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in components(path).collect()} == {0}
    assert len(written) == 1


def test_least_nodes_of_a_long_path():
    rnd = random.Random(3)
    at = np.array(rnd.sample(range(10 ** 6), 5000))
    nodes, least = least_nodes(at[:-1], at[1:])
    assert len(nodes) == 5000 and (least == at.min()).all()
