"""Conversation repair against brute force: all edit sequences, a memo-less recursion, awkward rows, segments."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm import audits
from staylens.llm.conversations import RESULT, damage, repair_conversations, whole

LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, conv string, present int, digest long, uid string"


def all_audits(symbols):
    """Every audit with at most two insertions in a gap, with its cost, that gives legal initials."""
    gaps = [""] + ["u", "a"] + ["".join(p) for p in itertools.product("ua", repeat=2)]
    options = []
    for s in symbols:
        ways = [("D", "", 2)]
        if s != audits.DELETE:
            more = 5 * (s % 2)
            ways += [("K", "sua?"[s // 2], more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        options.append(ways)
    for edits in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(symbols) + 1):
            roles = ins[0] + "".join(e[1] + i for e, i in zip(edits, ins[1:]))
            if LEGAL.fullmatch(roles):
                audit = "I" * len(ins[0]) + "".join(e[0] + "I" * len(i) for e, i in zip(edits, ins[1:]))
                yield sum(e[2] for e in edits) + 5 * sum(map(len, ins)), audit


def from_the_right(symbols):
    """Cheapest edits by recursion over what is left, whole strings compared."""
    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == len(symbols):
            if state in "0a":
                ways.append((0, ""))
        else:
            c, a = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if symbols[i] != audits.DELETE:
                more, own = 5 * (symbols[i] % 2), "sua?"[symbols[i] // 2]
                for edit, role, cost in (("K", own, more), ("R", "u", 1 + more), ("R", "a", 1 + more)):
                    if (role == "s" and state == "0") or (role == "u" and state in "0sa") or (role == "a" and state == "u"):
                        c, a = best(i + 1, role, 0)
                        ways.append((c + cost, edit + a))
        if inserted < 2:
            role = "a" if state == "u" else "u"
            c, a = best(i, role, inserted + 1)
            ways.append((c + 5, "I" + a))
        return min(ways, default=(10**9, ""))
    return best(0, "0", 0)


@pytest.mark.parametrize("n,count", [(0, 1), (1, 9), (2, 25), (3, 6)])
def test_repair_is_the_least_of_all(n, count):
    rnd = random.Random(n)
    for k in range(count):
        symbols = bytes([k]) if n == 1 else bytes(rnd.randrange(9) for _ in range(n))
        assert audits.repair(symbols) == min(all_audits(symbols)) == from_the_right(symbols)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 2, 2, 2, 4, 4, 4, 6, 8, 1, 3, 5]), max_size=40).map(bytes))
def test_repair_and_segments_of_longer_ones(symbols):
    want = from_the_right(symbols)
    assert audits.repair(symbols) == want
    for modulus in (1, 7):  # nearly every hash collides: the edits themselves decide
        assert audits.repair(symbols, audits.EditTree(modulus)) == want
    cuts = [symbols[i:i + 3] for i in range(0, len(symbols), 3)]
    path = audits.choose_path([audits.segment_costs(c) for c in cuts])
    got = "".join(audits.segment_edits(c, a, b) for c, a, b in zip(cuts, path, path[1:])) + audits.ENDING[path[-1]]
    assert got == want[1]


def test_order_of_tree_nodes():
    rnd = random.Random(3)
    for modulus in ((1 << 61) - 1, 3):
        tree = audits.EditTree(modulus)
        texts = ["".join(rnd.choice("DIKR") for _ in range(rnd.randint(1, 30))) for _ in range(80)]
        texts += [t[:k] for t in texts[:20] for k in (1, 4)]
        nodes = {t: tree.extend(0, t) for t in texts}
        for a, b in itertools.combinations(nodes, 2):
            assert tree.less(nodes[a], nodes[b]) == (a < b)
        assert all(tree.text(x) == t for t, x in nodes.items())


def brute(rows, damaged=True):
    """Results by conversation id, row by row as the contract reads."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        out = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20 if damaged else 9
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    results = []
    for conv, out in convs.items():
        def digest(r):
            return hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, faults = set(), []
        for _, role, text in out:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else
                          "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        symbols = bytes(audits.DELETE if f in ("blank", "duplicate") else
                        2 * {"s": 0, "u": 1, "a": 2}.get(r[1][:1], 3) + (f == "truncated") for f, r in zip(faults, out))
        cost, audit = from_the_right(symbols)
        left, lines, state = iter(out), [], "a"
        for e in audit:
            due = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(f"{due}:")
            else:
                _, role, text = next(left)
                if e == "D":
                    continue
                lines.append(f"{role if e == 'K' else due}:{text}")
            state = lines[-1][0]
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        turns = {r[0] for r in out} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = zip(out, out[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        results.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                        hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(results, key=repr)


def odd_conversations(seed=2):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?\n ", "cut off", "", " \t", None, "Né 😀.", "word " * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = [(c, t, rnd.choice(roles), rnd.choice(texts)) for c in range(25) for t in range(rnd.randint(1, 9))]
    rows += [(None, t, "user", "Hi.") for t in (2, None, 5)] + [(90, None, None, None), (91, 4, "user", "a.\x00b.")]
    rows += [(92, 3, r, f"Text {i % 7}.") for i in range(12) for r in ("user", "assistant")]  # ties of turn
    rows += [(93, t * 3, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(60)]
    rows += rows[:5]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 0, 1, "u") for r in rows], SCHEMA)


def results(df):
    return sorted((tuple(r) for r in df.select("conv_id", *RESULT).collect()), key=repr)


@pytest.mark.parametrize("segment_rows,damaged", [(2048, True), (4, True), (1, False)])
def test_conversations_are_brute_force(spark, segment_rows, damaged):
    rows = odd_conversations()
    table = frame(spark, rows)
    got = results(repair_conversations(damage(table) if damaged else whole(table), segment_rows=segment_rows))
    assert got == brute(rows, damaged)


def test_dropped_conversations_and_empty_table(spark):
    gone = [(c, t) for c in range(60) for t in range(60) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:6]
    rows = [(c, t, "user", "Hi.") for c, t in gone]
    empty = hashlib.sha256(b"").hexdigest()
    for segment_rows in (2048, 0):
        got = results(repair_conversations(damage(frame(spark, rows)), segment_rows=segment_rows))
        assert got == sorted({(c, 0, 0, 0, 0, 0, 0, "", empty) for c, _ in gone}, key=repr)
    assert repair_conversations(damage(frame(spark, []))).count() == 0


def test_long_texts_go_by_segments(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "x" * 500 + ".") for t in range(10)]
    got = results(repair_conversations(whole(frame(spark, rows)), whole_chars=1000))
    assert got == brute(rows, False)
