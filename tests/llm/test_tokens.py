"""Token counts and packing against the tokenizer library itself."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from frames import no_docs, odd_docs, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from staylens.llm.common import Generations
from staylens.llm.packing import Packer, lower_bound, pack_documents
from staylens.llm.token_counts import count_huge, count_tokens
from staylens.llm.tokenizing import PIECE, memo

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
WORD_LIB, BYTE_LIB = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
TEXT = st.text(st.sampled_from(list("ab '’sStdlevrm\n\t  é́ßΣİ1２٣!?。<|>\x1c  ‍🙂")), max_size=300)


def library(lib, text):
    return lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from([(40, 3), (17, 1), (64, 16)]))
def test_resynchronised_count_is_the_librarys(text, sizes):
    assert count_huge(text, WORD_LIB, *sizes) == len(library(WORD_LIB, text))
    assert sum(map(memo(WORD, "counts").__getitem__, PIECE.findall(text))) == len(library(WORD_LIB, text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_of_pieces_are_the_librarys(text):
    got = b"".join(map(memo(BYTE, "ids").__getitem__, PIECE.findall(text)))
    assert np.frombuffer(got, "<u4").tolist() == library(BYTE_LIB, text)


@pytest.mark.parametrize("text", ["y" * 3000, ("w " * 30 + "z" * 500) * 8, "<|endoftext|> a<|startoftext|>b " * 40, "日本語 テキスト" * 200])
def test_overlaps_widen_until_a_stable_boundary(text):
    assert count_huge(text, WORD_LIB, 50, 5) == len(library(WORD_LIB, text))
    assert count_huge(text, BYTE_LIB, 50, 5) == len(library(BYTE_LIB, text))


@pytest.mark.parametrize("path,lib", [(WORD, WORD_LIB), (BYTE, BYTE_LIB)])
def test_letters_before_marks_count_as_the_librarys(path, lib):
    counts, wrong = memo(path, "counts"), []
    for low in range(0, 0x30000, 64):
        letters = [chr(c) for c in range(low, low + 64) if chr(c).isalpha()]
        text = " ".join(f"{c}. {c}, Vatan {c}. y{c}." for c in letters)
        if sum(map(counts.__getitem__, PIECE.findall(text))) != len(library(lib, text)):
            wrong.append(hex(low))
    assert not wrong


def test_chunks_that_start_and_end_inside_words():
    rnd = random.Random(8)
    text = "".join(rnd.choice(["the ", "an", "e\u0301", "İ", " \n", "x" * 30, "'ll ", "12 ", "日本", "ing. "]) for _ in range(6000))
    for chunk, overlap in ((1000, 1), (997, 40), (64, 64), (5000, 300)):
        assert count_huge(text, WORD_LIB, chunk, overlap) == len(library(WORD_LIB, text))


def test_count_tokens_on_awkward_rows(spark):
    got = sorted((tuple(r) for r in count_tokens(odd_docs(spark), WORD, chunk=1000, overlap=20).collect()), key=repr)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(library(WORD_LIB, r[1] or "")), n > 2048) for r in odd_rows()), key=repr)
    assert got == want
    assert count_tokens(no_docs(spark), WORD).count() == 0


def test_memo_of_two_generations():
    class Doubles(Generations):
        calls = 0

        def value_of(self, key):
            self.calls += 1
            return 2 * key
    memo = Doubles(3)
    assert [memo[k] for k in (1, 2, 3, 1, 4, 1, 5)] == [2, 4, 6, 2, 8, 2, 10] and memo.calls == 5
    assert len(memo) + len(memo.old) <= 6 and memo[2] == 4


def check_packing(rows, docs, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    want = []
    for doc in docs:
        ids = np.array(library(BYTE_LIB, doc[1] or "") + [0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        low = 0
        for piece, high in enumerate(range(first, len(ids) + 1, capacity)):
            want.append((doc[0], piece, low, high - low, zlib.crc32(ids[low:high].tobytes())))
            low = high
    assert got == sorted(want, key=repr)
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


@pytest.mark.parametrize("capacity,block", [(2048, 2048), (256, 8)])
def test_packing_holds_every_piece_once(spark, capacity, block):
    rows = pack_documents(odd_docs(spark), BYTE, capacity=capacity, block_items=block).collect()
    sequences, least = check_packing(rows, odd_rows(), capacity)
    assert sequences <= least + (2 if block > 100 else 6)
    assert pack_documents(no_docs(spark), BYTE).count() == 0


def test_grouping_crossover_keeps_items_and_whole_bins():
    rnd = random.Random(3)
    p = Packer([rnd.randint(1, 100) for _ in range(200)], 100, 1)
    a, b = p.first(0.0), p.first(0.3)
    child = p.crossover(a, b)
    assert sorted(i for x in child for i in x) == list(range(200))
    assert all(p.fill(x) <= 100 for x in child)
    assert len({frozenset(x) for x in child} & {frozenset(x) for x in a}) > 0
    best = p.evolve([a, b], 30)[0]
    assert p.bound <= len(best) <= min(len(a), len(b))


def test_lower_bound_counts_large_items():
    assert lower_bound([60] * 10, 100) == 10
    assert lower_bound([50] * 10, 100) == 5
    assert lower_bound([], 100) == 0
