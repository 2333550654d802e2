"""The BPE codec against the tokenizers library: ids, decoding, digests and awkward rows."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frames import no_docs, odd_docs, odd_rows
from staylens.llm.bpe import BLOCK_IDS, BytePairCodec, codec_digests, decode_documents, digests, encode_documents, pieces_memo, text_ids
from staylens.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def memo():
    return pieces_memo(PATH)


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def check(memo, text):
    ids, back = want(text)
    got = text_ids(text, memo)
    assert got.tolist() == ids
    assert memo.codec.decode(got) == back


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aab  \n\t'sd.,<|>1İß　́"))), max_size=60))
def test_ids_and_text_are_the_librarys(text):
    check(pieces_memo(PATH), text)


@pytest.mark.parametrize("text", [
    "", " ", "a", " word, word. Word! a? b: c; 'll 's. x's", "<|endoftext|>", "  <|endoftext|> <|endoftext|><|endoftext|>x", "<|startoftext|>", "it's we'll \n\n x  ",
    "aaaaaaaaaaaa" * 50, "ab" * 5000, "😀👍🏽" * 30, " \u0085\x1c\x1f a", "日本語のテキスト。", "İ.", "\x00\x01"])
def test_awkward_texts(memo, text):
    check(memo, text)


def test_letters_before_marks_and_white_space(memo):
    for low in range(0, 0x30000, 0x400):
        text = " ".join(f"a{chr(c)}.{chr(c)}, {chr(c)}" for c in range(low, low + 0x400) if not 0xD800 <= c < 0xE000)
        check(memo, text)


def test_long_run_is_not_quadratic(memo):
    rnd = random.Random(1)
    run = "".join(rnd.choice("etaoinshr") for _ in range(200_000))
    assert text_ids(run, memo).tolist() == LIBRARY.encode(run, add_special_tokens=False).ids


def test_stale_entries_leave_the_merge_order_alone():
    codec = BytePairCodec(PATH)
    rnd = random.Random(7)
    for _ in range(2000):
        word = "".join(rnd.choice("aeinst") for _ in range(rnd.randint(1, 25)))
        symbols = [codec.symbol[c] for c in word]
        while True:  # brute force: the least rank of all pairs, leftmost first
            ranks = [(codec.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in codec.rank]
            if not ranks:
                break
            r, i = min(ranks)
            symbols[i:i + 2] = [codec.merged[r]]
        assert codec.encode_word(word) == symbols


def test_digests_over_blocks(memo):
    text = "the end is é near 😀 " * (BLOCK_IDS // 6)
    ids, back = want(text)
    assert len(ids) > BLOCK_IDS
    assert digests(text_ids(text, memo), memo.codec) == (
        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_split_characters_decode_with_replacement(memo):
    ids = want("é😀")[0]
    for part in (ids[:1], ids[1:], ids[::-1]):
        assert memo.codec.decode(part) == LIBRARY.decode(part, skip_special_tokens=False)


def test_documents(spark):
    docs = odd_docs(spark)
    got = sorted((tuple(r) for r in codec_digests(docs, PATH).collect()), key=repr)
    rows = []
    for r in odd_rows():
        ids, back = want(r[1])
        rows.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(rows, key=repr)
    assert codec_digests(no_docs(spark), PATH).count() == 0


def test_encode_and_decode_round_trip(spark):
    encoded = encode_documents(odd_docs(spark), PATH)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == sorted(
        ((r[0], want(r[1])[0]) for r in odd_rows()), key=repr)
    back = decode_documents(encoded, PATH)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((r[0], r[1] or "") for r in odd_rows()), key=repr)
