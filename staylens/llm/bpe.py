"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by vocabulary strings.

A pre-token starts as a doubly linked list of its bytes' symbols.  A heap holds every pair of
neighbours that the merge table knows, as (rank, place of the left symbol).  The least entry is
taken; it is stale, and skipped, if the symbols at that place are no longer the pair of its rank.
Else the right symbol is unlinked, the left one becomes the merged symbol, and the pairs with its two
neighbours enter the heap.  A pre-token of n bytes takes O(n log n), also if it is one run of a
million letters.

Texts are cut into pieces at proven stable token boundaries (``tokenizing``); a worker keeps a
bounded memo of the ids of short pieces.  Decoding concatenates the vocabulary strings of the ids
as bytes and reads them as UTF-8, invalid sequences replaced.  Both digests are fed block by block, so
memory is bounded by the text and its ids.

Defined results: a null text counts as empty (0 tokens, digests of the empty string); repeated rows
and ids give one row each; null ids stay null; special strings in texts become their ids, as the
library does by default; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import Generations, map_arrow, slices, worker_memo
from staylens.llm.tokenizing import PIECE, byte_of, load

#: Ids whose strings are joined at a time for the digests.
BLOCK_IDS = 65_536
#: Pieces in each of the two generations of the memo, and the longest one kept, in characters.
MEMO_PIECES = 600_000
#: Pre-tokens in each of the two generations of theirs.  (About 250 bytes an entry of either.)
MEMO_WORDS = 400_000
MEMO_CHARS = 48

#: Texts that need no general pre-tokenizer: letters of ASCII and Latin-1 after at most one space, then at most one mark.
PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")

DEAD = -1


class _Words(Generations):
    """pre-token -> its ids as an array's bytes; the words of pieces that differ only in marks.  Long ones are not kept."""

    def __init__(self, codec: BytePairCodec):
        super().__init__(MEMO_WORDS)
        self.encode = codec.encode_word

    def value_of(self, word: str) -> bytes:
        return array("I", self.encode(word)).tobytes()

    def kept(self, word: str) -> bool:
        return len(word) <= MEMO_CHARS


class BytePairCodec:
    """Ids of texts and texts of ids, for a byte-level BPE vocabulary file of ``tokenizers``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        unsupported = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                   "byte_fallback", "ignore_merges") if model.get(k)]
        if (model["type"] != "BPE" or unsupported or spec["normalizer"] or pre.get("type") != "ByteLevel"
                or not pre["use_regex"] or pre["add_prefix_space"]):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings with matching options are not supported")
        self.split = load(path).pre_tokenizer.pre_tokenize_str
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbol = {c: vocab[c] for c in byte_of()}
        #: Space and Latin-1 letters as the characters that stand for their bytes.
        shown = {b: c for c, b in byte_of().items()}
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in (0x20, *range(0xC0, 0x100))}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: (left id, right id) -> rank; rank -> merged id; the ranks of pairs of single bytes (-1: none) in one array.
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = array("I", [vocab[a + b] for a, b in pairs])
        if max(self.symbol.values()) > 0xFF:
            raise ValueError("the ids of single bytes are expected to come first")
        self.first = array("i", [self.rank.get((a, b), -1) for a in range(256) for b in range(256)])
        byte, tokens = byte_of(), vocab | self.special
        #: Vocabulary strings by id, as bytes.
        self.strings = [b""] * (1 + max(tokens.values()))
        for token, i in tokens.items():
            self.strings[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.names = [str(i) for i in range(len(self.strings))]
        self.words = _Words(self)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given as the characters that stand for its bytes."""
        ids = list(map(self.symbol.__getitem__, word))
        n = len(ids)
        if n == 1:
            return ids
        rank, merged_of, first = self.rank.get, self.merged, self.first
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is the rank, the left place and the two symbols: least rank first, leftmost among equals.
        queue = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(ids)) if (r := first[a << 8 | b]) >= 0]
        heapify(queue)
        while queue:
            r, i, left, right = heappop(queue)
            j = after[i]
            if ids[i] != left or j == n or ids[j] != right:
                continue  # stale: one of the two symbols has been merged since
            k, merged = after[j], merged_of[r]
            ids[i], ids[j], after[i] = merged, DEAD, k
            if k < n:
                before[k] = i
                b = ids[k]
                s = rank((merged, b))
                if s is not None:
                    heappush(queue, (s, i, merged, b))
            h = before[i]
            if h >= 0:
                a = ids[h]
                s = rank((a, merged))
                if s is not None:
                    heappush(queue, (s, h, a, merged))
        return [x for x in ids if x != DEAD]

    def encode_plain(self, text: str) -> bytes:
        m = PLAIN.fullmatch(text)
        if m:  # a word and a mark are one pre-token each; a space counts as the word's first letter
            word, mark = m.groups()
            ids = self.words[word.translate(self.shown)]
            return ids + self.words[mark] if mark else ids
        return b"".join([self.words[word] for word, _ in self.split(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a text, as the bytes of an array of unsigned integers."""
        if self.special_at is None:
            return self.encode_plain(text)
        out, low = [], 0
        for m in self.special_at.finditer(text):
            out += self.encode_plain(text[low:m.start()]), array("I", [self.special[m.group()]]).tobytes()
            low = m.end()
        return b"".join(out) + self.encode_plain(text[low:]) if out else self.encode_plain(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(Generations):
    """piece -> its ids as an array's bytes; long pieces are not kept."""

    def __init__(self, path: str):
        super().__init__(MEMO_PIECES)
        self.codec = BytePairCodec(path)

    def value_of(self, piece: str) -> bytes:
        return self.codec.encode(piece)

    def kept(self, piece: str) -> bool:
        return len(piece) <= MEMO_CHARS


def pieces_memo(path: str) -> _Pieces:
    return worker_memo((path, "bpe"), lambda: _Pieces(path))


def text_ids(text: str, memo: _Pieces) -> array:
    ids = array("I")
    ids.frombytes(b"".join(map(memo.__getitem__, PIECE.findall(text))))
    return ids


def digests(ids: array, codec: BytePairCodec) -> tuple[str, str]:
    """SHA-256 of the decimal ids joined by commas, and of the decoded text in UTF-8."""
    of_ids, of_text = hashlib.sha256(), hashlib.sha256()
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for low in range(0, len(ids), BLOCK_IDS):
        block = ids[low:low + BLOCK_IDS]
        of_ids.update((("," if low else "") + ",".join(map(codec.names.__getitem__, block))).encode())
        of_text.update(reader.decode(b"".join(map(codec.strings.__getitem__, block))).encode())
    of_text.update(reader.decode(b"", final=True).encode())
    return of_ids.hexdigest(), of_text.hexdigest()


def _inputs(df: DataFrame, id_col: str, value_col: str, kind: str) -> tuple[DataFrame, str]:
    return df.select(F.col(id_col).alias("id"), F.col(value_col).cast(kind).alias("value")), dict(df.dtypes)[id_col]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; ``tokenizer_path`` is a file that every executor has there."""
    plain, kind = _inputs(docs, id_col, text_col, "string")

    def run(batches):
        memo = pieces_memo(tokenizer_path)
        for b in slices(batches):
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = pa.array(text_ids(text or "", memo), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], ["id", "ids"])

    return map_arrow(plain, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row; null ids give the empty text, an id outside the vocabulary raises."""
    plain, kind = _inputs(encoded, id_col, ids_col, "array<int>")

    def run(batches):
        codec = pieces_memo(tokenizer_path).codec
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([codec.decode(ids or ()) for ids in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return map_arrow(plain, run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def codec_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded in one pass."""
    plain, kind = _inputs(docs, id_col, text_col, "string")

    def run(batches):
        memo = pieces_memo(tokenizer_path)
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                ids = text_ids(text or "", memo)
                rows.append((len(ids), *digests(ids, memo.codec)))
            n, of_ids, of_text = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(plain, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
