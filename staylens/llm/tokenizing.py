"""Tokens of whole texts, piece by piece, with a memo of the pieces seen by the worker.

A *piece* is a run of Unicode white space followed by a run of other characters.  A cut in
front of a white-space run (between a non-space and a space character) is a proven stable
token boundary of the two supported vocabularies: none of their pre-token patterns matches a
non-space character followed by a space, their normalisers (composition, white-space
replacement, per-character lower case) never look across it, and their special strings hold
no white space.  So the tokens of a text are the concatenation of the tokens of its pieces.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import cached_property

from staylens.llm.common import Generations, worker_memo

# The Unicode White_Space characters (the class \s of the vocabularies' patterns).
WHITE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Position of a stable boundary: white space after something else.
BOUNDARY = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

#: The memo holds pieces of at most so many characters, in two generations of at most so many pieces
#: (about 150 bytes each).
MEMO_CHARS = 48
MEMO_PIECES = 550_000

# Pre-tokenizer kinds for which the cut above is proven.
_SPLITS = {"Split", "ByteLevel"}


def load(path: str):
    """The tokenizer at ``path``, refused if its pre-tokenizer isn't one of the proven kinds."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        pre = json.load(f)["pre_tokenizer"] or {}
    kinds = {p["type"] for p in pre.get("pretokenizers", [pre])}
    if not kinds <= _SPLITS:
        raise ValueError(f"no proven stable boundary for pre-tokenizer {sorted(kinds)}")
    return Tokenizer.from_file(path)


# Fixed value: the pre-token pattern of the byte-level vocabulary (letters, digits, marks, white space).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others by characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def encoder(path: str):
    """text -> ids, as the library gives them without added special tokens.

    A byte-level vocabulary whose ids follow its merges gives the same ids by ranks, which a
    rank encoder does in half the time."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    ranked = (spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
              and model["type"] == "BPE" and not any(model.get(k) for k in (
                  "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
              and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
              and all(model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] == 256 + i
                      for i, m in enumerate(model["merges"])))
    if not ranked:
        library = load(path)
        return lambda text: library.encode(text, add_special_tokens=False).ids
    import tiktoken

    byte, special = byte_of(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode(text, allowed_special="all")


#: Letters of ASCII and Latin-1: each is a letter in lower case too.
LATIN = frozenset(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº")


class Memo(Generations):
    """piece -> value of ``make(ids)``; long pieces are not kept.

    A full stop or comma after a Latin letter is a pre-token of its own: such a piece is put together
    from the piece without it.  (Other letters may end in a mark once they are lower-cased, or be
    unknown to the vocabulary's letter class.)"""

    def __init__(self, path: str, make):
        super().__init__(MEMO_PIECES)
        self.path, self.encode, self.make = path, encoder(path), make

    @cached_property
    def library(self):
        return load(self.path)

    def value_of(self, piece: str):
        if len(piece) > 1 and piece[-1] in ".," and piece[-2] in LATIN:
            return self[piece[:-1]] + self[piece[-1]]
        return self.make(self.encode(piece))

    def kept(self, piece: str) -> bool:
        return len(piece) <= MEMO_CHARS


def ids_bytes(ids) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if a.itemsize != 4:
        a = array("L", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def memo(path: str, kind: str) -> Memo:
    """The worker's memo for a tokenizer: ``counts`` (piece -> int) or ``ids`` (piece -> bytes)."""
    return worker_memo((path, kind), lambda: Memo(path, len if kind == "counts" else ids_bytes))
