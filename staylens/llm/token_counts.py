"""Token counts of whole texts; huge ones by overlap resynchronisation.

A huge text is cut into chunks that overlap.  The tokenizer encodes each chunk as a whole and gives
its tokens' offsets in the text.  The first tokens of a chunk that starts inside a word are not those
of the text, nor are the last ones of a chunk that ends inside one.  So two neighbouring chunks are
spliced at a place in their overlap that is proven stable (in front of a white-space run, see
``tokenizing``), where no token of either goes across and after which both have the same tokens up
to the next such place.  Where the overlap has none, the alignment has failed: the overlap is widened
to twice its size and the chunk encoded again, until it succeeds or the chunk reaches the text's end.
The count is the sum of the spliced parts; memory is bounded by the text and two chunks' offsets.

A text of at most one chunk needs no splice.  It is counted piece by piece between stable places,
with a memo of the pieces that the worker has seen.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give one row
each; null ids stay null; further columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, slices
from staylens.llm.tokenizing import BOUNDARY, PIECE, memo

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256


@dataclass
class Chunk:
    """An encoded part of a text: its end, and the ids of its tokens with their offsets in the text."""

    end: int
    ids: list[int]
    starts: list[int]
    ends: list[int]

    def between(self, low: int, high: int) -> list[int]:
        return self.ids[bisect_left(self.starts, low):bisect_left(self.starts, high)]

    def splits_at(self, place: int) -> bool:
        """Whether no token goes across ``place``."""
        i = bisect_left(self.starts, place)
        return i == 0 or self.ends[i - 1] <= place


def encode_chunk(text: str, low: int, high: int, tokenizer) -> Chunk:
    found = tokenizer.encode(text[low:high], add_special_tokens=False)
    offsets = found.offsets
    return Chunk(high, found.ids, [low + a for a, _ in offsets], [low + b for _, b in offsets])


def splice_at(text: str, left: Chunk, right: Chunk, low: int) -> int | None:
    """A stable place in the overlap [low, left.end) where both chunks have a border and agree on what follows."""
    places = [m.start() for m in BOUNDARY.finditer(text, low + 1, left.end)]
    for place, after in zip(places, places[1:]):
        if (left.splits_at(place) and right.splits_at(place)
                and left.between(place, after) == right.between(place, after)):
            return place
    return None


def count_huge(text: str, tokenizer, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, from encoded chunks spliced in their overlaps."""
    n, total, spliced, start = len(text), 0, 0, 0
    left = encode_chunk(text, 0, min(n, chunk + overlap), tokenizer)
    while left.end < n:
        low, wide = max(start, left.end - overlap), overlap
        right = encode_chunk(text, low, min(n, low + chunk + overlap), tokenizer)
        place = splice_at(text, left, right, low)
        while place is None and left.end < n:
            # Widen: the left chunk grows to the right, and so does the right one if it must.
            wide *= 2
            left = encode_chunk(text, start, min(n, left.end + wide), tokenizer)
            if right.end < min(n, left.end + chunk):
                right = encode_chunk(text, low, min(n, left.end + chunk), tokenizer)
            place = splice_at(text, left, right, low)
        if place is None:
            break
        total += len(left.between(spliced, place))
        start, spliced, left = low, place, right
    return total + len(left.between(spliced, n + 1))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``tokenizer_path`` is a ``tokenizers`` file that every executor has at that path.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        counts = memo(tokenizer_path, "counts")
        for b in slices(batches):
            texts = pc.fill_null(b.column(1), "")
            n = [count_huge(t, counts.library, chunk, overlap) if len(t) > chunk + overlap
                 else sum(map(counts.__getitem__, PIECE.findall(t))) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64())],
                ["id", "n_bytes", "n_tokens"])

    counted = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                        run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
