"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Documents are tokenized whole and end with a separator id.  Only documents longer than a sequence
are cut; their first piece may be shorter than a sequence, the others fill one each.  The shorter
pieces are dealt at random into blocks of bounded size, and every block is packed by several
islands, each a task of its own:

* an individual is a packing: a list of bins (groups of documents);
* crossover injects whole well-filled bins of one parent into the other, removes the bins there
  that hold a document twice, and best-fits the displaced documents (largest first);
* mutation dissolves the worst-filled bins and best-fits their documents;
* fitness is the mean squared fill; an island ends when it reaches the block's lower bound.

Between epochs every island's elite migrates to the next island of its block (a shuffle of
packings, which are bounded by the block).  The best island's packing of each block counts.  The
bins of all blocks that are far from full are then dissolved and packed once more in new blocks,
if that saves sequences.

Defined results: null texts count as empty (the separator alone); repeated rows and ids are packed
row by row; ties are broken by the row's place in the stored table of pieces; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, slices, stored
from staylens.llm.tokenizing import PIECE, ids_bytes, memo
from staylens.session import ship_package

CAPACITY = 2048
SEPARATOR = 0
BLOCK_ITEMS = 2048
ISLANDS = 3
EPOCHS = 3
GENERATIONS = 6
POPULATION = 4
#: Bins filled below this share are dissolved for the second pass.
FULL_ENOUGH = 0.99


def piece_table(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, piece, start, length, ids_crc32) of every piece, stored; ``uid`` is unique."""
    kind = dict(docs.dtypes)[id_col]
    end = ids_bytes([separator])

    def run(batches):
        ids_of = memo(tokenizer_path, "ids")
        for b in slices(batches):
            ids, texts = b.column(0), b.column(1).to_pylist()
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts):
                ids_text = b"".join(map(ids_of.__getitem__, PIECE.findall(text or ""))) + end
                n = len(ids_text) // 4
                low = 0
                for p, high in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                    at.append(i)
                    piece.append(p)
                    start.append(low)
                    length.append(high - low)
                    crc.append(zlib.crc32(memoryview(ids_text)[4 * low:4 * high]))
                    low = high
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    pieces = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run,
                       f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")


class Packer:
    """Packings of one block: bins are tuples of item numbers."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.rnd = sizes, capacity, random.Random(seed)
        self.by_size = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        self.bound = lower_bound(sizes, capacity)

    def best_fit(self, bins: list[tuple], items: list[int]) -> list[tuple]:
        """Put ``items``, in their order, each into the fullest bin that takes it, or a new one."""
        sizes, cap = self.sizes, self.capacity
        bins = list(bins)
        by_room: dict[int, list[int]] = {}
        rooms = 0  # bit r: some bin has room r
        for k, b in enumerate(bins):
            r = cap - sum(map(sizes.__getitem__, b))
            by_room.setdefault(r, []).append(k)
            rooms |= 1 << r
        for i in items:
            s = sizes[i]
            fits = rooms >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                k = by_room[r].pop()
                if not by_room[r]:
                    rooms ^= 1 << r
                bins[k] += (i,)
            else:
                r, k = cap, len(bins)
                bins.append((i,))
            by_room.setdefault(r - s, []).append(k)
            rooms |= 1 << (r - s)
        return bins

    def fill(self, b: tuple) -> int:
        return sum(map(self.sizes.__getitem__, b))

    def fitness(self, bins: list[tuple]) -> tuple[int, float]:
        """Larger is better: fewer bins, then a larger mean squared fill."""
        return -len(bins), sum(self.fill(b) ** 2 for b in bins) / (max(1, len(bins)) * self.capacity**2)

    def first(self, noise: float) -> list[tuple]:
        if not noise:
            return self.best_fit([], self.by_size)
        key = {i: -self.sizes[i] * self.rnd.uniform(1 - noise, 1 + noise) for i in self.by_size}
        return self.best_fit([], sorted(self.by_size, key=key.__getitem__))

    def crossover(self, giver: list[tuple], taker: list[tuple]) -> list[tuple]:
        fills = [self.fill(b) for b in giver]
        level = sorted(fills)[len(fills) // 2]
        injected = [b for b, f in zip(giver, fills) if f >= level and self.rnd.random() < 0.5]
        inside = {i for b in injected for i in b}
        kept = [b for b in taker if inside.isdisjoint(b)]
        displaced = [i for b in taker if not inside.isdisjoint(b) for i in b if i not in inside]
        return self.best_fit(injected + kept, sorted(displaced, key=lambda i: -self.sizes[i]))

    def mutate(self, bins: list[tuple]) -> list[tuple]:
        worst = sorted(range(len(bins)), key=lambda k: self.fill(bins[k]))
        n = min(len(bins), 2 + self.rnd.randrange(1 + len(bins) // 20))
        out = set(worst[:n])
        freed = [i for k in out for i in bins[k]]
        self.rnd.shuffle(freed)
        return self.best_fit([b for k, b in enumerate(bins) if k not in out], freed)

    def evolve(self, population: list[list[tuple]], generations: int) -> list[list[tuple]]:
        population = sorted(population, key=self.fitness, reverse=True)
        for _ in range(generations):
            if len(population[0]) <= self.bound:
                break
            a, b = self.rnd.sample(population, 2) if len(population) > 1 else population * 2
            child = self.mutate(self.crossover(a, b))
            population = sorted(population + [child], key=self.fitness, reverse=True)[:max(2, len(population))]
        return population


def lower_bound(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: total size, and pieces over half a sequence with those that fit none of them."""
    total = -(-sum(sizes) // capacity)
    best = total
    for small in (capacity // 4, capacity // 3, 2 * capacity // 5):
        big = [s for s in sizes if s > capacity - small]
        mid = [s for s in sizes if capacity // 2 < s <= capacity - small]
        low = [s for s in sizes if small <= s <= capacity // 2]
        rest = sum(low) - (len(mid) * capacity - sum(mid))
        best = max(best, len(big) + len(mid) + max(0, -(-rest // capacity)))
    return best


def encode(bins: list[tuple], n: int) -> bytes:
    a = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        a[list(b)] = k
    return a.tobytes()


def decode(raw: bytes) -> list[tuple]:
    a = np.frombuffer(raw, np.int32)
    order = np.argsort(a, kind="stable")
    return [tuple(g.tolist()) for g in np.split(order, np.flatnonzero(np.diff(a[order])) + 1)] if len(a) else []


ISLAND = "block long, island int, n_bins int, fill double, uids binary, sizes binary, population array<binary>"


def pack_items(items: DataFrame, capacity: int, block_items: int, islands: int, epochs: int, generations: int,
               population: int, seed: int) -> DataFrame:
    """(uid, length, block, bin, offset) for the stored ``items`` (uid, length)."""
    blocks = max(1, -(-items.count() // block_items))
    dealt = (items.select("uid", "length")
             .withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks)))
             .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))))

    def row(block, island, packer, uids, pop) -> pd.DataFrame:
        n, fill = packer.fitness(pop[0])
        return pd.DataFrame({"block": [block], "island": [island], "n_bins": [-n], "fill": [fill], "uids": [uids.tobytes()],
                             "sizes": [np.array(packer.sizes, np.int32).tobytes()],
                             "population": [[encode(p, len(uids)) for p in pop]]})

    def settle(key, pdf):
        block, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values("uid")
        packer = Packer(pdf["length"].tolist(), capacity, seed + 7919 * block + island)
        pop = [packer.first(0.0)]
        if len(pop[0]) > packer.bound:
            pop += [packer.first(0.05 * (k + island)) for k in range(1, population)]
        return row(block, island, packer, pdf["uid"].to_numpy(np.int64), packer.evolve(pop, generations))

    def epoch(number: int):
        def run(key, pdf):
            block, island = int(key[0]), int(key[1])
            own = pdf.sort_values("guest")
            sizes = np.frombuffer(own["sizes"].iloc[0], np.int32).tolist()
            packer = Packer(sizes, capacity, seed + 7919 * block + island + 104729 * number)
            pop = [decode(raw) for pop in own["population"] for raw in pop]
            return row(block, island, packer, np.frombuffer(own["uids"].iloc[0], np.int64), packer.evolve(pop, generations))
        return run

    state = dealt.groupBy("block", "island").applyInPandas(settle, ISLAND)
    for number in range(1, epochs):
        # Elite migration: the best packing of an island also goes to the next one.
        moves = F.array(F.struct(F.col("island").alias("to"), F.lit(0).alias("guest"), F.col("population").alias("sent")),
                        F.struct(((F.col("island") + 1) % islands).cast("int").alias("to"), F.lit(1).alias("guest"),
                                 F.slice("population", 1, 1).alias("sent")))
        state = (state.withColumn("move", F.explode(moves))
                 .select("block", F.col("move.to").alias("island"), F.col("move.guest").alias("guest"), "uids", "sizes",
                         F.col("move.sent").alias("population"))
                 .groupBy("block", "island").applyInPandas(epoch(number), ISLAND))

    def unpack(key, pdf):
        best = pdf.sort_values(["n_bins", "fill", "island"], ascending=[True, False, True]).iloc[0]
        uids, sizes = np.frombuffer(best["uids"], np.int64), np.frombuffer(best["sizes"], np.int32).astype(np.int64)
        bins = np.frombuffer(best["population"][0], np.int32)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        new = np.r_[True, np.diff(bins[order]) != 0]
        offset = before - np.maximum.accumulate(np.where(new, before, 0))
        return pd.DataFrame({"uid": uids[order], "length": sizes[order], "block": int(key[0]),
                             "bin": bins[order].astype(np.int64), "offset": offset})

    return state.groupBy("block").applyInPandas(unpack, "uid long, length long, block long, bin long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR,
                   id_col: str = "doc_id", text_col: str = "text", block_items: int = BLOCK_ITEMS, islands: int = ISLANDS,
                   epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION,
                   seed: int = 2) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    ship_package(docs.sparkSession)
    pieces = piece_table(docs, tokenizer_path, capacity, separator, id_col, text_col)
    short = pieces.where(F.col("length") < capacity)
    options = (capacity, block_items, islands, epochs, generations, population)
    packed = stored(pack_items(short, *options, seed), "packed")

    # Second pass over the bins that are far from full, wherever they are.
    fills = packed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    loose = fills.where(F.col("fill") < int(FULL_ENOUGH * capacity)).select("block", "bin")
    again = stored(packed.join(loose, ["block", "bin"], "left_semi").select("uid", "length"), "loose")
    repacked = stored(pack_items(again, *options, seed + 1), "repacked")
    placed = packed.withColumn("pass", F.lit(0))
    if repacked.select("block", "bin").distinct().count() < loose.count():
        placed = (placed.join(loose, ["block", "bin"], "left_anti")
                  .unionByName(repacked.withColumn("pass", F.lit(1))))
    placed = placed.select("uid", "offset", (F.col("pass") * (1 << 62) + F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"))
    alone = pieces.where(F.col("length") == capacity).select(
        "uid", F.lit(0).cast("long").alias("offset"), (-1 - F.col("uid")).alias("sequence_id"))
    return (pieces.join(placed.unionByName(alone), "uid")
            .select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
