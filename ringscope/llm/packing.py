"""Best-fit packing of documents by a grouping genetic algorithm on islands.

Documents are tokenized where they lie and cut into pieces of at most CAPACITY tokens;
pieces of exactly that length need no packing. The others are dealt by a hash of their
row into blocks of about BLOCK pieces, a bounded size at any input. Each block is
packed on ISLANDS islands that evolve populations of their own from different seeds:
a crossover takes well-filled bins of one parent whole into the other, drops the bins
that hold the same pieces, and puts the displaced pieces back: first in exchange for
shorter ones where that fills a bin further, then by best fit. Between EPOCHS each
island passes its best packing on to the next island of its block. Bins that remain
poorly filled are emptied into fewer blocks at the next level, until one block is left
or nothing is gained.

Only piece lengths travel between islands; texts and ids are never shuffled.
"""

from __future__ import annotations

import json
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters, vocabulary_file
from .common import bounded_batches, give_back, read, row_key, stored

CAPACITY = 1024
END_ID = 2
BLOCK = 2000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 5
POPULATION = 4
#: Bins with at most so many free tokens are not opened again at the next level.
SPARE = 8
#: Fixed value: the words that byte-level vocabularies of this kind are cut into.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Ids of texts under a byte-level vocabulary file whose ids rise with its merge rules;
    special tokens in a text get their ids. The quick encoder gives up on very long runs
    of white space, which the tokenizers library then encodes."""

    def __init__(self, source: bytes):
        parsed = json.loads(source)
        special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        byte = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in parsed["model"]["vocab"].items() if t not in special}
        self.quick = tiktoken.Encoding("pieces", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        self.source, self.plain = source, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except ValueError:
            if self.plain is None:
                self.plain = Tokenizer.from_buffer(self.source)
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[int, Ids] = {}


def encoder(source: bytes) -> Ids:
    """The encoder of a vocabulary file, made once in each worker; the last file's stays."""
    key = zlib.crc32(source)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Ids(source)
    return _encoders[key]


class Packing:
    """A packing of items with given lengths: bins of item numbers, and their fill."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self._fitness: tuple[int, float] | None = None

    def put(self, items: list[int]) -> None:
        """Best fit of items, in their order: the bin with the least room that suffices."""
        size, capacity = self.lengths, self.capacity
        rooms: dict[int, list[int]] = {}
        mask = 0
        for b, f in enumerate(self.fill):
            rooms.setdefault(capacity - f, []).append(b)
            mask |= 1 << (capacity - f)
        for i in items:
            above = mask >> size[i]
            if above:
                room = size[i] + (above & -above).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    mask &= ~(1 << room)
                self.bins[b].append(i)
                self.fill[b] += size[i]
                room -= size[i]
            else:
                b, room = len(self.bins), capacity - size[i]
                self.bins.append([i])
                self.fill.append(size[i])
            rooms.setdefault(room, []).append(b)
            mask |= 1 << room

    def refill(self, items: list[int], bins: list[int]) -> list[int]:
        """Goes through bins once and puts an item in the place of a shorter one, or of two
        that are shorter together, wherever that fills the bin further, always the longest
        item that fits. Returns what is then left over."""
        size, loose = self.lengths, {}
        mask = 0
        for i in items:
            loose.setdefault(size[i], []).append(i)
            mask |= 1 << size[i]
        for b in bins:
            inside, room = self.bins[b], self.capacity - self.fill[b]
            if not room or len(inside) > 12:
                continue
            best, change = 0, None
            for x, i in enumerate(inside):
                for j in (None, *inside[x + 1 :]):
                    old = size[i] + (size[j] if j is not None else 0)
                    new = (mask & ((1 << (old + room + 1)) - 1)).bit_length() - 1
                    if new - old > best:
                        best, change = new - old, (i, j, new)
            if change:
                i, j, new = change
                self.fill[b] += best
                for gone in (i, j) if j is not None else (i,):
                    inside.remove(gone)
                    loose.setdefault(size[gone], []).append(gone)
                    mask |= 1 << size[gone]
                inside.append(loose[new].pop())
                if not loose[new]:
                    del loose[new]
                    mask &= ~(1 << new)
        return [i for group in loose.values() for i in group]

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the more uneven fill: nearly empty bins go soonest."""
        if self._fitness is None:  # asked for only once the packing is settled
            self._fitness = -len(self.bins), sum(f * f for f in self.fill) / self.capacity**2
        return self._fitness

    def assignment(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), dtype=np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out

    @classmethod
    def of(cls, lengths: list[int], capacity: int, assigned) -> Packing:
        p = cls(lengths, capacity)
        p.bins = [[] for _ in range(int(max(assigned, default=-1)) + 1)]
        for i, b in enumerate(assigned):
            p.bins[b].append(i)
        p.fill = [sum(lengths[i] for i in items) for items in p.bins]
        return p

    def without(self, dropped: set[int]) -> tuple[Packing, list[int]]:
        """A copy without the bins numbered in dropped, and the items of those bins."""
        p = Packing(self.lengths, self.capacity)
        p.bins = [list(x) for b, x in enumerate(self.bins) if b not in dropped]
        p.fill = [f for b, f in enumerate(self.fill) if b not in dropped]
        return p, [i for b in sorted(dropped) for i in self.bins[b]]


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """a with some of b's best-filled bins taken over whole."""
    ranked = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])
    better = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(better, max(1, len(better) // 4))
    taken = {i for k in chosen for i in b.bins[k]}
    clashing = {k for k, items in enumerate(a.bins) if not taken.isdisjoint(items)}
    child, loose = a.without(clashing)
    for k in chosen:
        child.bins.append(list(b.bins[k]))
        child.fill.append(b.fill[k])
    return settle(child, [i for i in loose if i not in taken], rng)


def settle(p: Packing, loose: list[int], rng: random.Random) -> Packing:
    """p with the loose items put back."""
    order = list(range(len(p.bins)))
    rng.shuffle(order)
    loose = p.refill(loose, order)
    p.put(sorted(loose, key=lambda i: -p.lengths[i]))
    return p


def mutate(p: Packing, rng: random.Random) -> Packing:
    """Empties the worst-filled bins and some others, and packs their items anew."""
    n = len(p.bins)
    worst = sorted(range(n), key=lambda k: p.fill[k])[: max(1, n // 20)]
    child, loose = p.without({*worst, *rng.sample(range(n), min(n, max(1, n // 20)))})
    return settle(child, loose, rng)


def lower_bound(lengths: list[int], capacity: int) -> int:
    return -(-sum(lengths) // capacity)


def evolve(lengths: list[int], capacity: int, seed: int, migrants: list, population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """The best packing that one island finds, as bin numbers by item; it ends early when
    the number of bins reaches the lower bound."""
    rng, least = random.Random(seed), lower_bound(lengths, capacity)
    pool = [Packing.of(lengths, capacity, m) for m in migrants]
    blur = 0.0
    while len(pool) < population:
        p = Packing(lengths, capacity)
        p.put(sorted(range(len(lengths)), key=lambda i, blur=blur: (-lengths[i] + rng.random() * blur, i)))
        pool.append(p)
        blur = blur * 2 + 16 * rng.random() + 1
        if len(p.bins) <= least:
            break
    best = max(pool, key=Packing.fitness)
    for _ in range(generations):
        if len(best.bins) <= least:
            break
        for _ in range(population):
            mother = max(rng.sample(pool, min(2, len(pool))), key=Packing.fitness)
            father = max(rng.sample(pool, min(2, len(pool))), key=Packing.fitness)
            child = crossover(mother, father, rng) if mother is not father else mutate(mother, rng)
            worst = min(range(len(pool)), key=lambda k: pool[k].fitness())
            if child.fitness() > pool[worst].fitness():
                pool[worst] = child
        best = max(pool, key=Packing.fitness)
    return best.assignment()


def pieces(docs: DataFrame, source: bytes, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """_id, piece, start, length, ids_crc32 of every piece of every row's ids. A null
    text counts as empty: one piece, the end id alone. Null ids stay null."""
    handle = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary file: bounded
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(handle.value), int(end_id).to_bytes(4, "little")
        for pdf in batches:
            rows, k, start, length, crc = [], [], [], [], []
            for at, text in enumerate(pdf.pop("text")):
                ids = encode(text or "").tobytes() + end
                n = len(ids) // 4
                head = (n - 1) % capacity + 1
                cuts = [0, *range(head, n, capacity), n]
                for j, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(at)
                    k.append(j)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pd.DataFrame({"_id": pdf["_id"].take(rows).to_numpy(), "piece": k, "start": start, "length": length, "ids_crc32": crc})
        give_back()

    rows = bounded_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(cut, f"_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _island_rows(blocks: DataFrame, islands: int) -> DataFrame:
    own = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    return blocks.select("block", F.transform("items", lambda x: x.length).alias("lengths"), own, F.array().cast("array<array<int>>").alias("migrants"))


def _epoch(rows: DataFrame, capacity: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best, bins = [], []
            for block, island, lengths, migrants in zip(pdf.block, pdf.island, pdf.lengths, pdf.migrants, strict=True):
                got = evolve([int(x) for x in lengths], capacity, (seed * 1009 + int(block)) * 64 + int(island), [m.tolist() for m in migrants])
                best.append(got)
                bins.append(int(got.max(initial=-1)) + 1)
            yield pdf.assign(best=best, bins=bins)[["block", "island", "lengths", "best", "bins"]]

    return rows.mapInPandas(run, "block long, island int, lengths array<long>, best array<int>, bins int")


def pack_level(items: DataFrame, n: int, level: int, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """items (_u, length, rest) with sequence_id, offset and fill."""
    blocks = max(1, math.ceil(n / block))
    held = items.groupBy(F.pmod(F.xxhash64("_u", F.lit(level)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("_u", "length", "rest"))).alias("items"))
    held = stored(held, f"blocks-{level}")
    spread = min(blocks * islands, 4 * items.sparkSession.sparkContext.defaultParallelism)
    rows = stored(_epoch(_island_rows(held, islands).repartition(spread, "block", "island"), capacity, level), f"epoch-{level}-0")
    for epoch in range(1, epochs):
        guests = rows.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("guest"))
        joined = rows.join(guests, ["block", "island"]).select("block", "island", "lengths", F.array("best", "guest").alias("migrants"))
        rows = stored(_epoch(joined.repartition(spread, "block", "island"), capacity, level + 100 * epoch), f"epoch-{level}-{epoch}")
    best = rows.groupBy("block").agg(F.min_by("best", F.struct("bins", "island")).alias("best"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            offsets, fills = [], []
            for best, lengths in zip(pdf.best, pdf.pop("lengths"), strict=True):
                at: dict[int, int] = {}
                mine = []
                for b, n in zip(best.tolist(), lengths.tolist(), strict=True):
                    mine.append(at.get(b, 0))
                    at[b] = at.get(b, 0) + n
                offsets.append(mine)
                fills.append([at[b] for b in best.tolist()])
            yield pdf.assign(offsets=offsets, fills=fills)

    placed = best.join(held.select("block", F.transform("items", lambda x: x.length).alias("lengths")), "block").mapInPandas(place, "block long, best array<int>, offsets array<long>, fills array<long>")
    out = held.join(placed, "block").select("block", F.explode_outer(F.arrays_zip("items", "best", "offsets", "fills")).alias("z"))
    number = F.lit(level).cast("long") * F.lit(1 << 54) + F.col("block") * F.lit(1 << 20) + F.col("z.best")
    return out.select(F.col("z.items._u").alias("_u"), F.col("z.items.length").alias("length"), F.col("z.items.rest").alias("rest"), number.alias("sequence_id"), F.col("z.offsets").alias("offset"), F.col("z.fills").alias("fill"))


def pack_documents(docs: DataFrame, source: bytes, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row is cut and packed on its own, whatever its id. An empty table gives an
    empty result. Columns other than id_col and text_col are not read."""
    cut = stored(pieces(docs, source, id_col, text_col, capacity, end_id).select(row_key("_u"), "*"), "pieces")
    rest = F.struct("_id", "piece", "start", "ids_crc32").alias("rest")
    whole = cut.where(F.col("length") == capacity).select("_u", "length", rest, (-1 - F.col("_u")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = cut.where(F.col("length") < capacity).select("_u", "length", rest)
    out = whole
    n = left.count()
    level = 0
    while n:
        packed = stored(pack_level(left, n, level, capacity, block), f"packed-{level}")
        poor = packed.where(F.col("fill") < capacity - SPARE)
        over = poor.count() if n > block else 0
        closed = packed if over in (0, n) else packed.where(F.col("fill") >= capacity - SPARE)
        out = out.unionByName(closed.drop("fill"))
        if over in (0, n):  # one block, all bins well filled, or none
            break
        left, n, level = poor.select("_u", "length", "rest"), over, level + 1
    return out.select(F.col("rest._id").alias(id_col), "rest.piece", "rest.start", "length", "rest.ids_crc32", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary_file(path, "byte_bpe_50k.json"))
