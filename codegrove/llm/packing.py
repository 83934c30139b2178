"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Documents become token ids with an end id; only longer ones are cut into full sequences and a rest. Pieces are dealt at
random into shards of bounded size. On each shard a few islands evolve packings apart: a crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold a duplicate, exchanges one or two of the displaced
pieces for smaller ones where that fills a bin better, and puts the rest back, largest first, where they fit best. Between epochs each island's best packing migrates to the next island. Of a shard's
best packing the well-filled bins are final; the pieces of the others are pooled over the shards and packed again, until
one shard is left.

Edge cases: a null text counts as empty and has one piece, the end id alone; equal lengths are ordered at random from a
fixed seed; repeated rows are packed each; an empty table has no sequences; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, prepare, stored, table

LENGTH, END = 4096, 1
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4000, 3, 2, 16, 5
#: A bin's largest pieces that are exchanged in pairs.
PAIRED = 8
#: Bins of at least this share are final before the last level.
FULL = 0.985

_PLAIN = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ȯ]|<\\||İ")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Words(dict):
    """Ids of words as bytes, found by the library when first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) > 1_000_000:
            self.clear()
        ids = self[word] = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian ids of a whole text. Latin text without special strings is split here, any other by the library."""
        if _PLAIN.search(text) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _WORD.findall(text.lower())))


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, *, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of the documents' token ids."""
    prepare(docs.sparkSession)
    size, tail = 4 * length, np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(path)
        for b in batches:
            doc, k, start, n, crc = [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = known.ids(text or "") + tail
                for i, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    doc.append(key), k.append(i), start.append(at // 4), n.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers, with what is free in each."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins = bins
        self.free = [capacity - sum(sizes[i] for i in b) for b in bins]
        self.sizes, self.capacity = sizes, capacity

    def add(self, items: list[int]) -> Packing:
        """Put items, largest first, where least is left over."""
        sizes, bins, free, capacity = self.sizes, self.bins, self.free, self.capacity
        by_free: dict[int, list[int]] = {}
        some = 0
        for k, f in enumerate(free):
            if f:
                by_free.setdefault(f, []).append(k)
                some |= 1 << f
        for i in sorted(items, key=lambda i: -sizes[i]):
            n = sizes[i]
            can = some >> n
            if can:
                f = n + (can & -can).bit_length() - 1
                at = by_free[f]
                k = at.pop()
                if not at:
                    some ^= 1 << f
                bins[k].append(i)
            else:
                k, f = len(bins), capacity
                bins.append([i])
                free.append(0)
            free[k] = left = f - n
            if left:
                if some >> left & 1:
                    by_free[left].append(k)
                else:
                    by_free[left] = [k]
                    some |= 1 << left
        return self

    def exchange(self, items: list[int]) -> list[int]:
        """Give bins with room one or two of the items for one or two smaller ones, the pair that fills a bin best; what is left, smaller items, is given back."""
        sizes = self.sizes
        left = sorted((sizes[i], i) for i in items)
        for k, room in enumerate(self.free):
            if not room or not left:
                continue
            own = self.bins[k]
            large = sorted(own, key=lambda i: -sizes[i])[:PAIRED]
            best = (0, (), ())
            for n, out in [(sizes[i], (i,)) for i in own] + [(sizes[i] + sizes[j], (i, j)) for x, i in enumerate(large) for j in large[:x]]:
                most = n + room
                at = bisect_right(left, (most, len(sizes))) - 1
                if at >= 0 and left[at][0] - n > best[0]:
                    best = (left[at][0] - n, out, (at,))
                low, high = 0, len(left) - 1
                while low < high:
                    both = left[low][0] + left[high][0]
                    if both > most:
                        high -= 1
                        continue
                    if both - n > best[0]:
                        best = (both - n, out, (low, high))
                    low += 1
                if best[0] == room:
                    break
            gain, out, places = best
            if gain:
                taken = [left[x] for x in places]
                for x in sorted(places, reverse=True):
                    del left[x]
                self.bins[k] = [i for i in own if i not in out] + [i for _, i in taken]
                self.free[k] = room - gain
                for i in out:
                    insort(left, (sizes[i], i))
        return [i for _, i in left]

    def fitness(self) -> tuple[int, float]:
        """Fewer bins are better, then more uneven ones."""
        return -len(self.bins), sum((self.capacity - f) ** 2 for f in self.free)

    def places(self) -> list[int]:
        out = [0] * len(self.sizes)
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out


def from_places(places: list[int], sizes: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(places, default=-1) + 1)]
    for i, k in enumerate(places):
        bins[k].append(i)
    return Packing(bins, sizes, capacity)


def crossover(a: Packing, b: Packing, pick: random.Random) -> Packing:
    """a with some of b's well-filled bins; without its bins that share an item with them, nor its emptiest; the displaced items best-fit."""
    order = sorted(range(len(b.bins)), key=b.free.__getitem__)
    good = order[: max(1, len(order) // 2)]
    injected = [b.bins[k] for k in pick.sample(good, max(1, len(good) * pick.randint(10, 60) // 100))]
    taken = {i for x in injected for i in x}
    worst = sorted(range(len(a.bins)), key=a.free.__getitem__)[-max(1, len(a.bins) * pick.randint(1, 8) // 100) :]
    drop = set(worst)
    kept, displaced = [], []
    for k, x in enumerate(a.bins):
        if k in drop or not taken.isdisjoint(x):
            displaced += [i for i in x if i not in taken]
        else:
            kept.append(list(x))
    child = Packing([list(x) for x in injected] + kept, a.sizes, a.capacity)
    return child.add(child.exchange(displaced))


def evolve(sizes: list[int], starts: list[list[int]], seed: int, *, capacity: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[int]:
    """The best packing that an island finds: item -> bin. starts: packings to begin with, besides best-fit ones."""
    if not sizes:
        return []
    pick, least = random.Random(seed), -(-sum(sizes) // capacity)
    pool = [from_places(p, sizes, capacity) for p in starts]
    while len(pool) < population:
        if pool and len(pool[0].bins) == least:
            return pool[0].places()
        first = pick.sample(range(len(sizes)), len(sizes) * min(3 * len(pool), 9) // 10)
        p = Packing([], sizes, capacity)
        for at in range(0, len(first), 200):
            p.add(first[at : at + 200])
        taken = set(first)
        pool.append(p.add([i for i in range(len(sizes)) if i not in taken]))
    pool.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(pool[0].bins) == least:
            break
        a, b = pick.sample(pool[: max(2, population // 2 + 1)], 2)
        child = crossover(a, b, pick)
        if child.fitness() > pool[-1].fitness():
            pool[-1] = child
            pool.sort(key=Packing.fitness, reverse=True)
    return pool[0].places()


def _epoch(state: DataFrame, capacity: int, seed: int) -> DataFrame:
    """One epoch of every island. state: shard, island, sizes and starts (packings to begin with)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                best = evolve(r["sizes"], r["starts"] or [], hash((r["shard"], r["island"], seed)), capacity=capacity)
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([best], pa.list_(pa.int32()))], ["shard", "island", "best"])

    return state.select("shard", "island", "sizes", "starts").mapInArrow(run, "shard long, island int, best array<int>")


def _level(items: DataFrame, n: int, capacity: int, level: int) -> DataFrame:
    """Items (item, size) with the shard and bin that the shard's best packing gives, and what that bin holds."""
    spark = items.sparkSession
    prepare(spark)
    shards = -(-n // SHARD)
    dealt = items.groupBy(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("i"))
    dealt = stored(dealt.select("shard", F.col("i.item").alias("items"), F.col("i.size").alias("sizes")), "shards")
    islands = dealt.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    tasks = max(1, min(shards * ISLANDS, 4 * spark.sparkContext.defaultParallelism + shards // 8))
    starts = F.lit(None).cast("array<array<int>>")
    state = islands.withColumn("starts", starts)
    for epoch in range(EPOCHS):
        with batches_of(spark, 1):
            best = stored(_epoch(state.repartition(tasks, "shard", "island"), capacity, 10 * level + epoch), "islands")
        arrived = best.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("best").alias("other"))
        state = islands.join(best, ["shard", "island"]).join(arrived, ["shard", "island"]).select("shard", "island", "sizes", F.array("best", "other").alias("starts"))
    final = best.groupBy("shard").agg(F.min_by("best", F.struct(F.array_max("best"), F.col("island"))).alias("best"))
    rows = dealt.join(final, "shard").select("shard", F.explode(F.arrays_zip("items", "sizes", "best")).alias("x"))
    rows = rows.select("shard", F.col("x.items").alias("item"), F.col("x.sizes").alias("size"), F.col("x.best").alias("bin"))
    filled = F.sum("size").over(Window.partitionBy("shard", "bin"))
    return stored(rows.withColumn("filled", filled), "level")


def pack(lengths: DataFrame, *, capacity: int = LENGTH) -> DataFrame:
    """Items (item: distinct long, length) -> item, sequence_id and offset. Full items are sequences of their own."""
    own = lengths.where(F.col("length") >= capacity).select("item", F.col("item").alias("k"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    rest = lengths.where(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("size"))
    done = [own]
    level, n = 0, rest.count()
    before = None
    while n:
        found = _level(rest, n, capacity, level)
        last = n <= SHARD
        final = found if last else found.where(F.col("filled") >= FULL * capacity)
        rest = found.where(F.col("filled") < FULL * capacity).select("item", "size")
        left = 0 if last else rest.count()
        if not last and before is not None and left > 0.8 * n:  # pooling no longer helps: keep them as they are
            final, left = found, 0
        offset = F.sum("size").over(Window.partitionBy("shard", "bin").orderBy("item")) - F.col("size")
        done.append(final.select("item", F.col("shard").alias("k"), F.lit(level).alias("level"), F.col("bin").cast("long").alias("bin"), offset.cast("long").alias("offset")))
        before, n = n, left
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    # a shard has fewer than SHARD bins; levels, shards and bins stay apart
    return out.select("item", F.when(F.col("level") < 0, -1 - F.col("k")).otherwise((F.col("k") * 64 + F.col("level")) * (2 * SHARD * 8) + F.col("bin")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, *, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    found = stored(pieces(docs, path, length=length, end=end).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return found.join(pack(found.select("item", "length"), capacity=length), "item").drop("item")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all rows; a null text is one end id, a null doc_id stays null, rows of one doc_id are packed each."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
