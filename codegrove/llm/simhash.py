"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's two halves are cut into 16 segments of 2 bits; the bit counts of the segments are a point of a grid. The
Manhattan distance of two points is at most the Hamming distance of the halves. Fingerprints that differ in at most 4 bits
differ in at most 2 in one half: there the points are at most 2 apart, and have a common neighbour, a cell at distance 1 or
less from both. Two differing bits also leave one of three blocks of the half's segments alone, so a cell is told apart by that
block's bits themselves, and only the other segments are counted and moved: about 17 cells for each of 6 blocks. The
fingerprints of a cell are searched breadth first, each compared in all 64 bits with those not yet reached, so that a cell
of near copies costs and gives one link for each, not one for each pair. Equal fingerprints are one node, so that groups of
copies of any size cost one row. A cell is held by one task as 8 bytes for each of its distinct fingerprints; those of more
than MOST are cut into chunks, and each pair of chunks is searched on its own.

The pipeline's stage asks for a similarity of texts, not for bits: pairs that the grid finds are checked on the sets of five-word
shingles, and what similar pairs the grid leaves apart are found by the prefixes of the sets and checked alike.

Edge cases: a null text counts as empty; texts without words have fingerprint zero and link like others; fewer than four
words are one shingle; repeated shingles count each time; links are between fingerprints, so rows of one doc_id with different
texts each have their own text's component; a row without doc_id gets the smallest doc_id of its component, null if that
has none; repeated rows have the same component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, components, few, forget, prepare, stored, table

WORDS, BITS, SEED = 4, 4, 42
BLOCK = 100_000
#: Fingerprints of a cell that are searched at once.
MOST = 1_000_000
#: Fingerprints whose cells, about a hundred each, are one batch.
STEP = 5_000


def _digests(split: list[bytes], words: int) -> Iterator[bytes]:
    """Hashes of a text's shingles, 8 bytes each, BLOCK at a time."""
    n = max(len(split) - words + 1, min(1, len(split)))
    joined = b" ".join(split)
    ends = list(accumulate((len(w) + 1 for w in split), initial=0))
    last = ends[min(words, len(split)) :]
    digest = xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        yield b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(ends[at : min(n, at + BLOCK)], last[at : at + BLOCK], strict=False)])


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _vote(hashes: Iterator[bytes]) -> int:
    """The bits that more than half of the hashes have, as a signed integer."""
    ones, n = np.zeros(64, np.int64), 0
    for x in hashes:
        ones += np.unpackbits(np.frombuffer(x, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(x) // 8
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint of a whole text, as a signed integer."""
    return _vote(_digests(_split(text), words))


def fingerprints(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (long) of each row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x, words) for x in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


#: The blocks of a half: their first segment and their number of segments.
PARTS = ((0, 5), (5, 5), (10, 6))


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of fingerprints (uint64), and for each cell the place of its fingerprint.

    A cell is a number below 6 * 2**32: the half and the block, the block's bits, and two bits for the count of each other segment.
    """
    low = np.uint32(0x55555555)
    found, at = [], []
    for half in (0, 1):
        bits = (fp >> np.uint64(32 * half)).astype(np.uint32)
        counts = (bits & low) + ((bits >> np.uint32(1)) & low)
        for k, (first, size) in enumerate(PARTS):
            own = np.uint32(((1 << 2 * size) - 1) << 2 * first)
            cell = (counts & ~own) | (bits & own)
            found.append([cell])
            at.append([np.arange(len(fp))])
            for i in range(16):
                if first <= i < first + size:
                    continue
                here, one = (cell >> np.uint32(2 * i)) & np.uint32(3), np.uint32(1 << 2 * i)
                for may, moved in ((here < 2, cell + one), (here > 0, cell - one)):
                    found[-1].append(moved[may])
                    at[-1].append(np.flatnonzero(may))
            found[-1] = [np.concatenate(found[-1]).astype(np.int64) * 6 + (3 * half + k)]
    return np.concatenate([x for y in found for x in y]), np.concatenate([x for y in at for x in y])


def linked(fp: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """For each group of fingerprints (uint64, distinct) that links of at most `bits` bits join: its first, and the others."""
    out, left = [], fp
    while len(left) > 1:
        head, left, near, done = left[0], left[1:], [left[0]], []
        while near and len(left):
            close = np.bitwise_count(left ^ near.pop()) <= bits
            if close.any():
                got = left[close]
                done.append(got)
                near += list(got)
                left = left[~close]
        if done:
            out.append((head, np.concatenate(done)))
    return out


def _searched(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """rows (cell, fp) sorted by cell -> links (a, b: fingerprints, cell null); rows of cells with more than `most` come back as (fp, null, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "cell"])

        def crowd(cell: int, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(np.full(len(fp), cell))], ["a", "b", "cell"])

        last, parts, held, over = None, [], 0, False  # the cell that goes on in the next batch
        for batch in batches:
            cell, fp = (np.asarray(batch.column(k)) for k in (0, 1))
            fp, found = fp.astype(np.int64).view(np.uint64), []
            edges = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(cell)]])
            if not len(cell):
                continue
            if last is not None and cell[0] != last:
                if not over and held > 1:
                    found += [(np.full(len(x), h), x) for h, x in linked(np.concatenate(parts), bits)]
                last, parts, held, over = None, [], 0, False
            first = 0
            if last is not None or len(starts) == 1:  # the first cell began before
                parts.append(fp[: ends[0]])
                last, held, first = cell[0], held + len(parts[-1]), 1
                if held > most:
                    over = True
                if over:
                    yield crowd(last, np.concatenate(parts))
                    parts = []
                if len(starts) > 1:
                    if not over and held > 1:
                        found += [(np.full(len(x), h), x) for h, x in linked(np.concatenate(parts), bits)]
                    last, parts, held, over = None, [], 0, False
            if len(starts) > first:  # the last cell may go on
                last, parts, held, over = cell[-1], [fp[starts[-1] :]], len(cell) - starts[-1], False
                starts, ends = starts[first:-1], ends[first:-1]
                if held > most:
                    yield crowd(last, parts[0])
                    parts, over = [], True
            else:
                starts, ends = starts[:0], ends[:0]
            size = ends - starts
            two = starts[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
            found.append((fp[two], fp[two + 1]))
            for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
                if e - s > most:
                    yield crowd(cell[s], fp[s:e])
                else:
                    found += [(np.full(len(x), h), x) for h, x in linked(fp[s:e], bits)]
            yield links(found)
        if last is not None and not over and held > 1:
            yield links([(np.full(len(x), h), x) for h, x in linked(np.concatenate(parts), bits)])

    return rows.mapInArrow(run, "a long, b long, cell long")


def near_links(nodes: DataFrame, *, bits: int = BITS, most: int = MOST) -> DataFrame:
    """Links (a, b) of the fingerprints (fp: distinct), whose components are those of all pairs that differ in at most `bits` (4 at most) bits.

    Each is a pair of one component of a cell; not every one differs in so few bits itself.
    """
    if bits > 4:
        raise ValueError("the grid finds pairs of up to 4 differing bits")
    spark = nodes.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.asarray(b.column(0)).astype(np.int64).view(np.uint64)
            for first in range(0, len(every), STEP):
                fp = every[first : first + STEP]
                found, at = cells(fp)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fp[at].view(np.int64))], ["cell", "fp"])

    def search(rows: DataFrame, most: int) -> DataFrame:
        with batches_of(spark, 100_000):
            return stored(_searched(rows.repartition("cell").sortWithinPartitions("cell"), bits, most), "near")

    found = search(nodes.select("fp").mapInArrow(run, "cell long, fp long"), most)
    out, crowds = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL").select("cell", F.col("a").alias("fp"))
    if crowds.isEmpty():
        return out
    # cells of more than `most` fingerprints: each pair of chunks is a cell of its own
    half = max(1, most // 2)
    chunks = crowds.groupBy("cell").agg(F.ceil(F.count("*") / half).cast("int").alias("n"))
    rows = crowds.join(chunks, "cell").withColumn("c", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    others = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.struct(F.least("c", x).alias("p"), F.greatest("c", x).alias("q"))))
    rows = rows.select("cell", "fp", others.alias("pair")).select(F.xxhash64("cell", "pair.p", "pair.q").alias("cell"), "fp")
    return out.unionByName(search(rows, 1 << 62).select("a", "b"))


def near_duplicates(docs: DataFrame, *, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    prints = stored(fingerprints(docs, words=words), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(near_links(nodes, bits=bits)).withColumnRenamed("node", "fp")
    found = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = found.groupBy("root").agg(F.min("low").alias("component_id"))
    named = found.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage takes shingles of five words, and links texts whose sets of shingles have a Jaccard similarity of PART / OF or more.
STAGE_WORDS, PART, OF = 5, 4, 5
#: Documents, about, whose shingles are counted to tell the common ones, and how many of those are told at most. Neither changes a result.
SAMPLE, COMMON = 20_000, 100_000
#: Bits of a set's parities: how often, even or odd, it has hashes that end in each number. Sets differ in as many shingles as bits, or more.
PARITY = 512
#: How often components look for their likeliest partners, and among how many rows of a shingle, before all pairs still apart are compared. Neither changes a result.
ROUNDS, CROWD = 2, 20_000
#: Sets that are compared with one other at once.
CHUNK = 1000
#: Pairs, about, that a task holds before it gives them on, and that it remembers as given. Neither changes a result.
HELD, GIVEN = 500_000, 100_000


def shingles(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles, as signed integers in order."""
    return _distinct(b"".join(_digests(_split(text), words)))


def _distinct(hashes: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashes, ">i8").astype(np.int64))


def parities(own: np.ndarray, bits: int) -> np.ndarray:
    """Parity bits of a set: of each number below `bits`, a power of two, if an odd number of hashes ends in it."""
    return np.packbits(np.bincount(own & (bits - 1), minlength=bits) & 1).view(np.int64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Parity bits in `n` words from those of the same set in more."""
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _print(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)], dtype=np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that three documents of a sample have, in order, and in how many."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x), pa.int64())], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long")
    found = sample.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toPandas().sort_values("h")
    return found["h"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def shingle_prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, print of the set of shingles, its size, parity bits, of a set of more than PARITY shingles also as many as it has
    shingles or more, and its prefix: with any one order of all shingles, here the rare ones first, sets at the least similarity share one
    of the first size - least share + 1."""
    prepare(docs.sparkSession)
    known, often = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, prints, sizes, bits, wide, firsts = [], [], [], [], [], []
            for x in b.column(1).to_pylist():
                hashes = list(_digests(_split(x), STAGE_WORDS))
                own = _distinct(b"".join(hashes))
                count = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    count = np.where(known[at] == own, often[at], 0)
                fps.append(_vote(iter(hashes)))
                prints.append(_print(own))
                sizes.append(len(own))
                most = parities(own, max(PARITY, 1 << (len(own) - 1).bit_length()))
                bits.append(folded(most, PARITY // 64))
                wide.append(most[: len(most) if len(own) > PARITY else 0])
                firsts.append(own[np.lexsort((own, count))][: len(own) - (PART * len(own) + OF - 1) // OF + 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), _lists(bits), _lists(wide), _lists(firsts)], ["doc_id", "fp", "print", "size", "bits", "wide", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, print long, size int, bits array<long>, wide array<long>, prefix array<long>")


def _partners(pairs: DataFrame) -> DataFrame:
    """Rows (print, b, chunk, place) of the pairs (a, b): each b, at place 0, with each chunk of about CHUNK of its partners."""
    pairs = pairs.withColumn("n", F.count("*").over(Window.partitionBy("b")))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = pairs.select(F.col("a").alias("print"), "b", F.pmod(F.xxhash64("a"), chunks).cast("int").alias("chunk"), F.lit(1).alias("place"))
    heads = pairs.select("b", chunks.alias("n")).distinct().select(F.col("b").alias("print"), "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"), F.lit(0).alias("place"))
    return members.unionByName(heads)


def likely(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b: prints of nodes) that parity bits as many as the smaller set has shingles don't rule out. PARITY bits differ in
    about half at most, and so rule out no pair of long texts; no text is moved for pairs that share a shingle by chance."""
    of = nodes.select("print", "size", F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("bits")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, size = None, None, 0
        for batch in batches:
            a, b = [], []
            words = np.asarray(batch.column(5).flatten()).astype(np.int64).view(np.uint64)
            ends = np.cumsum([0, *batch.column(5).value_lengths().to_pylist()])
            for i, (key, chunk, place, name, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                found = words[ends[i] : ends[i + 1]]
                if place == 0:
                    head, own, size = (key, chunk), found.copy(), n
                elif (key, chunk) == head:
                    short = min(len(own), len(found))
                    differ = int(np.bitwise_count(folded(own, short) ^ folded(found, short)).sum())
                    if (OF + PART) * differ <= (OF - PART) * (size + n):
                        a.append(name), b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    prepare(nodes.sparkSession)
    rows = _partners(pairs).join(of, "print").select("b", "chunk", "place", "print", "size", "words")
    dealt = rows.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "place")
    return stored(dealt.mapInArrow(run, "a long, b long"), "likely")


def checked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b: prints of nodes) whose sets have the least similarity. Each b's text meets the texts of up to CHUNK
    of its partners in one task; no other text is moved."""
    spark = docs.sparkSession
    where = stored(_partners(pairs).join(nodes.select("print", "doc_id"), "print"), "where")
    texts = docs.select("doc_id", "text").join(few(where.where("doc_id IS NOT NULL")), "doc_id").select("b", "chunk", "place", "print", "text")
    lone = where.where("doc_id IS NULL").drop("doc_id")
    if not lone.isEmpty():
        own = docs.where("doc_id IS NULL").select("text", _print_of("text").alias("print")).dropDuplicates(["print"])
        texts = texts.unionByName(own.join(lone, "print").select("b", "chunk", "place", "print", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            a, b = [], []
            for key, chunk, place, name, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if place == 0 and (key, chunk) == head and own is not None:
                    continue
                found = shingles(text)
                if _print(found) != name:  # another row of this doc_id
                    continue
                if place == 0:
                    head, own = (key, chunk), found
                elif (key, chunk) == head:
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if OF * both >= PART * (len(own) + len(found) - both):
                        a.append(name), b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    prepare(spark)
    dealt = texts.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "place")
    out = stored(dealt.mapInArrow(run, "a long, b long").distinct(), "links")
    forget(where)
    return out


def nodes_of(prints: DataFrame) -> DataFrame:
    """One row for each print of a text with words, of the rows of shingle_prefixes()."""
    first = (F.first(c).alias(c) for c in ("size", "bits", "wide", "prefix"))
    return prints.where("size > 0").groupBy("print").agg(*first, F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"))


def sharing(nodes: DataFrame) -> DataFrame:
    """Rows (h, print, size, at) of the prefixes' shingles, but for those that no other row of the shingle can be a partner of: by
    its size and its place a row can have partners of a `reach` at most (times PART). Of two rows the other is known; of more the
    smallest and the farthest stand in for it."""
    by = Window.partitionBy("h")
    rows = nodes.select("print", "size", F.posexplode("prefix").alias("at", "h")).withColumn("reach", (OF + PART) * (F.col("size") - F.col("at")) - PART * F.col("size"))
    rows = rows.select("*", F.count("*").over(by).alias("n"), *(f(c).over(by).alias(f"{f.__name__}_{c}") for f, c in ((F.sum, "size"), (F.sum, "reach"), (F.min, "size"), (F.max, "reach"))))
    other = F.when(F.col("n") == 2, F.col("sum_size") - F.col("size")).otherwise(F.col("min_size"))
    reach = F.when(F.col("n") == 2, F.col("sum_reach") - F.col("reach")).otherwise(F.col("max_reach"))
    return rows.where((F.col("n") > 1) & (F.col("reach") >= PART * other) & (reach >= PART * F.col("size"))).select("print", "size", "at", "h")


def similar(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of the prints of nodes, whose components are those of all pairs at the least similarity.

    First those that the grid of fingerprints proposes; then, ROUNDS times, of the prints that share a shingle of their prefixes each
    with the likeliest one of another component; then all pairs that share one and that these links leave apart. So of a large
    group of near copies few pairs are compared, not each with each. Pairs are left out only if their places in the prefixes or
    their parity bits show that they can't have the least similarity.
    """
    same = nodes.groupBy("fp").agg(F.min("print").alias("low"))
    close = components(near_links(same.select("fp"))).withColumnRenamed("node", "fp")
    named = nodes.select("print", "fp").join(close, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("print").alias("b"))
    links = checked(docs, nodes, named.join(low, "root").where("print != b").select(F.col("print").alias("a"), "b"))

    by = Window.partitionBy("h")
    shared = stored(sharing(nodes), "shared")

    def similar_of(pairs: DataFrame) -> DataFrame:
        some = likely(nodes, pairs)
        found = checked(docs, nodes, some)
        forget(some)
        return found

    def apart(links: DataFrame) -> DataFrame:
        """The rows of shared with their roots by the links so far, of the shingles that have several roots."""
        long = shared.join(components(links).withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
        several = F.min("root").over(by) != F.max("root").over(by)
        return stored(long.withColumn("several", several).where("several").drop("several").join(nodes.select("print", "bits"), "print"), "apart")

    long = apart(links)
    for _ in range(ROUNDS):
        pairs = nearest(long)
        forget(long)
        links = links.unionByName(similar_of(pairs))
        forget(pairs)
        long = apart(links)
    forget(shared)
    # shingles of few rows in blocks, those of more by a join
    counted = long.withColumn("n", F.count("*").over(by))
    few_rows, many = counted.where(F.col("n") <= CROWD), counted.where(F.col("n") > CROWD)
    a, b = (many.select("print", "size", "at", "h", "root", "bits").toDF(x, f"s{x}", f"i{x}", "h", f"r{x}", f"m{x}") for x in "ab")
    most = F.least(F.col("sa") - F.col("ia"), F.col("sb") - F.col("ib"))
    differ = sum((F.bit_count(F.get("ma", F.lit(k)).bitwiseXOR(F.get("mb", F.lit(k)))) for k in range(PARITY // 64)), F.lit(0))
    may = ((OF + PART) * most >= PART * (F.col("sa") + F.col("sb"))) & ((OF + PART) * differ <= (OF - PART) * (F.col("sa") + F.col("sb")))
    rest = a.hint("merge").join(b, (a["h"] == b["h"]) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & may).select("a", "b")
    pairs = nearest(few_rows, every=True)
    links = links.unionByName(similar_of(pairs.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    forget(pairs)
    forget(long)
    return links


def nearest(long: DataFrame, *, every: bool = False) -> DataFrame:
    """Of each row of long (h, print, size, at, root, bits), the print with another root and the same shingle whose parity bits differ
    least, if the two can have the least similarity, as distinct pairs (a, b). Of a shingle of more than CROWD rows, among these many.
    With `every`, all such prints, not only that whose bits differ least, of shingles of at most CROWD rows; a task gives a pair once."""

    def best(size: np.ndarray, at: np.ndarray, root: np.ndarray, bits: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Places of some of a shingle's rows that have a partner, and the partners' places."""
        both = size[rows, None] + size
        may = (root[rows, None] != root) & ((OF + PART) * np.minimum((size - at)[rows, None], size - at) >= PART * both)
        differ = np.bitwise_count(bits[rows, None] ^ bits).sum(2, dtype=np.int64)
        differ = np.where(may & ((OF + PART) * differ <= (OF - PART) * both), differ, PARITY + 1)
        if every:
            return np.nonzero(differ <= PARITY)
        place = differ.argmin(1)
        some = np.flatnonzero(differ[np.arange(len(place)), place] <= PARITY)
        return some, place[some]

    def pairs(h: np.ndarray, name: np.ndarray, size: np.ndarray, at: np.ndarray, root: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
        edges = np.flatnonzero(h[1:] != h[:-1]) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(h)]])
        two = starts[ends - starts == 2]
        both = size[two] + size[two + 1]
        may = (root[two] != root[two + 1]) & ((OF + PART) * np.minimum((size - at)[two], (size - at)[two + 1]) >= PART * both)
        two = two[may & ((OF + PART) * np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1, dtype=np.int64) <= (OF - PART) * both)]
        found, held = [np.stack([name[two], name[two + 1]])], len(two)
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            step = max(1, 250_000 // (e - s))
            for first in range(s, e, step):
                some, place = best(size[s:e], at[s:e], root[s:e], bits[s:e], slice(first - s, first - s + step))
                found.append(np.stack([name[first:e][some], name[s:e][place]]))
                held += len(some)
                if held > HELD:
                    yield np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
                    found, held = [], 0
        if held:
            yield np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()

        def fresh(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            new = [x for x in zip(b.tolist(), a.tolist(), strict=True) if x not in given]
            if len(given) > GIVEN:
                given.clear()
            given.update(new[:GIVEN])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in new], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(k)).astype(np.int64) for k in range(5)] + [np.asarray(batch.column(5).flatten()).astype(np.int64).view(np.uint64).reshape(-1, PARITY // 64)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            edges = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            cut = edges[-1] + 1 if len(edges) else 0
            if not every and len(cols[0]) - cut > CROWD:
                cut = len(cols[0])
            if cut:
                for found in pairs(*(x[:cut] for x in cols)):
                    yield fresh(*found)
            held = [x[cut:] for x in cols]
        if held is not None and len(held[0]):
            for found in pairs(*held):
                yield fresh(*found)

    with batches_of(long.sparkSession, 20_000):
        rows = long.select("h", "print", "size", "at", "root", "bits").repartition("h").sortWithinPartitions("h")
        return stored(rows.mapInArrow(run, "a long, b long").distinct(), "pairs")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: of the smallest doc_id, rows without one last, and of this doc_id's texts that with the
    smallest hash. Rows of one doc_id with texts of different components are documents of their own."""
    whole = stored(shingle_prefixes(docs), "whole")
    nodes = stored(nodes_of(whole), "nodes")
    prints = stored(whole.select("doc_id", "print"), "prints")
    forget(whole)
    roots = components(similar(docs, nodes)).toDF("print", "root")
    forget(nodes)
    found = prints.select("doc_id", "print").join(roots, "print", "left").select("doc_id", "print", F.coalesce("root", "print").alias("root"))
    heads = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("x")).select("x.doc_id", "x.print")
    heads = stored(heads, "heads")
    ids = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    picked = heads.where("doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("head")).distinct()
    # what goes is less than what stays: ids that are no head, or of several rows
    odd = stored(ids.join(picked, "doc_id", "left").where("n > 1 OR head IS NULL"), "odd")
    go = few(odd.select("doc_id"))
    out = docs.where(docs["doc_id"].isNotNull()).join(go, docs["doc_id"] == go["doc_id"], "left_anti")
    several = odd.where("n > 1 AND head").select("doc_id")
    by_text = stored(heads.join(several, "doc_id", "left_semi").unionByName(heads.where("doc_id IS NULL")).select(F.col("doc_id").alias("id"), "print"), "by_text")
    if not by_text.isEmpty():
        more = few(several)
        rows = docs.join(more, docs["doc_id"] == more["doc_id"], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
        rows = rows.withColumn(_OWN, _print_of("text"))
        kept = few(by_text)
        rows = rows.join(kept, (rows[_OWN] == kept["print"]) & rows["doc_id"].eqNullSafe(kept["id"]), "left_semi")
        out = out.unionByName(rows.dropDuplicates(["doc_id", _OWN]).drop(_OWN))
    return out


_OWN = "__own_print"


def _print_of(column: str) -> F.Column:
    return F.pandas_udf(lambda x: x.map(lambda t: _print(shingles(t))), "long")(F.col(column))
