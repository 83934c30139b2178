"""Near-duplicate embeddings by Euclidean p-stable hashing.

Equal vectors of a label are one node with a count. Nodes are normalised and projected on Gaussian directions; each table
has `width`-quantised values of a few of them as its bucket. At cosine 0.93 two unit vectors are 0.374 apart, and share a
bucket of one of the tables with probability 0.994 (0.9987 at cosine 0.95). In a bucket all pairs are compared by cosine
in double precision; a pair that shares the bucket of an earlier table is counted there only. Buckets of more than BLOCK
nodes are cut into blocks, and each pair of blocks is compared on its own, so that no task holds more than two blocks.
Tables are worked through a few at a time, so that shuffled vectors stay a few times the input.

Edge cases: vectors that are null, empty, zero, or hold null, NaN or infinite values, and those without label, link with
nothing; vectors of different lengths do not link; repeated rows are vectors of their own that link with each other; a
component whose vec_ids are all null has a null component_id, and its rows are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, components, prepare, stored, table

LEAST = 0.93
TABLES, DIRECTIONS, WIDTH, SEED = 16, 8, 2.0, 7
BLOCK = 2048
AT_ONCE = 8


def normalised(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def hashes(x: np.ndarray, tables: int, directions: int, width: float, seed: int) -> np.ndarray:
    """A 32-bit hash of each row's bucket in each table."""
    pick = np.random.default_rng(seed + x.shape[1])
    a, b = pick.standard_normal((x.shape[1], tables * directions)), pick.uniform(0, width, tables * directions)
    q = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, directions)
    out = np.zeros((len(x), tables), np.uint64)
    for k in range(directions):
        out = (out ^ q[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _coded(nodes: DataFrame, tables: int, directions: int, width: float, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2).to_pylist()
            codes: list = [None] * len(vectors)
            for n in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == n]
                for i, c in zip(at, hashes(normalised([vectors[i] for i in at]), tables, directions, width, seed), strict=True):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(codes, pa.list_(pa.int32()))], ["node", "label", "v", "n", "codes"])

    return nodes.select("node", "label", "v", "n").mapInArrow(run, "node long, label string, v array<float>, n long, codes array<int>")


def links_within(x: np.ndarray, n: np.ndarray, codes: np.ndarray, t: int, split: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each of a bucket's nodes links with, and the first node of those that links join, by number.

    Rows from `split` on are another block: pairs of one row before and one from split on are compared, or with split 0
    all pairs.
    """
    m = len(x)
    count, root = np.zeros(m, np.int64), np.arange(m)
    a_rows = range(0, split or m, 512)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for at in a_rows:
        to = min(at + 512, split or m)
        begin = split or at
        a, b = np.nonzero(x[at:to] @ x[begin:].T >= least)
        a, b = a + at, b + begin
        keep = a < b
        a, b = a[keep], b[keep]
        if t and len(a):
            fresh = np.ones(len(a), bool)
            for k in range(t):
                fresh &= codes[a, k] != codes[b, k]
            ca, cb = a[fresh], b[fresh]
        else:
            ca, cb = a, b
        np.add.at(count, ca, n[cb])
        np.add.at(count, cb, n[ca])
        links.append((a, b))
    a, b = np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    return count, root


def _compare(rows: DataFrame, least: float) -> DataFrame:
    """rows sorted by key: key, t, side (0 or 1 of a pair of blocks; null if alone), node, v, n, codes -> node, links, root of nodes with links."""

    def flush(g: list[dict]) -> tuple[list, list, list]:
        g.sort(key=lambda r: r["side"] or 0)
        split = sum(1 for r in g if r["side"] == 0) if g[0]["side"] is not None else 0
        if g[0]["side"] is not None and split in (0, len(g)):
            return [], [], []
        node = np.array([r["node"] for r in g])
        count, root = links_within(normalised([r["v"] for r in g]), np.array([r["n"] for r in g]), np.array([r["codes"] for r in g]), g[0]["t"], split, least)
        some = np.flatnonzero((count > 0) | (root != np.arange(len(g))))
        return node[some].tolist(), count[some].tolist(), node[root[some]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for r in b.to_pylist():
                if group and group[0]["key"] != r["key"]:
                    if len(group) > 1:
                        for o, x in zip(out, flush(group), strict=True):
                            o += x
                    group = []
                group.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "links", "root"])
        if len(group) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flush(group)], ["node", "links", "root"])

    return rows.mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, *, least: float = LEAST, tables: int = TABLES, directions: int = DIRECTIONS, width: float = WIDTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    prepare(spark)
    fine = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    base = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>").alias("v"), F.monotonically_increasing_id().alias("row"))
    base = stored(base.withColumn("fine", fine), "vectors")
    own = base.where("fine").groupBy("label", "v").agg(F.min("row").alias("node"), F.count("*").alias("n"))
    with batches_of(spark, 4000):
        coded = stored(_coded(own, tables, directions, width, seed), "coded")
    found = []
    for first in range(0, tables, AT_ONCE):
        ts = F.explode(F.array(*map(F.lit, range(first, min(first + AT_ONCE, tables)))))
        key = F.xxhash64("label", F.size("v"), "t", F.element_at("codes", F.col("t") + 1))
        busy = coded.select("label", "v", "codes", ts.alias("t")).groupBy(key.alias("key")).agg(F.count("*").alias("m")).where("m > 1")
        rows = coded.select("*", ts.alias("t")).withColumn("key", key).join(busy, "key")
        chunks = F.ceil(F.col("m") / block).cast("int")
        rows = rows.withColumn("c", F.pmod(F.xxhash64("node", F.lit(1)), chunks).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda s: F.struct(F.least("c", s).alias("p"), F.greatest("c", s).alias("q"), F.when(chunks > 1, F.when(F.col("c") == s, F.lit(None)).otherwise((F.col("c") > s).cast("int"))).alias("side")))
        rows = rows.select("t", "node", "v", "n", "codes", "key", F.explode(pairs).alias("b"))
        rows = rows.select(F.xxhash64("key", "b.p", "b.q").alias("key"), "t", F.col("b.side").alias("side"), "node", "v", "n", "codes")
        with batches_of(spark, 4000):
            found.append(stored(_compare(rows.repartition("key").sortWithinPartitions("key"), least), "near"))
    near = found[0]
    for x in found[1:]:
        near = near.unionByName(x)
    links = near.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = coded.select("node", "label", "v", "n").join(links, "node", "left").join(roots, "node", "left").select("label", "v", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    rows = stored(base.where("fine").join(nodes, ["label", "v"]).select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "root"), "linked")
    lowest = rows.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = rows.join(lowest, "root").select("vec_id", "n_links", "component_id")
    out = out.unionByName(base.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
