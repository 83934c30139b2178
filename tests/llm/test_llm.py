"""Each operator against a plain version, and on null, empty, repeated and crowded input."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from codegrove.llm import common, embeddings, fingerprints, html_text, language_id, licenses, mixing, packing, quality, simhash, token_counts

TEXTS = ["", None, " ", "one", "the cat sat on the mat " * 30, "the cat sat on the mat " * 29 + "the cat sat on a mat ", "x" * 5000, "Élan vital, déjà vu; ñandú. " * 40, "中文 text 🎉\n\t\x00 <s> <|endoftext|>", "the cat sat on the mat " * 30]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], ["a", "b", None][k % 3], 1, "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "the cat", "en", "a", 1, "clash")], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


# token counts


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="abcdenrst  ▁é中🎉\n.<s>19", max_size=60))
def test_token_counts_are_the_librarys(machine, pieces, text):
    assert machine.tokens([text])[0] == len(pieces.encode(text))


def test_token_counts_of_long_texts(machine, pieces, docs, empty):
    texts = ["ab" * 3000, " " * 2000 + "x", "the cat sat " * 2000, *(t or "" for t in TEXTS)]
    assert machine.tokens(texts).tolist() == [len(x) for x in pieces.encode(texts, num_threads=1)]
    found = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert found.count() == docs.count() and found.where("doc_id = 1").first()["n_tokens"] == 0
    assert token_counts.count_tokens(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# SimHash


def plain_simhash(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", TEXTS)
def test_simhash_print(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_simhash(text)


def united(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        low, high = sorted((root[i], root[j]))
        if low != high:
            root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("most", [simhash.MOST, 5])
def test_simhash_links(spark, most):
    pick = np.random.default_rng(1)
    base = pick.integers(0, 1 << 63, 60, dtype=np.int64)
    prints = set(base.tolist())
    for x in base.tolist():
        for n in (1, 2, 2, 3, 4, 4, 4, 5):
            prints.add(x ^ sum(1 << int(b) for b in pick.choice(63, n, replace=False)))
    for n in range(1, 40):  # a chain
        prints.add(sum(1 << k for k in range(n)))
    prints = sorted(prints)
    want = united(len(prints), [(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4])
    nodes = spark.createDataFrame([(x,) for x in prints], "fp long").repartition(3)
    got = {r["node"]: r["root"] for r in common.components(simhash.near_links(nodes, most=most)).collect()}
    assert [prints.index(got.get(x, x)) for x in prints] == want


def test_simhash_crowded_cells_give_a_link_for_each_fingerprint(spark):
    pick = np.random.default_rng(2)
    prints = {int(sum(1 << int(b) for b in pick.choice(63, pick.integers(0, 3), replace=False))) for _ in range(20_000)}
    assert len(prints) > 1900
    nodes = spark.createDataFrame([(x,) for x in prints], "fp long")
    links = simhash.near_links(nodes)
    assert links.count() < 110 * len(prints)
    roots = common.components(links).collect()
    assert len(roots) == len(prints) and len({r["root"] for r in roots}) == 1


def test_simhash_texts_of_one_doc_id_are_apart(spark):
    a, b = "the cat sat on the mat " * 30, "a dog ran off with all of it " * 30
    rows = [(5, a), (5, b), (3, b.replace("dog", "fox", 1)), (7, a), (None, a), (9, None), (9, None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = {(r["doc_id"], r["fp"]): r["component_id"] for r in found}
    assert len(found) == len(rows)
    assert near[7, simhash.fingerprint(a)] == near[5, simhash.fingerprint(a)] == near[None, simhash.fingerprint(a)] == 5
    assert near[5, simhash.fingerprint(b)] == 3 and near[9, 0] == 9


def test_simhash_components_and_stage(docs, empty, spark):
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert found[9] == found[4] and found[0] == found[1] == found[2] == 0
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 4 in ids and 9 not in ids and 3 in ids
    assert simhash.stage(spark, empty, "").count() == 0


def test_simhash_stage_keeps_one_of_similar_texts(spark):
    pick = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in pick.integers(0, 500, n)) for n in (60, 80, 100, 300, 3)]
    for t in texts[:4]:
        for edits in (1, 1, 2, 3, 5, 8):
            w = t.split()
            for k in pick.choice(len(w), edits, replace=False):
                w[k] = f"new{int(pick.integers(1 << 30))}"
            texts.append(" ".join(w))
        texts += [t + " and more words at the end", t.upper(), t[: len(t) * 3 // 4]]
    line = " the same long line of license text in very many of the documents"
    texts += [" ".join(f"v{int(x)}" for x in pick.integers(0, 500, 20)) + line for _ in range(30)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    apart = []
    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            bits = (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)) % (1 << 64)
            apart.append(alike and bits.bit_count() > 4)
            if alike and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert any(apart)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.stage(spark, rows, "").collect()} == set(root)
    rows = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert simhash.stage(spark, rows, "").count() == len(set(root))


def test_simhash_stage_moves_no_texts_of_long_documents_that_share_a_line(spark, monkeypatch):
    pick = np.random.default_rng(6)
    line = " one line that many long documents have somewhere in their text "
    texts = [" ".join(f"w{int(x)}" for x in pick.integers(0, 1 << 30, 2000)) for _ in range(12)]
    texts = [t[: k * 500] + line + t[k * 500 :] for k, t in enumerate(texts)]
    texts.append(texts[3].replace("w1", "v1", 20))
    met = []
    checked = simhash.checked
    monkeypatch.setattr(simhash, "checked", lambda docs, nodes, pairs: met.append(pairs.count()) or checked(docs, nodes, pairs))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.stage(spark, rows, "").collect()} == set(range(12))
    assert sum(met) == 1


def test_simhash_parities_leave_out_no_similar_pair(spark):
    pick = np.random.default_rng(7)
    texts = []
    for n in (40, 520, 700, 1030, 3000):
        t = [f"w{int(x)}" for x in pick.integers(0, 1 << 30, n)]
        texts += [" ".join(t), " ".join(t[: n * 4 // 5 + 1])] + [" ".join("new" if k % (5 * d) == 0 else w for k, w in enumerate(t)) for d in (1, 5, 9, 10, 12)]
    sets = [simhash.shingles(t) for t in texts]
    prints = [simhash._print(x) for x in sets]
    alike = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)}
    nodes = common.stored(simhash.nodes_of(simhash.shingle_prefixes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))), "nodes")
    pairs = spark.createDataFrame([(prints[i], prints[j]) for i, j in alike], "a long, b long")
    left = {(r["a"], r["b"]) for r in simhash.likely(nodes, pairs).collect()}
    assert {(prints[i], prints[j]) for (i, j), x in alike.items() if x >= 0.8} <= left
    assert not left & {(prints[i], prints[j]) for (i, j), x in alike.items() if x < 0.5 and 4 * len(sets[i]) <= 5 * len(sets[j]) <= 6 * len(sets[i])}
    # rows that sharing() leaves out are those that no row of their shingle is a possible partner of
    left = {(r["h"], r["print"]) for r in simhash.sharing(nodes).collect()}
    rows = {}
    for r in nodes.collect():
        for at, h in enumerate(r["prefix"]):
            rows.setdefault(h, []).append((r["print"], r["size"], at))
    for h, some in rows.items():
        for p, size, at in some:
            if any(9 * min(size - at, s - k) >= 4 * (size + s) for q, s, k in some if q != p):
                assert (h, p) in left


@pytest.mark.parametrize("every", [False, True])
def test_simhash_nearest_gives_pairs_on_in_parts(spark, monkeypatch, every):
    pick = np.random.default_rng(8)
    size, bits = 60, [int(x) for x in pick.integers(0, 1 << 62, 8)]
    rows = [(h, p, size, 0, p, bits) for h in range(3) for p in range(150)]
    long = spark.createDataFrame(rows, "h long, print long, size int, at int, root long, bits array<long>").coalesce(1)
    whole = {tuple(r) for r in simhash.nearest(long, every=every).collect()}
    monkeypatch.setattr(simhash, "HELD", 1000)
    monkeypatch.setattr(simhash, "GIVEN", 500)
    assert {tuple(r) for r in simhash.nearest(long, every=every).collect()} == whole
    assert len(whole) == (150 * 149 // 2 if every else 149)


def test_simhash_cells_come_in_small_batches(spark, monkeypatch):
    cells = simhash.cells

    def bounded(fp):
        assert len(fp) <= 5000
        return cells(fp)

    monkeypatch.setattr(simhash, "cells", bounded)
    pick = np.random.default_rng(9)
    nodes = spark.createDataFrame([(int(x),) for x in pick.integers(-(1 << 63), (1 << 63) - 1, 12_000)], "fp long").coalesce(1)
    assert simhash.near_links(nodes).count() == 0


def test_stored_leaves_no_shuffled_files(spark):
    import time

    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before = files()
    rows = common.stored(spark.range(1000).groupBy("id").count(), "rows")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before
    assert rows.count() == 1000


@settings(max_examples=5, deadline=None)
@given(links=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, links):
    root = {x: x for ab in links for x in ab if ab[0] != ab[1]}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in links:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    for few in (0, common.FEW_ROWS):  # on tables, and in one task
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "FEW_ROWS", few)
            found = common.components(spark.createDataFrame(links, "a long, b long"))
        assert {tuple(r) for r in found.select("node", "root").collect()} == {(x, top(x)) for x in root}


@settings(max_examples=100, deadline=None)
@given(links=st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), max_size=120))
def test_united(links):
    import pyarrow as pa

    nodes = sorted({x for ab in links for x in ab})
    root = united(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in links])
    batches = [pa.record_batch([pa.array([a for a, _ in x], pa.int64()), pa.array([b for _, b in x], pa.int64())], ["a", "b"]) for x in (links[:50], links[50:])]
    (out,) = common._united(iter(batches))
    assert dict(zip(out["node"].to_pylist(), out["root"].to_pylist(), strict=True)) == {x: nodes[root[k]] for k, x in enumerate(nodes)}


# packing


def test_words_are_the_librarys():
    known = packing.words(public_tokenizers.path("word_bpe_49k.json"))
    for t in [*TEXTS, "I'M we'LL '' 's x's __ a1b22", "é ſ K ½ ²", "İstanbul\x1cß\x85a"]:
        ids = known.library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(known.ids(t or ""), "<u4").tolist() == ids


def test_packing(docs, empty, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, length=100).collect()
    known = packing.words(path)
    expected = Counter()
    for d in docs.collect():
        ids = known.ids(d["text"] or "") + np.array([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 400)):
            expected[d["doc_id"], k, at // 4, len(ids[at : at + 400]) // 4, zlib.crc32(ids[at : at + 400])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 100
    assert packing.pack_documents(empty, path).count() == 0


def triplets(seed, n, capacity=100):
    """Sizes of n full bins of three, which best-fit packs into more bins than needed."""
    pick, sizes = np.random.default_rng(seed), []
    while len(sizes) < 3 * n:
        a, b = (int(x) for x in pick.integers(26 * capacity // 100, 49 * capacity // 100, 2))
        if 26 * capacity // 100 <= capacity - a - b <= 49 * capacity // 100:
            sizes += [a, b, capacity - a - b]
    return sizes


def test_evolution_needs_fewer_bins_than_best_fit(monkeypatch):
    real, calls = packing.crossover, []
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or real(*a))
    for seed in range(4):
        sizes = triplets(seed, 40)
        fit = len(packing.Packing([], sizes, 100).add(list(range(len(sizes)))).bins)
        islands = [packing.evolve(sizes, [], k, capacity=100) for k in range(3)]
        moved = [packing.evolve(sizes, [islands[k], islands[k - 1]], 10 + k, capacity=100) for k in range(3)]
        assert calls and max(np.bincount(islands[0], sizes)) <= 100
        assert min(map(max, islands)) + 1 <= fit - 3 and min(map(max, moved)) <= min(map(max, islands))
    assert packing.evolve([], [], 1, capacity=10) == []


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 50), min_size=2, max_size=60), seed=st.integers(0, 99))
def test_crossover_keeps_every_piece(sizes, seed):
    import random

    pick = random.Random(seed)
    a, b = (packing.Packing([], sizes, 50).add(pick.sample(range(len(sizes)), len(sizes))) for _ in range(2))
    child = packing.crossover(a, b, pick)
    assert sorted(i for x in child.bins for i in x) == list(range(len(sizes)))
    assert [50 - sum(sizes[i] for i in x) for x in child.bins] == child.free and min(child.free) >= 0


def test_packing_of_hard_sizes_uses_evolution(spark):
    """Islands on Spark, with migration: fewer sequences than best-fit alone."""
    sizes = triplets(7, 60)
    fit = len(packing.Packing([], sizes, 100).add(list(range(len(sizes)))).bins)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    rows = packing.pack(items, capacity=100).join(items, "item").collect()
    used: dict = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == len(sizes) and len(used) <= fit - 4
    for x in used.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in (before, "1000")


# quality, mixing


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toPandas())
    return con.sql(sql).fetchall()


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, 0), (6, 0, 0), (8, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(quality._sites(docs), labels)
    assert found.count() == docs.count() and found.where("quality < 0 OR quality > 1 OR quality IS NULL").count() == 0
    assert found.where("doc_id = 4").first()["quality"] > found.where("doc_id = 6").first()["quality"]
    assert quality.classify(quality._sites(docs), labels.limit(0)).where("good").count() == docs.count()
    assert quality.classify(quality._sites(empty), labels).count() == 0


def test_mixing(docs, empty, spark):
    described = mixing.described(docs)
    small, large = (mixing.mix(described, max_cells=n) for n in (1000, 0))
    assert pairs(small.select("doc_id", "n_tokens", "probability", "kept")) == pairs(large.select("doc_id", "n_tokens", "probability", "kept"))
    assert small.count() == docs.count() and small.where("probability < 0 OR probability > 1").count() == 0
    cells = described.groupBy("source", "lang", "topic").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens")
    aim = {"source": {"a": 0.5, "b": 0.25, "": 0.25}}
    raked = mixing.rake(cells, rounds=60, powers={"source": 1.0, "lang": 1.0, "topic": 1.0}, targets=aim).toPandas()
    share = raked.groupby("source")["w"].sum() / raked["w"].sum()
    assert abs(share.sum() - 1) < 1e-9
    grid = [(s, g, t, int(n)) for (s, g, t), n in zip([(s, g, t) for s in "abc" for g in ("en", "fr") for t in ("note", "list")], np.random.default_rng(4).integers(1, 1000, 12), strict=True)]
    wanted = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.8, "fr": 0.2}, "topic": {"note": 0.35, "list": 0.65}}
    for most in (1000, 0):
        even = mixing.rake(spark.createDataFrame(grid, "source string, lang string, topic string, tokens long"), rounds=40, targets=wanted, max_cells=most).toPandas()
        for dim, aims in wanted.items():
            got = even.groupby(dim)["w"].sum() / even["w"].sum()
            assert all(abs(got[v] - a) < 1e-6 for v, a in aims.items())
    assert mixing.mix(mixing.described(empty)).count() == 0


# fingerprints


def plain_print(text, cache):
    """The samples of a text as (term, t), worked out one by one."""
    import math

    bag = Counter(w for w in re.split(fingerprints.SPACE, text) if w)
    out = []
    for block in range(4):
        for k in range(fingerprints.BLOCK):
            best = None
            for w, n in bag.items():
                length = min(len(w), 65535)
                h = (((xxhash.xxh64_intdigest(w.encode(), 42) & ~65535 & (1 << 64) - 1) | length) ^ (1 << 63)) - (1 << 63)
                key = h, block, k
                if key not in cache:
                    g = spark_hash(h, block)
                    u, v = (xxhash.xxh64_intdigest(struct.pack("<Q", g ^ x), 42) for x in (2 * k, 2 * k + 1))
                    part = lambda x, at, n: ((x >> at & (1 << n) - 1) + 0.5) / (1 << n)
                    cache[key] = -math.log(part(u, 0, 32) * part(u, 32, 32)), -math.log(part(v, 0, 21) * part(v, 21, 21)), part(v, 42, 22)
                r, c, b = cache[key]
                t = math.floor(math.log(n * length) / r + b)
                best = min(best or (math.inf,), (math.log(c) - r * (t - b + 1), w, t))
            out.append(best and best[1:])
    return out


def spark_hash(h, block):
    first = xxhash.xxh64_intdigest(struct.pack("<q", h), 42)
    return xxhash.xxh64_intdigest(struct.pack("<i", block), first)


def near(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def by_brute_force(rows):
    """doc_id -> what the query returns, but for the fingerprints' digits; from (doc_id, text) in order."""
    cache: dict = {}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (key, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        p, e, n = (plain_print(t, cache) for t in (text, edited, after))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(p, e), near(p, n)))
    return out


def test_fingerprints(docs, empty, spark):
    pick = np.random.default_rng(11)
    texts = [" ".join(f"w{int(x)}" for x in pick.zipf(1.4, int(n)) % 80) for n in pick.integers(1, 120, 25)]
    texts += [texts[3], "ç🎉é " * 7, "", None, "word", "\t \n"]
    rows = [(3 * k, t) for k, t in enumerate(texts)] + [(6, texts[2]), (None, "b a"), (None, "a a")]
    for some in (rows, rows[:1], rows[:2], [(None, "x y z")]):
        got = fingerprints.fingerprint_edits(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()
        key = lambda r: (r[0] is None, -(r[0] or 0), r[2], r[3], r[4])
        found = sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got], key=key)
        assert found == sorted(by_brute_force(some), key=key)
    by_text: dict = {}
    whole = {d["doc_id"]: d["text"] or "" for d in docs.collect()}
    for r in fingerprints.fingerprint_edits(docs).collect():
        assert r["n_chars"] == len(whole[r["doc_id"]]) and by_text.setdefault(whole[r["doc_id"]], r["fingerprint"]) == r["fingerprint"] and len(r["edited_fingerprint"]) == 256
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_fingerprints_do_not_depend_on_the_common_terms(docs, monkeypatch):
    results = []
    for common in (65_536, 12, 0):
        monkeypatch.setattr(fingerprints, "COMMON", common)
        assert (fingerprints._common(docs, 64).count() > 0) == (common > 0)
        results.append(pairs(fingerprints.fingerprint_edits(docs)))
    assert results[0] == results[1] == results[2]


def test_fingerprints_follow_jaccard(spark):
    pick = np.random.default_rng(5)
    bag = lambda t: Counter(t.split())
    texts = [" ".join(f"w{int(x)}" for x in pick.zipf(1.6, 80) % 60) for _ in range(20)]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    off = []
    for i in range(20):
        for j in range(i):
            a, b = bag(texts[i]), bag(texts[j])
            weight = lambda c, k: c[k] * len(k)
            keys = set(a) | set(b)
            true = sum(min(weight(a, k), weight(b, k)) for k in keys) / sum(max(weight(a, k), weight(b, k)) for k in keys)
            off.append(sum(got[i][4 * k : 4 * k + 4] == got[j][4 * k : 4 * k + 4] for k in range(64)) / 64 - true)
    assert abs(np.mean(off)) < 0.04 and np.std(off) < 0.1


# pages


def test_main_text(spark):
    page = '<html><head><title>t</title></head><body><nav><a href="/">home</a></nav><div class="main-story"><h1>Big &amp; <i>n</i>ews</h1><p>First<br>second  line<p>third</div><div class="cookie-notice">ok?</div><footer>x</footer><script>var a="<p>";</script>'
    article = "<html><body><header>menu</header><article><p>A&nbsp;b</p><aside>no</aside><form>no</form><div id='comments'><p>no</p></div><p>c</article><p>after</body></html>"
    rows = [(k, f"http://h/{k}", page) for k in range(4)] + [(9, "http://one/", article), (10, None, None), (11, "http://h/x", ""), (9, "http://one/", article)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got[0] == got[3] == "Big & news First second line third" and got[9] == "A b c" and got[10] == got[11] == ""
    assert html_text.extract(pages).count() == len(rows) and html_text.extract(pages.limit(0)).count() == 0


def test_main_text_keeps_all_parts_of_the_article(spark):
    def page(k):
        long = " ".join(f"word{k}x{i}" for i in range(200))
        return f'<html><body><div class="top">Site {k}</div><div class="story"><h1>Title {k}</h1><p>{long}<h2>Part {k}</h2><p>{long}<ul><li>one {k}<li>two {k}</ul><blockquote>quote {k}</blockquote><table><tr><td>cell {k}</table></div><div class="menu"><p>{long}</div></body></html>', f"Title {k} {long} Part {k} {long} one {k} two {k} quote {k} cell {k}"

    plain = f"<p>{'some text ' * 50}<h2>small</h2>"
    rows = [(k, f"http://h/{k}", page(k)[0]) for k in range(4)] + [(k, "http://bare/", plain) for k in (8, 9)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == page(k)[1] for k in range(4)) and got[8] == got[9] == "some text " * 50 + "small"


def test_main_text_by_the_template(spark):
    """Without article elements, a page alone can't tell its text from a box of links and words that all pages have."""
    box = " ".join(f"common{i}" for i in range(30))
    page = lambda k: f'<html><body><div class="top"><span>{box}</span></div><div class="story"><p>{" ".join(f"own{k}x{i}" for i in range(150))}</p><p>end {k}</p></div></body></html>'
    pages = spark.createDataFrame([(k, f"http://h/{k}", page(k)) for k in range(5)], "page_id long, url string, html string")
    for r in html_text.extract(pages).collect():
        k = r["page_id"]
        alone = html_text.main_text(page(k), None)
        assert r["text"] == " ".join(f"own{k}x{i}" for i in range(150)) + f" end {k}" and alone == f"{box} {r['text']}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p title=it's>don't</p><p>end</article>", "don't end"),
        ('<article><p title="a>b">one</p><p title=\'c>d\'>two</p></article>', "one two"),
        ('<article class="alert-story"><div class="article-ad-free content">kept</div><div class="ad-slot-3">no</div></article>', "kept"),
        ('<article class="no-sidebar"><div class="comment-body">no</div><div class="article-comments">no</div><div class="related-articles">no</div><p class="post-header">no</p><p>yes</article>', "yes"),
        ('<article><div aria-label="Related stories">no</div><section aria-label="What the story says">yes</section></article>', "yes"),
        ("<article>" + "<div>" * 50_000 + "deep" + "</b></p>" * 1000 + "</article>", "deep"),
        ("<main>a<br>b &lt;p&gt; &#233;&eacute; <![CDATA[c < d]]> &bogus;</main>", "a b <p> éé c < d &bogus;"),
        ("<article>cut <b", "cut"),
        ("", ""),
    ],
)
def test_main_text_of_a_page(html, text):
    assert html_text.main_text(html, None) == text


def test_main_text_of_nested_elements_is_linear():
    import tracemalloc

    def peak(n):
        tracemalloc.start()
        assert html_text.main_text("<div>" * n + "x", None) == "x"
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(40_000) < 6 * peak(10_000)


def test_main_text_of_many_slots(spark, monkeypatch):
    page = "<html><body><div>" + "".join(f'<section id="s{chr(97 + k // 26)}{chr(97 + k % 26)}"><p>text number {k:03}</p></section>' for k in range(300)) + "</div></body></html>"
    pages = spark.createDataFrame([(k, f"http://h/{k}", page) for k in range(2)], "page_id long, url string, html string")
    for few in (1 << 40, -1):
        monkeypatch.setattr(html_text, "FEW_CHARS", few, raising=False)
        assert [r["text"] for r in html_text.extract(pages).collect()] == [" ".join(f"text number {k:03}" for k in range(300))] * 2


# embeddings


def test_embeddings(spark):
    pick = np.random.default_rng(2)
    base = pick.standard_normal((40, 16))
    rows = [(k, v.astype(np.float32).tolist(), k % 2) for k, v in enumerate(np.concatenate([base, base + 0.02 * pick.standard_normal((40, 16)), 2 * base[:10]]))]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, rows[0][1], None), (505, [1.0, 2.0], 1), (0, rows[0][1], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"], r["n_links"]) for r in embeddings.near_duplicates(vectors, block=8).collect()), key=repr)
    x = {i: np.array(v, float) / np.linalg.norm(v) for i, (k, v, lab) in enumerate(rows) if v and lab is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    expected = [(k, sum(i != j and i in x and j in x and rows[j][2] == lab and x[i] @ x[j] >= 0.93 for j in range(len(rows)))) for i, (k, _, lab) in enumerate(rows)]
    assert got == sorted(expected, key=repr)
    fine = [i for i in x]
    linked = [(i, j) for i in fine for j in fine if i < j and rows[i][2] == rows[j][2] and x[i] @ x[j] >= 0.93]
    root = united(len(rows), linked)
    lowest: dict = {}
    for i, (k, *_) in enumerate(rows):
        lowest[root[i]] = min(lowest.get(root[i], k), k)
    whole = sorted(((r["vec_id"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(vectors).collect()), key=repr)
    assert whole == sorted(((k, lowest[root[i]], k == lowest[root[i]]) for i, (k, *_) in enumerate(rows)), key=repr)
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


# language, licenses


def test_language(docs, empty, spark):
    train = spark.createDataFrame([(k, ("the cat and the dog of the house " if k % 2 else "le chat et le chien de la maison ") * 5, "en" if k % 2 else "fr") for k in range(20)], "doc_id long, text string, lang string")
    profiles = language_id.learn(train)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, profiles).collect()}
    assert got[1] == ("und", 0.0) and got[0] == ("und", 0.0) and got[4][0] == "en"
    assert language_id.Matcher(profiles, language_id.PROFILE)("le chien et la maison")[0] == "fr"
    assert language_id.learn(train.limit(0)) == {} and language_id.identify(docs, {}).where("lang_pred != 'und'").count() == 0
    assert language_id.identify(empty, profiles).count() == 0


def test_language_query(spark, tmp_path):
    """Held-out rows are those of the rule, what they say of their language is not learnt, and held-out texts are told right."""
    words = {"en": "the cat and dog of this house were in the garden when it rained".split(), "fr": "le chat et le chien de la maison dans le jardin quand il pleuvait".split(), "de": "die katze und der hund des hauses waren im garten als es regnete".split()}
    pick = np.random.default_rng(8)
    rows = []
    for k in range(240):
        lang = ("en", "fr", "de")[k % 3]
        held = zlib.crc32(str(k).encode()) % 3 == 1
        # every held-out label is wrong: what is learnt from it would show
        rows.append((k, " ".join(pick.choice(words[lang], 40)), "xx" if held else lang, "s", 1))
    rows += [(1000, None, "en", "s", 1), (1001, "12 34 --", "en", "s", 1), (None, "le chien et la maison", "fr", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in language_id.op8_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k in range(240):
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and got[k]["lang_pred"] == ("en", "fr", "de")[k % 3] and 0 <= got[k]["score"] <= 1
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[None]["lang_pred"] == "fr" and got[None]["held_out"] is False


def test_language_stage_keeps_columns_of_any_name(docs, spark):
    kept = language_id.stage(spark, docs.withColumn("rows", docs["n_chars"]), "")
    assert kept.columns == [*docs.columns, "rows"] and {r["score"] for r in kept.collect()} == {"clash"}
    assert simhash.stage(spark, kept, "").columns == kept.columns


def test_rank_order_distance():
    match = language_id.Matcher({"x": [97, 98], "y": [98, 97]}, 5)
    codes, counts = language_id.grams("aab")
    own = language_id.ranked(codes, counts, 5).tolist()
    apart = {lang: sum(abs(k - p.index(c)) if c in p else 5 for k, c in enumerate(own)) for lang, p in {"x": [97, 98], "y": [98, 97]}.items()}
    best = min(sorted(apart), key=apart.get)
    assert match("aab") == (best, 1 - apart[best] / (len(own) * 5))


def test_licenses(docs, empty):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        found = scanner(f"before it. {text} and after")
        assert [m[0] for m in found] == [name] and found[0][4] == 1.0
    words = licenses.TEMPLATES["mit"].split()
    words[10] = "other"
    del words[30]
    (m,) = scanner("intro " + " ".join(words))
    assert m[0] == "mit" and 0.95 < m[4] < 1
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0


def matched(words, template):
    """Words of the longest common subsequence of two lists."""
    row = [0] * (len(template) + 1)
    for w in words:
        before = 0
        for k, x in enumerate(template):
            before, row[k + 1] = row[k + 1], before + 1 if w == x else max(row[k], row[k + 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_licenses_by_brute_force(seed):
    """Every wording put between other words, some with a word changed or left out, is found where it is, with as many words as a full alignment matches."""
    pick = np.random.default_rng(seed)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    text, want = "", []
    for name in pick.permutation(sorted(licenses.TEMPLATES)):
        own = [m[0] for m in re.finditer(r"\S+", licenses.TEMPLATES[name])]
        edited = list(own)
        if len(own) > 20:
            for _ in range(int(pick.integers(0, 3))):
                k = int(pick.integers(3, len(edited) - 3))
                edited[k : k + 1] = [] if pick.random() < 0.5 else [f"changed{k}"]
        text += " ".join(f"filler{int(x)}" for x in pick.integers(0, 50, int(pick.integers(5, 40)))) + " "
        begin = len(text)
        text += " ".join(edited) + " "
        want.append((str(name), begin, matched(licenses.words(" ".join(edited))[0], licenses.words(licenses.TEMPLATES[name])[0])))
    found = scanner(text)
    assert [(m[0], m[3]) for m in found] == [(n, k) for n, _, k in want]
    for (name, begin, end, _, coverage), (_, at, n) in zip(found, want, strict=True):
        assert abs(begin - at) <= 2 and begin < end <= len(text) and coverage == n / len(licenses.words(licenses.TEMPLATES[name])[0])


def test_licenses_repeated():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for n in (2, 3, 7):
            whole = f"before it. {' '.join([text] * n)} and after"
            found = scanner(whole)
            assert [m[0] for m in found] == [name] * n and all(m[4] == 1.0 for m in found)
            assert [whole[a:b] for _, a, b, _, _ in found] == [text.rstrip(".)/")] * n
