"""The pipeline's stages against plain versions, on a small table."""

import duckdb
import pytest

import corpus_pipeline
from codegrove.llm import language_id, mixing, quality
from codegrove.llm.common import table


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    for name in ("documents", "labels"):
        duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/{name}.parquet') to '{out}/{name}.parquet' (format parquet)")
    return str(out)


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept, steps = docs, dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "quality", "simhash", "mixing", "packing"]

    after = steps["language_id"](spark, kept, sf_dir)
    assert after.columns == docs.columns
    match = language_id.Matcher(language_id.learn(kept.select("doc_id", "text", "lang")), language_id.PROFILE)
    plain = {r["doc_id"] for r in kept.collect() if (m := match(r["text"]))[0] != "und" and m[1] >= language_id.LEAST}
    kept = spark.createDataFrame(after.toPandas(), docs.schema)
    assert {r["doc_id"] for r in kept.collect()} == plain

    after = steps["quality"](spark, kept, sf_dir)
    con = duckdb.connect()
    con.register("documents", kept.toPandas())
    con.register("labels", table(spark, sf_dir, "labels").toPandas())
    plain = {r[0] for r in con.sql(f"select doc_id from ({quality.oracle()}) where good").fetchall()}
    assert {r["doc_id"] for r in after.collect()} == plain
    kept = spark.createDataFrame(after.toPandas(), docs.schema)

    after = steps["simhash"](spark, kept, sf_dir)
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept.collect()}
    root = {i: i for i in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in after.collect()} == {top(i) for i in ids}
    assert len(set(map(top, ids))) < len(ids)
    kept = spark.createDataFrame(after.toPandas(), docs.schema)

    after = steps["mixing"](spark, kept, sf_dir)
    con.register("documents", kept.toPandas())
    plain = {r[0] for r in con.sql(f"select doc_id from ({mixing.oracle(mixing.STAGE_BUDGET)}) where kept").fetchall()}
    assert after.columns == docs.columns and {r["doc_id"] for r in after.collect()} == plain

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert {r["doc_id"] for r in rows} == plain


def test_stages_on_odd_rows(spark, sf_dir):
    text, other = "the cat sat on the mat and looked at the dog " * 20, "all of it was said by the man in the house of the sea " * 20
    rows = [(3, other, "en", "a"), (5, text, "en", "a"), (5, other, "en", "b"), (7, text, None, None), (None, text, "en", "a"), (None, "words of its own " * 40, "en", None), (None, "words of its own " * 40, "en", None), (8, None, None, None), (9, "", "en", "a")]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "doc_id long, text string, lang string, source string, row long, quality double")
    steps = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "quality", "simhash", "mixing"):
        got = steps[name](spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert {tuple(r)[:2] for r in got.collect()} <= {r[:2] for r in rows}
        assert steps[name](spark, docs.limit(0), sf_dir).count() == 0
    kept = sorted(((r["doc_id"], r["text"]) for r in steps["simhash"](spark, docs, sf_dir).collect()), key=repr)
    # the documents without words are one group, as are the two without doc_id
    assert kept == sorted([(3, other), (5, text), (8, None), (None, rows[5][1])], key=repr)
    assert len(steps["packing"](spark, docs, sf_dir).select("doc_id").collect()) >= len(rows)
