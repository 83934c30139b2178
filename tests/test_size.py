"""What grows with the input is not sent through the driver, dealt by a few hot values, or multiplied before it moves."""

import random

import pytest

from codegrove.operators import graph, lookups
from codegrove.plans import ecl, ids, model
from codegrove.plans.model import Terminology, closure, from_tables
from codegrove.queries import NATION, PART, QUERIES, SEG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return from_tables(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["preferred_synonym", "preferred_synonym_by_locale", "fully_specified_name", "search_concept_ids", "search_autocomplete", "search_top_k", "extended_concept_flat"])
def test_terms_are_not_broadcast(spark, t, name):
    assert "BroadcastExchange" not in plan(QUERIES[name](spark, SF))


def test_only_given_or_few_rows_are_broadcast(spark, t):
    for name in ("ecl_expand_preferred", "search_constrained", "readable_properties"):
        for below in plan(QUERIES[name](spark, SF)).split("BroadcastExchange")[1:]:
            scan = next(x for x in below.splitlines() if "Scan" in x)
            assert "LocalTableScan" in scan or "/names-" in scan, (name, scan)


def test_given_ids_do_not_deal_rows(spark, t):
    for df in (t.refset_member.join(t.ids(SEG).toDF("refset_id"), "refset_id", "left_semi"), t.edge.join(t.ids(PART, ids.IS_A).toDF("type_id"), "type_id", "left_semi"), t.tc.join(t.ids(NATION).toDF("ancestor"), "ancestor", "left_semi")):
        assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)
    assert t.ids().count() == 0 and sorted(r["id"] for r in t.ids(3, 1).collect()) == [1, 3]


@pytest.mark.parametrize("name", ["refset_members", "member_of", "member_of_nested", "member_descendants", "synonyms_by_refset", "dialect_id_filter", "dialect_id_set", "type_id_set", "desc_type_filter", "dotted", "dotted_chain", "nested_minus", "ecl_wildcard_below", "group_conj"])
def test_no_join_sorts_by_a_type_or_a_reference_set(spark, t, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any("SortMergeJoin [" + c in text for c in ("refset_id", "type_id", "ancestor"))


def test_closure_of_leaves_takes_no_round(spark, monkeypatch):
    rng = random.Random(3)
    pairs = {(a, rng.randrange(max(1, a // 2))) for a in range(1, 40) for _ in range(2)} | {(1, 2), (2, 1)}
    pairs |= {(100 + i, rng.randrange(40)) for i in range(300)} | {(5, 5)}
    up = {a: {b for x, b in pairs if x == a and b != a} for a, _ in pairs}
    while True:
        more = {a: (s | {c for b in s for c in up.get(b, ())}) - {a} for a, s in up.items()}
        if more == up:
            break
        up = more
    seen = []
    monkeypatch.setattr(model, "stored", lambda df, name, f=model.stored: (seen.append((name, out := f(df, name))), out)[1])
    found = closure(spark.createDataFrame(sorted(pairs), "descendant bigint, ancestor bigint"))
    assert sorted((r[0], r[1]) for r in found.collect()) == sorted((a, b) for a, s in up.items() for b in s)
    rounds = [df for name, df in seen if name == "closure"][:-1]
    assert all(df.where("descendant >= 100").isEmpty() for df in rounds)


def test_pairs_are_made_after_the_join(spark, t):
    for name in ("subsumed_by", "subsumes"):
        text = plan(QUERIES[name](spark, SF))
        assert text.index("Generate explode") < text.index("SortMergeJoin")


def test_expanded_targets_move_as_arrays(spark, t):
    text = plan(graph.properties(t, expand=True))
    assert text.index("Generate explode") < text.index("Exchange")
    above = {}
    for d, a in t.tc.collect():
        above.setdefault(d, set()).add(a)
    edges = [tuple(r) for r in t.edge.select("source_id", "type_id", "destination_id").collect()]
    rows = [tuple(r) for r in graph.expanded(t).select("source_id", "type_id", "target").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(s, k, x) for s, k, d in edges for x in above.get(d, set()) | {d}}


def test_targets_without_hierarchy(spark):
    """A target that has neither a concept nor an edge upward stands for itself in expanded(), and is left out of expanded properties."""
    empty = {k: spark.createDataFrame([], s) for k, s in (("d", model.DESCRIPTION), ("c", model.CONCRETE), ("m", model.MEMBER))}
    rel = spark.createDataFrame([(1, 2, ids.IS_A), (1, 9, PART), (1, 2, PART)], "source_id bigint, destination_id bigint, type_id bigint").selectExpr("*", "true AS active", "1 AS relationship_group")
    x = Terminology(spark, model.conform(spark.createDataFrame([(1,), (2,)], "id bigint"), model.CONCEPT), empty["d"], model.conform(rel, model.RELATIONSHIP), empty["c"], empty["m"])
    assert {(r["type_id"], r["target"]) for r in graph.expanded(x).collect()} == {(ids.IS_A, 2), (PART, 9), (PART, 2)}
    assert {(r["type_id"], r["target"]) for r in graph.properties(x, expand=True).collect()} == {(ids.IS_A, 2), (PART, 2)}


def test_paths_are_joined_once_for_leaves(spark, monkeypatch):
    edges = {(1, 0), (2, 0), (3, 1), (3, 2), (10, 3), (11, 3), (12, 1), (20, 21), (21, 20), (22, 20)}
    x = type("T", (), {"isa": spark.createDataFrame(sorted(edges), "child bigint, parent bigint")})()
    seen = []
    monkeypatch.setattr(graph, "stored", lambda df, name, f=graph.stored: (seen.append((name, out := f(df, name))), out)[1])
    concepts = spark.createDataFrame([(i,) for i in (0, 3, 10, 11, 12, 22, 40)], "id bigint")
    found = {(r["id"], tuple(r["path"])) for r in graph.paths_to_root(x, concepts).collect()}
    assert found == {(0, (0,)), (40, (40,)), (3, (3, 1, 0)), (3, (3, 2, 0)), (12, (12, 1, 0))} | {(c, (c, 3, m, 0)) for c in (10, 11) for m in (1, 2)}
    assert all(df.where("id IN (10, 11, 12)").isEmpty() for name, df in seen if "path" in df.columns)
    assert len(graph.paths_to_root(x, concepts.where("id = 10"), most=4).collect()) == 2
    with pytest.raises(ValueError):
        graph.paths_to_root(x, concepts.where("id = 10"), most=3)


def test_lookups_of_given_sets(spark, t):
    assert ecl.concepts(t, f"^ (<< {SEG})").count() == ecl.concepts(t, f"^ {SEG}").count() > 0
    assert lookups.synonyms(t, t.concept, t.ids(ids.EN_GB)).count() > 0
