"""The queries over whole tables against plain loops."""

import hashlib

import pytest

from codegrove.functions import identifiers
from codegrove.operators import text
from codegrove.plans import ids
from codegrove.plans.model import from_tables
from codegrove.queries import QUERIES, REGION

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return from_tables(spark, SF)


def run(spark, name):
    return {tuple(r) for r in QUERIES[name](spark, SF).collect()}


def test_graph_of_all(spark, t):
    concepts = {r["id"] for r in t.concept.collect()}
    parents: dict = {}
    for c, p in t.isa.collect():
        parents.setdefault(c, set()).add(p)
    above: dict = {}

    def up(c):
        if c not in above:
            above[c] = set().union(*({p} | up(p) for p in parents.get(c, ())))
        return above[c]

    count: dict = {}

    def paths(c):
        if c not in count:
            count[c] = sum(map(paths, parents[c])) if c in parents else 1
        return count[c]

    assert run(spark, "ancestors_of") == {(x,) for c in concepts for x in up(c) | {c}}
    assert run(spark, "paths_to_root_count") == {(c, paths(c)) for c in concepts}
    inner = set().union(*map(up, concepts))
    assert run(spark, "leaves") == {(c,) for c in concepts - inner}
    assert run(spark, "top_of_set") == {(c,) for c in concepts if not up(c) & concepts}
    places = [c for c in concepts if 10**9 <= c < 3 * 10**9]
    assert len(places) == 30
    assert run(spark, "subsumed_by") == {(a, b, b == a or b in up(a)) for a in concepts for b in places}
    name = lambda a, b: "equivalent" if a == b else "subsumes" if a in up(b) else "subsumed-by" if b in up(a) else "not-subsumed"
    assert run(spark, "subsumes") == {(a, b, name(a, b)) for a in places for b in concepts}
    assert run(spark, "intersect_ecl") == {(c,) for c in concepts if REGION in up(c)}
    kinds = {"0": "concept", "1": "description", "2": "relationship"}
    good = lambda c: 6 <= len(str(c)) <= 18 and str(c)[-3] in "01" and identifiers.is_valid(c)
    assert run(spark, "identifier_partition") == {(c, kinds.get(str(c)[-2]) if good(c) else None) for c in concepts}
    flat = {r[0]: r[2] for r in run(spark, "extended_concept_flat")}
    assert flat == {c: ",".join(map(str, sorted(up(c)))) for c in concepts}


def test_history_of_all(spark, t):
    active = {r["id"]: r["active"] for r in t.concept.collect()}
    links = [(r["source_id"], r["refset_id"], r["target_id"]) for r in t.association.collect()]
    for name, sets in {"min": [ids.SAME_AS], "mod": [ids.SAME_AS, ids.REPLACED_BY], "max": None}.items():
        rows = [(s, d) for s, k, d in links if k in (sets or [ids.SAME_AS, ids.REPLACED_BY, ids.MOVED_TO])]
        modern = set(active) | {d for s, d in rows if s in active}
        assert run(spark, f"history_{name}") == {(x,) for x in modern | {s for s, d in rows if d in modern}}
    assert run(spark, "with_historical") == run(spark, "history_mod")
    assert run(spark, "source_historical") == {(s,) for s, k, d in links if k in (ids.SAME_AS, ids.REPLACED_BY, ids.MOVED_TO) and d in active}
    now = {}
    for s, k, d in links:
        if k == ids.SAME_AS:
            now.setdefault(s, set()).add(d)
    one = {s: next(iter(d)) for s, d in now.items() if len(d) == 1}
    assert run(spark, "replace_historical") == {(c, one[c] if not a and c in one and active.get(one[c]) else c) for c, a in active.items()}


def test_text_of_all(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    folded = {d["doc_id"]: text.fold(d["text"], d["lang"]) for d in docs}
    assert run(spark, "fold_text") == {(k, len(x), hashlib.md5(x.encode()).hexdigest()) for k, x in folded.items()}
