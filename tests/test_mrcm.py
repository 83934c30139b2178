"""Concept-model rules on a small terminology: 100002 and 100003 are below 100001, 10 and 11 below 100009; attribute 101 is for 100002."""

import pytest

from codegrove.operators import mrcm
from codegrove.plans import ids, model

RULES = "id string, effective_time date, active boolean, refset_id long, referenced_component_id long"


@pytest.fixture(scope="module")
def t(spark):
    from datetime import date

    day = date(2023, 1, 31)
    frame = lambda rows, names, schema: model.conform(spark.createDataFrame(rows, names), schema)
    isa = [(100002, 100001), (100003, 100001), (10, 100009), (11, 100009), (101, ids.CONCEPT_ATTRIBUTE), (102, ids.CONCEPT_ATTRIBUTE)]
    # in order; outside the domain; outside the range; no attribute
    edges = [(100002, 101, 10), (100003, 101, 10), (100002, 101, 100003), (100002, 11, 10)]
    known = [100001, 100002, 100003, 100009, 10, 11, 101, 102, ids.CONCEPT_ATTRIBUTE]
    rules = [
        ("d", day, True, 900, 100002, "<< 100002", None, None, None, None),
        ("e", day, False, 900, 100003, "<< 100003", None, None, None, None),
        ("f", day, True, 901, 101, None, 100002, "0..*", None, None),
        ("g", date(2022, 1, 31), True, 902, 101, None, None, None, "<< 100003", 1),
        ("h", day, True, 902, 101, None, None, None, "< 100009", 1),
    ]
    return model.Terminology(
        spark,
        frame([(k, True, ids.PRIMITIVE) for k in known], "id long, active boolean, definition_status_id long", model.CONCEPT),
        frame([(k * 10, True, k, ids.SYNONYM, f"Term {k}") for k in known], "id long, active boolean, concept_id long, type_id long, term string", model.DESCRIPTION),
        frame([(s, True, d, 0, ids.IS_A) for s, d in isa] + [(s, True, d, 1, k) for s, k, d in edges], "source_id long, active boolean, destination_id long, relationship_group int, type_id long", model.RELATIONSHIP),
        frame([], "source_id long, active boolean, value string, relationship_group int, type_id long", model.CONCRETE),
        frame(rules, f"{RULES}, domain_constraint string, domain_id long, attribute_cardinality string, range_constraint string, content_type_id long", model.MEMBER),
        check_ids=False,
    )


def test_domains_of_concepts(t):
    assert {tuple(r) for r in mrcm.concept_domains(t).collect()} == {(100002, 100002)}


def test_allowed_attributes(t):
    assert [(r["id"], r["attribute_id"], r["range_constraint"]) for r in mrcm.allowed_attributes(t, t.ids(100002, 100003)).collect()] == [(100002, 101, "< 100009")]


def test_in_range(t, spark):
    pairs = spark.createDataFrame([(101, 10), (101, 100003), (102, 100003)], "attribute_id long, value_id long")
    assert {(r["attribute_id"], r["value_id"]): r["ok"] for r in mrcm.in_range(t, pairs).collect()} == {(101, 10): True, (101, 100003): False, (102, 100003): True}


def test_property_errors(t):
    found = {(r["source_id"], r["type_id"], r["destination_id"], r["error"]) for r in mrcm.property_errors(t).collect()}
    assert found == {(100003, 101, 10, "domain"), (100002, 101, 100003, "range"), (100002, 11, 10, "attribute")}
