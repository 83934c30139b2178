"""Attribute groups: what constraints on one group select, on hand-made products with two ingredients and strengths."""

import pytest

from codegrove.plans import ecl, ids, model

INGREDIENT, STRENGTH, UNIT, OTHER = 762949000, 1142135004, 732945000, 116676008
A, B, C, MG = 372687004, 395938000, 387562000, 258684004
#: Products by what their groups hold.
TWO, MIXED, NUMBERS, ALONE, SPARSE, ZERO = 24700007, 73211009, 39057004, 79654002, 56265001, 64572001
EDGES = {
    TWO: [(1, INGREDIENT, A), (1, UNIT, MG), (2, INGREDIENT, B), (2, UNIT, MG)],
    MIXED: [(1, INGREDIENT, A), (1, INGREDIENT, B)],
    ALONE: [(1, INGREDIENT, A)],
    SPARSE: [(1, OTHER, A)],
    ZERO: [(0, INGREDIENT, A)],
}
NUMBERED = {TWO: [(1, "#875"), (2, "#125")], NUMBERS: [(1, "#875"), (1, "#125")], ALONE: [(1, "#875")]}


@pytest.fixture(scope="module")
def t(spark):
    frame = lambda rows, names, schema: model.conform(spark.createDataFrame(rows, names), schema)
    isa = [(x, ids.CONCEPT_ATTRIBUTE) for x in (INGREDIENT, UNIT, OTHER)] + [(STRENGTH, ids.CONCRETE_ATTRIBUTE), (A, C), (ids.CONCEPT_ATTRIBUTE, ids.ROOT), (C, ids.ROOT), (TWO, ids.ROOT)]
    known = sorted({*EDGES, *NUMBERED, INGREDIENT, STRENGTH, UNIT, OTHER, A, B, C, MG, ids.CONCEPT_ATTRIBUTE, ids.CONCRETE_ATTRIBUTE, ids.ROOT})
    rel = [(s, True, d, 0, ids.IS_A) for s, d in isa] + [(s, True, d, g, k) for s, es in EDGES.items() for g, k, d in es]
    words = [(k * 10 + 4, True, k, ids.SYNONYM if n % 2 else ids.FSN, f"Thing {k}") for k in known for n in (1,)] + [(TWO * 10 + 5, False, TWO, ids.FSN, "Old name"), (TWO * 10 + 6, True, TWO, ids.DEFINITION, "-- --")]
    accepted = [("u1", True, ids.EN_GB, A * 10 + 4, ids.ACCEPTABLE), ("u2", True, ids.EN_GB, B * 10 + 4, ids.PREFERRED), ("u3", True, ids.EN_US, C * 10 + 4, ids.PREFERRED)]
    return model.Terminology(
        spark,
        frame([(k, k != SPARSE, ids.PRIMITIVE) for k in known], "id long, active boolean, definition_status_id long", model.CONCEPT),
        frame(words, "id long, active boolean, concept_id long, type_id long, term string", model.DESCRIPTION),
        frame(rel, "source_id long, active boolean, destination_id long, relationship_group int, type_id long", model.RELATIONSHIP),
        frame([(s, True, v, g, STRENGTH) for s, vs in NUMBERED.items() for g, v in vs], "source_id long, active boolean, value string, relationship_group int, type_id long", model.CONCRETE),
        frame(accepted, "id string, active boolean, refset_id long, referenced_component_id long, acceptability_id long", model.MEMBER),
    )


@pytest.mark.parametrize(
    ("inside", "expected"),
    [
        (f"{INGREDIENT} = {A}, {STRENGTH} > #250", {TWO, ALONE}),
        (f"{INGREDIENT} = {A}, {STRENGTH} < #250", set()),
        (f"{INGREDIENT} = {B}, {STRENGTH} < #250", {TWO}),
        (f"{INGREDIENT} = {A}, {STRENGTH} = #125", set()),
        (f"{STRENGTH} = #875", {TWO, NUMBERS, ALONE}),
        (f"{STRENGTH} >= #875", {TWO, NUMBERS, ALONE}),
        (f"{STRENGTH} > #875", set()),
        (f"{STRENGTH} < #875", {TWO, NUMBERS}),
        (f"{STRENGTH} <= #125", {TWO, NUMBERS}),
        (f"{STRENGTH} < #125", set()),
        (f"{STRENGTH} != #875", {TWO, NUMBERS}),
        (f"{STRENGTH} != #999", {TWO, NUMBERS, ALONE}),
        (f"{STRENGTH} > #500", {TWO, NUMBERS, ALONE}),
        (f"{STRENGTH} < #500", {TWO, NUMBERS}),
        (f"{INGREDIENT} = ({A} OR {B})", {TWO, MIXED, ALONE}),
        (f"{INGREDIENT} != {A}", {TWO, MIXED}),
        (f"{INGREDIENT} != ({A} OR {B})", set()),
        (f"{INGREDIENT} != ({A} OR {B} OR {TWO})", set()),
        (f"{INGREDIENT} != << {C}", {TWO, MIXED}),
        (f"{INGREDIENT} = (* MINUS {A})", {TWO, MIXED}),
        (f"{INGREDIENT} = (* MINUS ({A} OR {B}))", set()),
        (f"{INGREDIENT} = (* MINUS << {C})", {TWO, MIXED}),
        (f"{INGREDIENT} = {TWO}", set()),
        (f"{INGREDIENT} = << {C}", {TWO, MIXED, ALONE}),
        (f"{INGREDIENT} = *", {TWO, MIXED, ALONE}),
        (f"{INGREDIENT} = *, {UNIT} = {MG}", {TWO}),
        (f"* = {A}", {TWO, MIXED, ALONE, SPARSE}),
        (f"{OTHER} = {A}", {SPARSE}),
    ],
)
def test_one_group_meets_all(t, inside, expected):
    assert {r[0] for r in ecl.concepts(t, f"*: {{ {inside} }}").collect()} == expected


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        (f"*: {INGREDIENT} = {A}", {TWO, MIXED, ALONE, ZERO}),
        (f"*: {INGREDIENT} != {A}", {TWO, MIXED}),
        (f"*: {INGREDIENT} != ({A} OR {B})", set()),
        (f"*: {INGREDIENT} = *", {TWO, MIXED, ALONE, ZERO}),
        (f"*: {UNIT} != {A}", {TWO}),
        ("* {{ C active = 0 }}", {SPARSE}),
        ("* {{ c ACTIVE = false }}", {SPARSE}),
        (f"{TWO} {{{{ D active = 0 }}}}", {TWO}),
        (f"{TWO} {{{{ active = 1, term = \"thing\" }}}}", {TWO}),
        (f"* {{{{ typeId = ( {ids.FSN} |Name| {ids.DEFINITION} ) }}}}", {TWO}),
        (f"* {{{{ typeId != ( {ids.SYNONYM} {ids.DEFINITION} ) }}}}", {TWO}),
        ("* {{ type = (fsn def) }}", {TWO}),
        (f"* {{{{ dialectId = ( {ids.EN_GB} (accept) {ids.EN_US} ) }}}}", {A, C}),
        (f"* {{{{ dialectId = {ids.EN_GB} (prefer) }}}}", {B}),
        ("* {{ dialect = (en-gb en-us) (prefer) }}", {B, C}),
        ("* {{ dialect = (en-gb (accept) en-us) (prefer) }}", {A, C}),
        (f"* {{{{ dialect = en-gb ({ids.ACCEPTABLE} {ids.PREFERRED}) }}}}", {A, B}),
        (f"* {{{{ dialectId = ({ids.EN_GB} OR {ids.EN_US}) }}}}", set()),
        (f'{TWO} {{{{ term = wild:"*-*" }}}}', {TWO}),
    ],
)
def test_filters_and_ungrouped(t, source, expected):
    assert {r[0] for r in ecl.concepts(t, source).collect()} == expected


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("< 99999999", "invalid-code"),
        ("<<< 73211009", "syntax-error"),
        (f"*: [5..2] {INGREDIENT} = *", "invalid-value"),
        ('* {{ term = "x", dialect = en-zzzz }}', "not-found"),
        ('* {{ term = "x", dialect = ( en-zzzz ) }}', "not-found"),
        ("* {{ C definitionStatus = primitive }}", "not-supported"),
        (f"* {{{{ C definitionStatusId = {ids.PRIMITIVE} }}}}", "not-supported"),
        (f"* {{{{ C moduleId = {ids.CORE_MODULE} |core| }}}}", "not-supported"),
        ('* {{ C effectiveTime >= "20190731" }}', "not-supported"),
        (f"* {{{{ D moduleId = {ids.CORE_MODULE} }}}}", "not-supported"),
        ('* {{ D effectiveTime >= "20190731" }}', "not-supported"),
        ('* {{ term = "x", language = sv }}', "not-supported"),
        (f'*: {{ {STRENGTH} = "PANADOL" }}', "not-supported"),
        (f"*: {{ {STRENGTH} != false }}", "not-supported"),
        (f"*: [1..3] {{ {INGREDIENT} = * }}", "not-supported"),
        (f"*: [0..0] {{ [2..*] {INGREDIENT} = * }}", "not-supported"),
        (f"*: {{ {INGREDIENT} = {A} OR {UNIT} = {MG} }}", "not-supported"),
        (f"*: {{ ({INGREDIENT} = {A} , {UNIT} = {MG}) }}", "not-supported"),
        (f"*: [3..3] R {INGREDIENT} = *", "not-supported"),
        (f"*: {{ R {INGREDIENT} = {A} }}", "not-supported"),
        (f"^ [targetComponentId] {ids.SAME_AS}", "not-supported"),
        ("> *", "not-supported"),
        (">! *", "not-supported"),
        (f"*: {TWO} = TRUE", "invalid-value"),
        (f"*: [0..0] {INGREDIENT} != {A}", "not-supported"),
        ("LOINC#54486-6", "not-supported"),
        ('* {{ term = wild:"*" }}', "invalid-value"),
    ],
)
def test_errors(t, source, kind):
    with pytest.raises(ecl.EclError) as e:
        ecl.concepts(t, source)
    assert e.value.kind == kind


def test_contains(t):
    assert ecl.contains(t, TWO, f"*: {INGREDIENT} = {A}") and not ecl.contains(t, SPARSE, f"*: {INGREDIENT} = {A}")
