"""Release filenames, typing by descriptor, saved tables, modules, and readable or replaced content."""

from datetime import date

import pytest

from codegrove.operators import graph, history, lookups, text
from codegrove.plans import ids, model, scg
from codegrove.sources import rf2


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("der2_cRefset_LanguageSnapshot-en-GB_GB1000000_20180401.txt", ("Refset", "Language", "c", "Snapshot", "en-GB", "GB", "1000000")),
        ("xder2_sscccRefset_SimpleMapWithDescriptionDelta_INT_20180131.txt", ("Refset", "SimpleMap", "ssccc", "Delta", None, "INT", None)),
        ("der2_ciRefset_DescriptionTypeFull_INT_20180131.txt", ("Refset", "DescriptionType", "ci", "Full", None, "INT", None)),
        ("der2_Refset_MyOwnAssociationSnapshot_1000001_20180131.txt", ("Refset", "Association", None, "Snapshot", None, None, "1000001")),
        ("sct2_Stated_Relationship_Delta_INT_20180131.txt", ("Relationship", "Relationship", "Stated_", "Delta", None, "INT", None)),
        ("sct2_RelationshipConcreteValues_Snapshot_INT_20230131.txt", ("RelationshipConcreteValues", "RelationshipConcreteValues", None, "Snapshot", None, "INT", None)),
        ("sct2_TextDefinition_Snapshot-en_INT_20180131.txt", ("TextDefinition", "TextDefinition", None, "Snapshot", "en", "INT", None)),
        ("doc_MapGuide_Current-en-US_INT_20180131.xlsx", (None, None, None, None, None, "INT", None)),
        ("res_SubsetMapping_GB1000000_20180401.txt", (None, None, None, None, None, "GB", "1000000")),
    ],
)
def test_filenames(name, expected):
    x = rf2.parse_filename(f"/some/where/{name}")
    assert tuple(x[k] for k in ("entity", "component", "pattern", "release", "language", "country", "namespace")) == expected


@pytest.mark.parametrize("name", ["readme.txt", "sct2_Concept_Snapshot_INT_20231399.txt", "sct2_Concept_Snapshot_INT_2023.txt", "abc2_Concept_Snapshot_INT_20230131.txt", "sct2_20230131.txt"])
def test_no_filenames(name):
    assert rf2.parse_filename(name) is None


def test_readers():
    has = lambda n: rf2.has_reader(rf2.parse_filename(n))
    assert has("sct2_Concept_Snapshot_INT_20180131.txt") and has("der2_sRefset_SimpleMapSnapshot_INT_20180131.txt")
    assert not any(map(has, ["sct2_Concept_Full_INT_20180131.txt", "sct2_StatedRelationship_Snapshot_INT_20180131.txt", "sct2_Stated_Relationship_Snapshot_INT_20180131.txt", "sct2_TextDefinition_Snapshot-en_INT_20180131.txt", "der2_ciRefset_DescriptionTypeSnapshot_INT_20180131.txt"]))


def test_reify(spark):
    values = {
        "ExtendedMap": ["1", "2", "rule", "advice", "A00", "447561005", "447637006"],
        "ComplexMap": ["1", "2", "rule", "advice", "A00", "447561005"],
        "ModuleDependency": ["20200131", "20200101"],
        "Association": ["73211009"],
        "Language": [str(ids.PREFERRED)],
        "SimpleMap": ["A00"],
        "AttributeValue": ["24700007"],
        "OWLExpression": ["SubClassOf(:1 :2)"],
    }
    rows, about = [], []
    for k, (name, fields) in enumerate(values.items()):
        rows.append((f"m{k}", True, k, "Simple", fields))
        about.append((k, [*rf2.DESCRIPTORS[name], 1]))
    rows += [("off", False, 0, "Simple", values["ExtendedMap"]), ("bare", True, 0, "Simple", []), ("other", True, 99, "Simple", ["x"]), ("bad", True, 3, "Simple", ["x"])]
    members = model.conform(spark.createDataFrame(rows, "id string, active boolean, refset_id long, component string, fields array<string>"), model.MEMBER)
    got = {r["id"]: r for r in rf2.reify(members, spark.createDataFrame(about, "refset_id long, attributes array<long>")).collect()}
    assert [got[f"m{k}"]["component"] for k in range(len(values))] == list(values)
    assert [got[x]["component"] for x in ("off", "bare", "other")] == ["Simple"] * 3
    m = got["m0"]
    assert (m["map_group"], m["map_rule"], m["map_target"], m["correlation_id"], m["map_category_id"]) == (1, "rule", "A00", 447561005, 447637006)
    assert got["m1"]["map_category_id"] is None and got["m2"]["target_effective_time"] == date(2020, 1, 1)
    assert got["m3"]["target_component_id"] == 73211009 and got["m4"]["acceptability_id"] == ids.PREFERRED and got["m6"]["value_id"] == 24700007 and got["m7"]["owl_expression"] == "SubClassOf(:1 :2)"
    assert got["bad"]["component"] == "Association" and got["bad"]["target_component_id"] is None


def put(folder, name, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join("\t".join(r) + "\r\n" for r in rows))


def test_save_load_and_single_files(spark, tmp_path):
    top = tmp_path / "in"
    put(top, "sct2_Concept_Snapshot_INT_20230131.txt", ("id", "effectiveTime", "active", "moduleId", "definitionStatusId"), ("100005", "20020131", "0", "1", str(ids.DEFINED)), ("101009", "", "1", "1", str(ids.PRIMITIVE)))
    put(top, "der2_ssRefset_SimpleMapWithDescriptionSnapshot_12345_20241021.txt", ("id", "effectiveTime", "active", "moduleId", "refsetId", "referencedComponentId", "mapTarget", "mapTargetDescription"), ("u1", "20020131", "1", "1", "9", "100005", "A1", ""))
    put(top, "der2_sssssssRefset_MRCMDomainSnapshot_INT_20230131.txt", ("id", "effectiveTime", "active", "moduleId", "refsetId", "referencedComponentId", *"abcdefg"), ("u2", "20020131", "1", "1", "8", "100005", "<< 100005", "p", "c", "r", "pre", "post", "url"))
    t = rf2.import_release(spark, str(top))
    rf2.save(t, str(tmp_path / "out"))
    back = rf2.load(spark, str(tmp_path / "out"))
    assert {r["id"]: r["named"] for r in lookups.extended_items(back, back.refset_member).where("refset_id = 9").collect()} == {"u1": {"mapTarget": "A1", "mapTargetDescription": ""}}
    m = back.refset_member.where("id = 'u2'").first()
    assert (m["domain_constraint"], m["proximal_primitive_refinement"], m["domain_template_for_postcoordination"], m["guide_url"]) == ("<< 100005", "r", "post", "url")
    assert {(r["id"], r["defined"], r["primitive"]) for r in lookups.concept_flags(back).collect()} == {(100005, True, False), (101009, False, True)}
    assert rf2.read_file(spark, str(top / "sct2_Concept_Snapshot_INT_20230131.txt")).count() == 2
    with pytest.raises(ValueError):
        rf2.read_file(spark, str(top / "sct2_TextDefinition_Snapshot-en_INT_20180131.txt"))
    rf2.write_release(back.concept, ["id", "effective_time", "active", "module_id", "definition_status_id"], str(tmp_path / "text"))
    lines = {line for f in (tmp_path / "text").glob("part-*") for line in f.read_text().splitlines()}
    assert f"100005\t20020131\t0\t1\t{ids.DEFINED}" in lines


@pytest.fixture(scope="module")
def t(spark):
    """100002 and 100003 are below 100001; 100002 has attribute 101000 to 200001 and the literal #5 by 103000; 100004 was 100002."""
    day = date(2023, 1, 31)
    frame = lambda rows, names, schema: model.conform(spark.createDataFrame(rows, names), schema)
    isa = [(100002, 100001), (100003, 100001), (200001, 200000), (101000, ids.CONCEPT_ATTRIBUTE), (103000, ids.CONCRETE_ATTRIBUTE)]
    known = [100001, 100002, 100003, 100004, 100005, 200000, 200001, 101000, 103000, ids.CONCEPT_ATTRIBUTE, ids.CONCRETE_ATTRIBUTE, 300000, 300001]
    members = [
        ("d", day, True, 900, 100001, {"domain_constraint": "<< 100001"}),
        ("f", day, True, 901, 101000, {"domain_id": 100001, "attribute_cardinality": "0..*", "attribute_in_group_cardinality": "0..1", "grouped": True, "rule_strength_id": 723597001}),
        ("g", day, True, 901, 103000, {"domain_id": 100001, "attribute_cardinality": "0..1", "attribute_in_group_cardinality": "0..*", "grouped": False, "rule_strength_id": 723597001}),
        ("h", day, True, 902, 101000, {"range_constraint": "< 200000"}),
        ("s1", day, True, ids.SAME_AS, 100004, {"target_component_id": 100002}),
        ("s2", day, True, ids.POSSIBLY_EQUIVALENT, 100005, {"target_component_id": 100002}),
        ("s3", day, True, ids.POSSIBLY_EQUIVALENT, 100005, {"target_component_id": 100003}),
        ("l1", day, True, ids.EN_US, 1000021, {"acceptability_id": ids.PREFERRED}),
        ("m1", day, True, ids.MODULE_DEPENDENCY, 300001, {"source_effective_time": date(2023, 1, 1), "target_effective_time": date(2023, 1, 1)}),
    ]
    fields = "domain_constraint string, domain_id long, attribute_cardinality string, attribute_in_group_cardinality string, grouped boolean, rule_strength_id long, range_constraint string, target_component_id long, acceptability_id long, source_effective_time date, target_effective_time date"
    names = [x.split()[0] for x in fields.split(", ")]
    rows = [(i, d, a, 300000, r, c, *(x.get(n) for n in names)) for i, d, a, r, c, x in members]
    return model.Terminology(
        spark,
        frame([(k, k not in (100004, 100005), ids.PRIMITIVE) for k in known], "id long, active boolean, definition_status_id long", model.CONCEPT),
        frame([(k * 10 + 1, True, k, ids.SYNONYM, f"Term {k}") for k in known] + [(3000002, True, 300000, ids.FSN, "Own module")], "id long, active boolean, concept_id long, type_id long, term string", model.DESCRIPTION),
        frame([(s, True, d, 0, ids.IS_A) for s, d in isa] + [(100002, True, 200001, 1, 101000)], "source_id long, active boolean, destination_id long, relationship_group int, type_id long", model.RELATIONSHIP),
        frame([(100002, True, "#5", 0, 103000)], "source_id long, active boolean, value string, relationship_group int, type_id long", model.CONCRETE),
        frame(rows, f"id string, effective_time date, active boolean, module_id long, refset_id long, referenced_component_id long, {fields}", model.MEMBER),
        check_ids=False,
    )


def test_unwrapped_and_readable_properties(t):
    got = {(r["source_id"], r["type_id"]): (r["values"], r["single"]) for r in graph.properties_unwrapped(t).collect()}
    assert got[100002, 101000] == (["200001"], True) and got[100002, 103000] == (["#5"], True) and got[100002, ids.IS_A] == (["100001"], False)
    expanded = {(r["source_id"], r["type_id"]): (r["values"], r["single"]) for r in graph.properties_unwrapped(t, expand=True).collect()}
    assert expanded[100002, 101000] == (["200000", "200001"], False) and expanded[100002, 103000][1]
    shown = {(r["attribute"], r["value"]) for r in graph.readable_properties(t, [ids.EN_US], key="id", value="vec-id-syn").where("source_id = 100002").collect()}
    assert shown == {("101000", '[200001 ""]'), ("103000", "#5"), (str(ids.IS_A), '[100001 ""]')}
    with pytest.raises(ValueError):
        graph.readable_properties(t, [ids.EN_US], key="no")


def test_history_helpers(t):
    assert {(r[0], tuple(r[1])) for r in history.same_as(t).collect()} == {(100004, (100002,))}
    assert {(r[0], tuple(r[1])) for r in history.possibly_equivalent(t).collect()} == {(100005, (100002, 100003))}
    assert history.moved_to(t).count() == 0


def test_modules(t):
    assert [tuple(r) for r in lookups.module_versions(t, [ids.EN_US]).collect()] == [(300000, "Own module", date(2023, 1, 1))]
    (p,) = lookups.module_dependency_problems(t, [ids.EN_US]).collect()
    assert (p["module_id"], p["name"], p["needs"], p["installed"]) == (300000, "Own module", 300001, None)


def test_search_concept_ids(t, spark):
    got = text.search_concept_ids(t, spark.createDataFrame([(100002,), (100003,), (100002,)], "id long"), [ids.EN_GB]).collect()
    assert sorted((r["id"], r["term"]) for r in got if r["term"]) == [(100002, "Term 100002")] * 2 and len(got) == 3
    assert text.search_concept_ids(t, t.ids(100002), [ids.EN_GB], fallback=[]).first()["term"] is None


def test_expressions(t):
    e = scg.parse("100004 |old| : 101000 = (100005 : 101000 = 200001)", check_ids=False)
    (new,) = scg.replace_historical(t, [e])
    assert scg.render(new) == "100002 : 101000 = (100005 : 101000 = 200001)"
    sources = ["100002 : { 101000 = 200001 }", "100002 :", "100099", "100004", "100003 : 101000 = 100001", "200001 : 101000 = 200001", "100002 : { 103000 = #5 }", "100002 : 200001 = 100001"]
    got = scg.validate(t, sources)
    assert got[0] == [] and got[1][0][0] == "parse-error" and got[2] == [("not-found", 100099)] and got[3] == [("inactive", 100004)]
    assert got[4] == [("value-out-of-range", 101000, 100001)] and got[5] == [("attribute-not-in-domain", 101000)]
    assert got[6] == [("attribute-must-be-ungrouped", 103000)] and got[7] == [("invalid-attribute", 200001)]
    assert scg.validate(t, ["200001 : 101000 = 200001"], rules=False) == [[]]


def test_closure_of_chains_and_cycles(spark):
    edges = [(k, k + 1) for k in range(40)] + [(50, 51), (51, 52), (52, 50), (7, 50), (7, 7), (None, 3)]
    above: dict = {}
    for a, b in edges:
        if a is not None:
            above.setdefault(a, set()).add(b)

    def reach(x, seen):
        for y in above.get(x, ()):
            if y not in seen:
                seen.add(y)
                reach(y, seen)
        return seen

    got = {tuple(r) for r in model.closure(spark.createDataFrame(edges, "descendant long, ancestor long")).collect()}
    assert got == {(a, b) for a in above for b in reach(a, set()) if a != b}
    assert model.closure(spark.createDataFrame([], "descendant long, ancestor long")).count() == 0


def test_consecutive_distinct(spark):
    import random

    pick = random.Random(3)
    rows = [(k, pick.randint(0, 2), f"t{pick.randint(0, 3)}", pick.randint(0, 30)) for k in range(500)] + [(1000 + k, 7, "same", 50) for k in range(300)]
    df = spark.createDataFrame(rows, "description_id long, concept_id long, term string, place long").repartition(8)
    want, last = [], None
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        if (r[1], r[2]) != last:
            want.append(r)
        last = (r[1], r[2])
    assert sorted(map(tuple, text.consecutive_distinct(df, ["place", "description_id"]).collect())) == sorted(want)
    assert text.consecutive_distinct(df.limit(0), ["place"]).count() == 0
