"""Releases of tab-separated component files: filenames, readers, typed rows, writers."""

from __future__ import annotations

import json
import os
import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import effective_time, flag
from ..plans.model import CONCEPT, CONCRETE, DESCRIPTION, MEMBER, RELATIONSHIP, Terminology, conform
from .versions import newest

#: Kinds of files, their contents, and reference set types that have no reader of their own.
_FILE = re.compile(r"([xz]*)(sct|der|doc|res|tls)(.*)")
ENTITIES = ("RelationshipConcreteValues", "StatedRelationship", "TextDefinition", "Relationship", "Description", "Identifier", "Concept", "Refset")
OTHER_REFSETS = ("OrderedAssociation", "QuerySpecification", "DescriptionType", "Annotation", "Ordered")
_SUBTYPE = re.compile(r"(.*?)(Full|Snapshot|Delta)(Current|Draft|Review)?(?:-(.*))?")
#: Reference set types named in filenames, and the columns each adds.
REFSET_FIELDS = {
    "Simple": [],
    "Association": [("target_component_id", "c")],
    "Language": [("acceptability_id", "c")],
    "RefsetDescriptor": [("attribute_description_id", "c"), ("attribute_type_id", "c"), ("attribute_order", "i")],
    "SimpleMap": [("map_target", "s")],
    "ComplexMap": [("map_group", "i"), ("map_priority", "i"), ("map_rule", "s"), ("map_advice", "s"), ("map_target", "s"), ("correlation_id", "c")],
    "ExtendedMap": [("map_group", "i"), ("map_priority", "i"), ("map_rule", "s"), ("map_advice", "s"), ("map_target", "s"), ("correlation_id", "c"), ("map_category_id", "c")],
    "AttributeValue": [("value_id", "c")],
    "ModuleDependency": [("source_effective_time", "d"), ("target_effective_time", "d")],
    "OWLExpression": [("owl_expression", "s")],
    "MRCMDomain": [(x, "s") for x in ("domain_constraint", "parent_domain", "proximal_primitive_constraint", "proximal_primitive_refinement", "domain_template_for_precoordination", "domain_template_for_postcoordination", "guide_url")],
    "MRCMAttributeDomain": [("domain_id", "c"), ("grouped", "b"), ("attribute_cardinality", "s"), ("attribute_in_group_cardinality", "s"), ("rule_strength_id", "c"), ("content_type_id", "c")],
    "MRCMAttributeRange": [("range_constraint", "s"), ("attribute_rule", "s"), ("rule_strength_id", "c"), ("content_type_id", "c")],
    "MRCMModuleScope": [("mrcm_rule_refset_id", "c")],
}


def parse_filename(path: str) -> dict | None:
    """What a release file's name says; None for other files.

    A name is file type, content, release (which documents may lack), country with namespace, and date, between underscores. The content
    ends with an entity, before which is the pattern of the reference set's fields. component: the entity, of a reference set its type.
    """
    stem, dot, extension = os.path.basename(path).partition(".")
    parts = stem.split("_")
    if not dot or len(parts) < 4 or not (kind := _FILE.fullmatch(parts[0])) or not re.fullmatch(r"\d{8}", parts[-1]):
        return None
    try:
        version = datetime.strptime(parts[-1], "%Y%m%d").date()
    except ValueError:
        return None
    place = re.fullmatch(r"(.*?)(\d*)", parts[-2])
    middle = parts[1:-2]
    sub = _SUBTYPE.fullmatch(middle[-1]) if len(middle) > 1 else None
    content = "_".join(middle[:-1] if sub else middle)
    entity = next((x for x in ENTITIES if content.endswith(x)), None)
    out = {"status": kind[1] or None, "type": kind[2], "format": kind[3] or None, "content": content, "pattern": content[: -len(entity)] or None if entity else None, "entity": entity}
    out |= dict(zip(("summary", "release", "document", "language"), sub.groups() if sub else (None,) * 4, strict=True))
    out |= {"country": place[1] or None, "namespace": place[2] or None, "version": version, "extension": extension, "path": path}
    summary = out["summary"] = out["summary"] or None
    component = entity
    if entity == "Refset":
        names = sorted((*REFSET_FIELDS, *OTHER_REFSETS), key=lambda x: -len(x))
        component = next((x for x in names if (summary or "").startswith(x)), None) or next((x for x in names if x in (summary or "")), "Simple")
    return out | {"component": component}


def files(root: str) -> list[dict]:
    """Release files under a folder, in path order."""
    found = (parse_filename(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)
    return sorted((x for x in found if x), key=lambda x: x["path"])


def importable(root: str, exclude: tuple[str, ...] = ("OWLExpression",)) -> list[dict]:
    """Snapshot files of components that have a reader."""
    return [x for x in files(root) if has_reader(x) and x["component"] not in exclude]


def has_reader(about: dict) -> bool:
    """Whether a file (as parse_filename tells it) is a snapshot of a component that can be read."""
    core = ("Concept", "Description", "Relationship", "RelationshipConcreteValues")
    plain = about["entity"] in core and not about["pattern"] or about["entity"] == "Refset" and about["component"] in REFSET_FIELDS
    return about["release"] == "Snapshot" and plain


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One release file's typed rows, whatever its release type; a file without a reader raises."""
    about = parse_filename(path)
    if about is None or not has_reader(about | {"release": "Snapshot"}):
        raise ValueError(f"no reader for {path}")
    raw, kind = read_text(spark, path), about["entity"]
    return members(raw, about) if kind == "Refset" else relationships(raw, concrete=True) if kind == "RelationshipConcreteValues" else {"Concept": concepts, "Description": descriptions, "Relationship": relationships}[kind](raw)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A file's rows as array `f` of strings: tabs separate, quotes are ordinary, the first row is left out, line ends may be CRLF."""
    lines = spark.read.text(path)
    clean = F.regexp_replace("value", "\\r$", "")
    first = spark.read.text(path).limit(1).first()
    header = "" if first is None else first[0].rstrip("\r")
    return lines.select(F.split(clean, "\t", -1).alias("f")).where((clean != header) & (clean != ""))


def headings(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).first()
    return [] if first is None else first[0].rstrip("\r").split("\t")


def _long(i: int) -> Column:
    return F.expr(f"try_cast(f[{i}] AS bigint)")


def _int(i: int) -> Column:
    return F.expr(f"try_cast(f[{i}] AS int)")


def _text(i: int) -> Column:
    return F.col("f")[i]


_CORE = [("effective_time", lambda: effective_time(_text(1))), ("active", lambda: flag(_text(2))), ("module_id", lambda: _long(3))]


def _rows(raw: DataFrame, columns: dict[str, Column], schema: str) -> DataFrame:
    return conform(raw.select(*[c.alias(n) for n, c in columns.items()]), schema)


def concepts(raw: DataFrame) -> DataFrame:
    return _rows(raw, {"id": _long(0), **{n: c() for n, c in _CORE}, "definition_status_id": _long(4)}, CONCEPT)


def descriptions(raw: DataFrame) -> DataFrame:
    return _rows(raw, {"id": _long(0), **{n: c() for n, c in _CORE}, "concept_id": _long(4), "language_code": _text(5), "type_id": _long(6), "term": _text(7), "case_significance_id": _long(8)}, DESCRIPTION)


def relationships(raw: DataFrame, *, concrete: bool = False) -> DataFrame:
    target = {"value": _text(5)} if concrete else {"destination_id": _long(5)}
    return _rows(raw, {"id": _long(0), **{n: c() for n, c in _CORE}, "source_id": _long(4), **target, "relationship_group": _int(6), "type_id": _long(7), "characteristic_type_id": _long(8), "modifier_id": _long(9)}, CONCRETE if concrete else RELATIONSHIP)


def parse_fields(pattern: str, at: int = 6) -> Column:
    """Fields from place `at` on as text by a pattern of c, i (whole numbers, null if blank) and s; another number of fields raises."""
    if set(pattern) - set("cis"):
        raise ValueError(f"pattern {pattern!r} has letters besides c, i and s")
    fields = F.array(*[_long(at + k).cast("string") if x in "ci" else _text(at + k) for k, x in enumerate(pattern)])
    return F.when(F.size("f") == at + len(pattern), fields if pattern else F.array().cast("array<string>")).otherwise(F.raise_error(F.lit(f"fields do not match pattern {pattern!r}")).cast("array<string>"))


_KIND = {"c": _long, "i": _long, "s": _text, "b": lambda i: flag(_text(i)), "d": lambda i: F.try_to_date(_text(i), "yyyyMMdd")}


def members(raw: DataFrame, about: dict) -> DataFrame:
    """Members of a reference set file: fields by pattern, and by name where the type is known."""
    known = REFSET_FIELDS[about["component"]]
    named = {n: _KIND[k](6 + i) for i, (n, k) in enumerate(known)}
    columns = {"id": F.lower(_text(0)), **{n: c() for n, c in _CORE}, "refset_id": _long(4), "referenced_component_id": _long(5), "component": F.lit(about["component"]), "fields": parse_fields(about["pattern"] or ""), **named}
    return _rows(raw, columns, MEMBER)


#: What attributes a reference set's descriptor begins with, by type. The longer of two that fit comes first.
_MAP = (900000000000500006, 900000000000501005, 900000000000502003, 900000000000503008, 900000000000504002, 900000000000505001, 1193546000)
DESCRIPTORS = {
    "ExtendedMap": (*_MAP, 609330002),
    "ComplexMap": _MAP,
    "ModuleDependency": (900000000000535008, 900000000000536009, 900000000000537000),
    "Association": (449608002, 900000000000533001),
    "Language": (449608002, 900000000000511003),
    "SimpleMap": (900000000000500006, 900000000000505001),
    "AttributeValue": (449608002, 900000000000491004),
    "OWLExpression": (449608002, 762677007),
}


def reify(rows: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Active Simple members with fields get the type that their reference set's descriptor (refset_id, attributes) begins with, and its columns.

    The descriptor's first attribute is the referenced component; a field is null in its column if it does not fit the column's kind.
    """
    may = (F.col("component") == "Simple") & F.col("active") & (F.size("fields") > 0)
    typed = F.lit(None).cast("string")
    for name, begin in reversed(DESCRIPTORS.items()):
        typed = F.when(may & (F.slice("attributes", 1, len(begin)) == F.array(*[F.lit(x).cast("bigint") for x in begin])), name).otherwise(typed)
    out = rows.join(descriptors, "refset_id", "left").withColumn("__type", typed)
    kinds = {"c": "try_cast({} AS bigint)", "i": "try_cast({} AS bigint)", "s": "{}", "d": "cast(try_to_date({}, 'yyyyMMdd') AS date)"}
    columns: dict[str, list[str]] = {}
    for name in DESCRIPTORS:
        for k, (column, kind) in enumerate(REFSET_FIELDS[name]):
            columns.setdefault(column, []).append(f"WHEN __type = '{name}' THEN {kinds[kind].format(f'get(fields, {k})')}")
    out = out.withColumns({c: F.expr(f"CASE {' '.join(x)} ELSE {c} END") for c, x in columns.items()})
    return out.withColumn("component", F.coalesce("__type", "component")).select(rows.columns)


def import_release(spark: SparkSession, *roots: str, check_ids: bool = True) -> Terminology:
    """A terminology from release folders, of each component the newest version; the first file's on ties."""
    found: dict[str, DataFrame] = {}
    heads: list[tuple] = []
    for k, about in enumerate(x for root in roots for x in importable(root)):
        raw = read_text(spark, about["path"])
        kind = about["entity"]
        rows = {"Concept": concepts, "Description": descriptions, "Relationship": relationships, "RelationshipConcreteValues": lambda r: relationships(r, concrete=True), "Refset": lambda r, a=about: members(r, a)}[kind](raw).withColumn("_file", F.lit(k))
        found[kind] = found[kind].unionByName(rows) if kind in found else rows
        if kind == "Refset":
            heads.append((rows.select("refset_id").distinct(), headings(spark, about["path"])))
    empty = lambda schema: spark.createDataFrame([], schema).withColumn("_file", F.lit(0))
    schemas = {"Concept": CONCEPT, "Description": DESCRIPTION, "Relationship": RELATIONSHIP, "RelationshipConcreteValues": CONCRETE, "Refset": MEMBER}
    t = {k: newest(found.get(k, empty(s)), ["id"], "effective_time", "_file").drop("_file") for k, s in schemas.items()}
    values = t["RelationshipConcreteValues"].where("active")  # a newer inactive row removes the value
    names = None
    for ids_of, columns in heads:
        one = ids_of.withColumn("headings", F.array(*map(F.lit, columns)))
        names = one if names is None else names.unionByName(one)
    descriptors = t["Refset"].where("active AND attribute_order IS NOT NULL").groupBy(F.col("referenced_component_id").alias("refset_id")).agg(F.sort_array(F.collect_list(F.struct("attribute_order", "attribute_description_id"))).getField("attribute_description_id").alias("attributes"))
    members_ = reify(t["Refset"], descriptors)
    return Terminology(spark, t["Concept"], t["Description"], t["Relationship"], values, members_, check_ids, names.dropDuplicates(["refset_id"]) if names is not None else None)


def unparse(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as a release file has them: dates yyyyMMdd, flags 1 and 0, nulls blank."""
    kinds = dict(rows.dtypes)
    out = []
    for c in columns:
        x = F.col(c)
        text = F.date_format(x, "yyyyMMdd") if kinds[c] == "date" else F.when(x, "1").otherwise("0") if kinds[c] == "boolean" else x.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(c))
    return rows.select(*out)


def write_release(rows: DataFrame, columns: list[str], path: str) -> None:
    """A folder of tab-separated files without quotes."""
    text = unparse(rows, columns)
    text.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)


def metadata(path: str) -> dict:
    """A release's package information: its effective time as a date, module ids as numbers; a bad file gives an error."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        when = got.get("effectiveTime")
        got["effectiveTime"] = datetime.strptime(when, "%Y%m%d").date() if when else None
        got["modules"] = {int(k): v for k, v in (got.get("modules") or {}).items()}
        return got
    except (ValueError, OSError) as e:
        return {"error": str(e), "path": path}


def save(t: Terminology, path: str) -> None:
    """The base tables and headings as Parquet, descriptions and edges clustered by concept, with a manifest of the layout's version."""
    for name in ("concept", "description", "relationship", "concrete_value", "refset_member"):
        rows = getattr(t, name)
        key = {"concept": "id", "description": "concept_id", "relationship": "source_id", "concrete_value": "source_id", "refset_member": "refset_id"}[name]
        rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")
    heads = t.headings if t.headings is not None else t.spark.createDataFrame([], "refset_id bigint, headings array<string>")
    heads.coalesce(1).write.mode("overwrite").parquet(f"{path}/headings")
    t.spark.createDataFrame([("codegrove/2", date.today())], "version string, created date").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, *, check_ids: bool = True) -> Terminology:
    version = spark.read.schema("version string, created date").json(f"{path}/manifest").first()["version"]
    if version != "codegrove/2":
        raise ValueError(f"the tables have layout {version}")
    return Terminology(spark, *[spark.read.parquet(f"{path}/{n}") for n in ("concept", "description", "relationship", "concrete_value", "refset_member")], check_ids, spark.read.parquet(f"{path}/headings"))
