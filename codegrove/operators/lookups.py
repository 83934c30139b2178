"""Lookups by concept: descriptions, preferred terms, reference set membership, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import ids
from ..plans.model import Terminology
from ..plans.storage import large, members_of


def by_id(rows: DataFrame, *values: int | str) -> DataFrame:
    return rows.where(F.col("id").isin(*values))


def first_ids(t: Terminology, n: int) -> DataFrame:
    """The n lowest concept ids."""
    return t.concept.select("id").orderBy("id").limit(n)


def concept_flags(t: Terminology) -> DataFrame:
    """id, defined and primitive of every concept."""
    return t.concept.select("id", *[F.coalesce(F.col("definition_status_id") == v, F.lit(False)).alias(n) for n, v in (("defined", ids.DEFINED), ("primitive", ids.PRIMITIVE))])


def description_flags(t: Terminology) -> DataFrame:
    """id, is_fsn, is_synonym and is_definition of every description."""
    return t.description.select("id", *[F.coalesce(F.col("type_id") == v, F.lit(False)).alias(n) for n, v in (("is_fsn", ids.FSN), ("is_synonym", ids.SYNONYM), ("is_definition", ids.DEFINITION))])


def concepts_of(t: Terminology, described: DataFrame) -> DataFrame:
    """description_id and concept_id of the descriptions (id) that the search table has."""
    return t.substrate.select("description_id", "concept_id").join(described.select(F.col("id").alias("description_id")), "description_id", "left_semi")


def language_refsets(t: Terminology) -> DataFrame:
    """Installed language reference sets: those with a member that has an acceptability."""
    return t.refset_member.where("acceptability_id IS NOT NULL").select("refset_id").distinct()


def descriptions(t: Terminology, concepts: DataFrame) -> DataFrame:
    return t.description.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").orderBy("concept_id", "id")


def synonyms(t: Terminology, concepts: DataFrame, refsets: DataFrame | None = None) -> DataFrame:
    """Synonyms, inactive too; with language reference sets, the active ones that are members of any of them."""
    found = descriptions(t, concepts).where(F.col("type_id") == ids.SYNONYM)
    if refsets is None:
        return found
    members = t.member.join(refsets.select(F.col("id").alias("refset_id")), "refset_id", "left_semi").select(F.col("referenced_component_id").alias("id"))
    return found.where("active").join(members_of(members), "id", "left_semi")


def refset_items(t: Terminology, components: DataFrame, refset_id: int | None = None) -> DataFrame:
    """Active members of components, of one reference set or of all."""
    rows = t.member if refset_id is None else t.member.where(F.col("refset_id") == refset_id)
    return rows.join(components.select(F.col("id").alias("referenced_component_id")), "referenced_component_id", "left_semi")


def refset_ids(t: Terminology) -> DataFrame:
    """component_id and refset_id: the reference sets of every component."""
    return t.member.select(F.col("referenced_component_id").alias("component_id"), "refset_id").distinct()


def preferred_description(t: Terminology, type_id: int, refsets: list[int]) -> DataFrame:
    """concept_id, description_id and term: the active description of a type that the first of the language reference sets having one prefers, lowest id first."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(refsets) for x in (r, k)])
    members = t.member.where(F.col("refset_id").isin(refsets) & (F.col("acceptability_id") == ids.PREFERRED)).select(F.col("referenced_component_id").alias("id"), order[F.col("refset_id")].alias("place"))
    rows = t.description.where(F.col("active") & (F.col("type_id") == type_id)).join(large(members), "id")
    return rows.groupBy("concept_id").agg(F.min(F.struct("place", "id", "term")).alias("x")).select("concept_id", F.col("x.id").alias("description_id"), F.col("x.term").alias("term"))


def preferred_synonym(t: Terminology, refsets: list[int]) -> DataFrame:
    return preferred_description(t, ids.SYNONYM, refsets)


def fully_specified_name(t: Terminology, refsets: list[int], *, fallback: bool = True) -> DataFrame:
    """concept_id, description_id and term: the preferred one; with `fallback`, for a concept without, its first active one, else its first."""
    found = preferred_description(t, ids.FSN, refsets)
    if not fallback:
        return found
    rest = t.description.where(F.col("type_id") == ids.FSN).join(large(found.select("concept_id")), "concept_id", "left_anti")
    other = rest.groupBy("concept_id").agg(F.min(F.struct((~F.col("active")).alias("off"), "id", "term")).alias("x")).select("concept_id", F.col("x.id").alias("description_id"), F.col("x.term").alias("term"))
    return found.unionByName(other)


def release_information(t: Terminology) -> DataFrame:
    """Active descriptions of the root, the core module's latest first, then by time."""
    rows = t.description.where(F.col("active") & (F.col("concept_id") == ids.ROOT))
    latest = Window.partitionBy("module_id").orderBy(F.desc("effective_time"), "id")
    first = (F.col("module_id") == ids.CORE_MODULE) & (F.row_number().over(latest) == 1)
    return rows.withColumn("first", first).orderBy(F.desc("first"), "effective_time", "id").drop("first")


def extended_concept(t: Terminology, refsets: list[int]) -> DataFrame:
    """Concepts with their descriptions (and where these are preferred or acceptable), relationships direct and expanded, literals and reference sets."""
    from .graph import expanded_sets

    pick = lambda which: F.sort_array(F.collect_set(F.when(F.col("acceptability_id") == which, F.col("refset_id"))))
    places = t.member.groupBy(F.col("referenced_component_id").alias("id")).agg(F.sort_array(F.collect_set("refset_id")).alias("refsets"), pick(ids.PREFERRED).alias("preferred_in"), pick(ids.ACCEPTABLE).alias("acceptable_in"))
    d = t.description.join(large(places), "id", "left").groupBy("concept_id").agg(F.sort_array(F.collect_list(F.struct("id", "active", "type_id", "term", "language_code", "refsets", "preferred_in", "acceptable_in"))).alias("descriptions"))
    up = expanded_sets(t).withColumn("targets", F.sort_array("targets")).groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("type_id", "targets"))).alias("parents"))
    direct = t.edge.groupBy("source_id", "type_id").agg(F.sort_array(F.collect_set("destination_id")).alias("targets")).groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("type_id", "targets"))).alias("direct_parents"))
    literals = t.literal.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("relationship_group", "type_id", "value"))).alias("concrete_values"))
    own = places.select("id", "refsets")
    out = t.concept
    for rows, key in ((d, "concept_id"), (up, "source_id"), (direct, "source_id"), (literals, "source_id")):
        out = out.join(large(rows.withColumnRenamed(key, "id")), "id", "left")
    return out.join(large(own), "id", "left").join(large(preferred_synonym(t, refsets).select(F.col("concept_id").alias("id"), F.col("term").alias("preferred_synonym"))), "id", "left")


def extended_items(t: Terminology, items: DataFrame) -> DataFrame:
    """Reference set members with their fields by heading; a reference set without headings raises."""
    named = items.join(t.headings, "refset_id", "left")
    names = F.when(F.col("headings").isNull(), F.raise_error(F.lit("a reference set has no headings"))).otherwise(F.slice("headings", 7, 1000))
    return named.withColumn("named", F.map_from_arrays(names, "fields"))


def refset_descriptors(t: Terminology) -> DataFrame:
    """refset_id and its attributes' ids in order."""
    rows = t.member.where("attribute_order IS NOT NULL").groupBy(F.col("referenced_component_id").alias("refset_id"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("attribute_order", "attribute_description_id"))).getField("attribute_description_id").alias("attributes"))


def refset_counts(t: Terminology) -> DataFrame:
    return t.refset_member.groupBy("component").agg(F.count("*").alias("n"))


def status(t: Terminology) -> DataFrame:
    """Rows of every table, base and derived."""
    tables = {"concepts": t.concept, "descriptions": t.description, "relationships": t.relationship, "concrete_values": t.concrete_value, "refset_items": t.refset_member, "refsets": t.installed, "edges": t.edge, "closure": t.tc}
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def module_dependencies(t: Terminology) -> DataFrame:
    """Each active dependency item with the installed version of the module it needs, and whether that is new enough."""
    rows = t.member.where("target_effective_time IS NOT NULL").select("module_id", "source_effective_time", F.col("referenced_component_id").alias("needs"), "target_effective_time")
    versions = rows.groupBy("module_id").agg(F.max("source_effective_time").alias("version"))
    # the model module has no item of its own: it comes with the core
    model = versions.where(F.col("module_id") == ids.CORE_MODULE).select(F.lit(ids.MODEL_MODULE).cast("bigint").alias("module_id"), "version")
    versions = versions.unionByName(model.join(versions.select("module_id"), "module_id", "left_anti"))
    found = rows.join(versions.toDF("needs", "version"), "needs", "left")
    return found.withColumn("valid", F.coalesce(F.col("version") >= F.col("target_effective_time"), F.lit(False)))


def module_versions(t: Terminology, refsets: list[int]) -> DataFrame:
    """module_id, name and version of each module that has dependency items."""
    rows = t.member.where("target_effective_time IS NOT NULL").groupBy("module_id").agg(F.max("source_effective_time").alias("version"))
    names = fully_specified_name(t, refsets).select(F.col("concept_id").alias("module_id"), F.col("term").alias("name"))
    return rows.join(names, "module_id", "left").select("module_id", "name", "version")


def module_dependency_problems(t: Terminology, refsets: list[int]) -> DataFrame:
    """Each dependency item that the installed modules do not meet, with both modules' names, the version needed and that installed."""
    names = fully_specified_name(t, refsets).select(F.col("concept_id").alias("k"), "term")
    rows = module_dependencies(t).where("NOT valid")
    out = rows.join(names.toDF("module_id", "name"), "module_id", "left").join(names.toDF("needs", "needs_name"), "needs", "left")
    return out.select("module_id", "name", "source_effective_time", "needs", "needs_name", "target_effective_time", F.col("version").alias("installed"))
