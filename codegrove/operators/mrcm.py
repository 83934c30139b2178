"""Concept-model rules: which attributes a concept may have, and with which values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ecl, ids
from ..plans.model import Terminology

#: Fixed value: rules of this strength must hold.
MANDATORY = 723597001


def domains(t: Terminology) -> DataFrame:
    """domain_id and constraint of the active domain rules."""
    return t.member.where("domain_constraint IS NOT NULL").select(F.col("referenced_component_id").alias("domain_id"), F.col("domain_constraint").alias("constraint")).distinct()


def concept_domains(t: Terminology) -> DataFrame:
    """concept_id and domain_id: each domain's constraint is evaluated once, over all concepts. Rules are few."""
    out = t.spark.createDataFrame([], "concept_id bigint, domain_id bigint")
    for r in domains(t).collect():
        out = out.union(ecl.concepts(t, r["constraint"]).select(F.col("id").alias("concept_id"), F.lit(r["domain_id"]).cast("bigint")))
    return out.distinct()


def attribute_domains(t: Terminology) -> DataFrame:
    """The latest active domain rule of each attribute, domain and content type."""
    rows = t.member.where("domain_id IS NOT NULL AND attribute_cardinality IS NOT NULL")
    keys = ["referenced_component_id", "domain_id", "content_type_id"]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("grouped", "attribute_cardinality", "attribute_in_group_cardinality", "rule_strength_id"), F.struct("effective_time", "id")).alias("x"))
    return best.select(F.col("referenced_component_id").alias("attribute_id"), "domain_id", "content_type_id", "x.*")


def attribute_ranges(t: Terminology) -> DataFrame:
    """The latest active range rule of each attribute and content type."""
    rows = t.member.where("range_constraint IS NOT NULL")
    best = rows.groupBy("referenced_component_id", "content_type_id").agg(F.max_by(F.struct("range_constraint", "attribute_rule", "rule_strength_id"), F.struct("effective_time", "id")).alias("x"))
    return best.select(F.col("referenced_component_id").alias("attribute_id"), "content_type_id", "x.*")


#: Kinds of content that a rule is for, the most general last.
POSTCOORDINATED, PRECOORDINATED, NEW_PRECOORDINATED, ALL_CONTENT = 723595009, 723594008, 723593002, 723596005


def ranges_for(t: Terminology, content: int = POSTCOORDINATED) -> DataFrame:
    """One range rule an attribute: for the given kind of content, else for all content, else the newest of another kind."""
    rows = t.member.where("range_constraint IS NOT NULL")
    fit = F.when(F.col("content_type_id") == content, 2).when(F.col("content_type_id") == ALL_CONTENT, 1).otherwise(0)
    best = rows.groupBy(F.col("referenced_component_id").alias("attribute_id")).agg(F.max_by("range_constraint", F.struct(fit, "effective_time", "id")).alias("range_constraint"))
    return best.select("attribute_id", "range_constraint")


def allowed_attributes(t: Terminology, concepts: DataFrame, content: int = POSTCOORDINATED) -> DataFrame:
    """id, attribute_id, grouped and range_constraint of what the concepts may have."""
    per = concept_domains(t).join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    rules = attribute_domains(t).where(F.col("content_type_id").isNull() | F.col("content_type_id").isin(content, ALL_CONTENT)).select("domain_id", "attribute_id", "grouped")
    return per.join(rules, "domain_id").join(ranges_for(t, content), "attribute_id", "left").select(F.col("concept_id").alias("id"), "attribute_id", "grouped", "range_constraint").distinct()


def refinements(t: Terminology, concepts: DataFrame, refsets: list[int], content: int = POSTCOORDINATED) -> DataFrame:
    """allowed_attributes with the attributes' preferred synonyms."""
    from .lookups import preferred_synonym

    names = preferred_synonym(t, refsets).select(F.col("concept_id").alias("attribute_id"), F.col("term").alias("attribute_term"))
    return allowed_attributes(t, concepts, content).join(names, "attribute_id", "left").select("id", "attribute_id", "attribute_term", "grouped", "range_constraint")


def module_scope(t: Terminology) -> DataFrame:
    """module_id and the rule reference sets that hold for it."""
    return t.member.where("mrcm_rule_refset_id IS NOT NULL").select(F.col("referenced_component_id").alias("module_id"), F.col("mrcm_rule_refset_id").alias("refset_id")).distinct()


def in_range(t: Terminology, pairs: DataFrame) -> DataFrame:
    """pairs (attribute_id, value_id) with a column ok: whether the value is in the attribute's range; without a rule it is."""
    rules = attribute_ranges(t).collect()
    allowed = t.spark.createDataFrame([], "attribute_id bigint, value_id bigint")
    for r in rules:
        allowed = allowed.union(ecl.concepts(t, r["range_constraint"]).select(F.lit(r["attribute_id"]).cast("bigint"), "id"))
    ruled = t.spark.createDataFrame([(r["attribute_id"],) for r in rules], "attribute_id bigint").distinct().withColumn("_ruled", F.lit(True))
    hit = pairs.join(allowed.distinct().withColumn("_hit", F.lit(True)), ["attribute_id", "value_id"], "left").join(ruled, "attribute_id", "left")
    return hit.select(*pairs.columns, (F.coalesce("_hit", F.lit(False)) | F.col("_ruled").isNull()).alias("ok"))


def property_errors(t: Terminology) -> DataFrame:
    """source_id, type_id, destination_id and what is wrong with each active relationship that is no hierarchy: attribute, domain or range."""
    edges = t.edge.where(F.col("type_id") != ids.IS_A)
    names = t.tc.where(F.col("ancestor") == ids.CONCEPT_ATTRIBUTE).select(F.col("descendant").alias("type_id"))
    wrong_name = edges.join(names, "type_id", "left_anti").withColumn("error", F.lit("attribute"))
    per = concept_domains(t).join(attribute_domains(t), "domain_id").select(F.col("concept_id").alias("source_id"), F.col("attribute_id").alias("type_id")).distinct()
    wrong_domain = edges.join(names, "type_id", "left_semi").join(per, ["source_id", "type_id"], "left_anti").withColumn("error", F.lit("domain"))
    checked = in_range(t, edges.select(F.col("type_id").alias("attribute_id"), F.col("destination_id").alias("value_id")).distinct()).where("NOT ok").toDF("type_id", "destination_id", "ok")
    wrong_range = edges.join(checked.drop("ok"), ["type_id", "destination_id"], "left_semi").withColumn("error", F.lit("range"))
    columns = ["source_id", "relationship_group", "type_id", "destination_id", "error"]
    return wrong_name.select(columns).union(wrong_domain.select(columns)).union(wrong_range.select(columns))
