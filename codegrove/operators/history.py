"""Historical associations between inactive and active concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ids
from ..plans.model import Terminology
from ..plans.storage import present
from .graph import all_children

#: What the profiles take.
PROFILES = {"MIN": [ids.SAME_AS], "MOD": [ids.SAME_AS, ids.REPLACED_BY, ids.WAS_A, ids.PARTIALLY_EQUIVALENT]}


def profile(t: Terminology, name: str | None) -> DataFrame:
    """The association reference sets of a profile; MAX and None are all."""
    if name in PROFILES:
        return t.ids(*PROFILES[name])
    if name not in (None, "MAX"):
        raise ValueError(f"no history profile {name!r}")
    return all_children(t, t.ids(ids.ASSOCIATIONS))


def _associations(t: Terminology, refsets: DataFrame) -> DataFrame:
    return t.association.join(present(t.association, "refset_id", refsets), "refset_id", "left_semi")


def association_targets(t: Terminology, concepts: DataFrame, refset_id: int) -> DataFrame:
    return t.association.where(F.col("refset_id") == refset_id).join(concepts.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()


def historical_associations(t: Terminology) -> DataFrame:
    """source_id, refset_id and target_id of all active historical associations."""
    return _associations(t, profile(t, None)).select("source_id", "refset_id", "target_id")


def source_historical(t: Terminology, concepts: DataFrame, refsets: DataFrame | None = None) -> DataFrame:
    """Concepts that have an association to any of the given ones."""
    rows = _associations(t, profile(t, None) if refsets is None else refsets)
    return rows.join(concepts.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()


def source_associations(t: Terminology, concepts: DataFrame) -> DataFrame:
    """target_id, refset_id and the sources of the historical associations to the given concepts."""
    rows = historical_associations(t).join(concepts.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return rows.groupBy("target_id", "refset_id").agg(F.sort_array(F.collect_set("source_id")).alias("sources"))


def with_historical(t: Terminology, concepts: DataFrame, refsets: DataFrame | None = None) -> DataFrame:
    """The concepts, their associations' targets, and all that have associations to these. By default of all but the moved ones."""
    if refsets is None:
        refsets = profile(t, None).where(~F.col("id").isin(ids.MOVED_TO, ids.MOVED_FROM))
    rows = _associations(t, refsets)
    forward = rows.join(concepts.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    modern = concepts.select("id").union(forward).distinct()
    backward = rows.join(modern.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return modern.union(backward).distinct()


def association_counts(t: Terminology) -> DataFrame:
    """How many inactive concepts have how many associations."""
    inactive = t.concept.where("NOT active").select(F.col("id").alias("source_id"))
    counts = inactive.join(historical_associations(t), "source_id", "left").groupBy("source_id").agg(F.count("target_id").alias("associations"))
    return counts.groupBy("associations").agg(F.count("*").alias("concepts"))


def example_associations(t: Terminology, refset_id: int, n: int) -> DataFrame:
    """source_id, refset_id and target_id: all historical associations of the n inactive concepts with the lowest ids that have one of the given kind."""
    inactive = t.concept.where("NOT active").select(F.col("id").alias("source_id"))
    some = t.association.where(F.col("refset_id") == refset_id).join(inactive, "source_id", "left_semi").select("source_id").distinct().orderBy("source_id").limit(n)
    return historical_associations(t).join(some, "source_id", "left_semi")


def _targets(t: Terminology, refset_id: int) -> DataFrame:
    return t.association.where(F.col("refset_id") == refset_id).groupBy("source_id").agg(F.sort_array(F.collect_set("target_id")).alias("targets"))


def same_as(t: Terminology) -> DataFrame:
    """source_id and the concepts it is now thought to be the same as."""
    return _targets(t, ids.SAME_AS)


def possibly_equivalent(t: Terminology) -> DataFrame:
    """source_id and the concepts it may be equivalent to."""
    return _targets(t, ids.POSSIBLY_EQUIVALENT)


def moved_to(t: Terminology) -> DataFrame:
    """source_id and the namespace it moved to, by the first of its items."""
    rows = t.association.where(F.col("refset_id") == ids.MOVED_TO)
    return rows.groupBy("source_id").agg(F.min_by("target_id", "id").alias("target_id"))


def replaced_by(t: Terminology) -> DataFrame:
    """source_id and the target of its latest active replacement."""
    rows = t.association.where(F.col("refset_id") == ids.REPLACED_BY)
    return rows.groupBy("source_id").agg(F.max_by("target_id", F.struct("effective_time", "id")).alias("target_id"))


def replace_unambiguous(t: Terminology, concepts: DataFrame, name: str = "MIN") -> DataFrame:
    """id and now: an inactive concept's target if the profile gives exactly one and that is active, else the concept itself."""
    active = t.concept.where("active").select("id")
    rows = _associations(t, profile(t, name)).groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("target_id").alias("n"), F.min("target_id").alias("target")).where("n = 1")
    rows = rows.join(active.toDF("target"), "target", "left_semi").join(active, "id", "left_anti")
    return concepts.select("id").join(rows.select("id", "target"), "id", "left").select("id", F.coalesce("target", "id").alias("now"))
