"""Term search: folding, tokens, prefix and fuzzy matching, ranking, duplicates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..plans import ids
from ..plans.model import Terminology
from ..plans.storage import large, members_of, stored

#: Characters that a language keeps when folding.
KEPT = {"da": "æøåÆØÅ", "no": "æøåÆØÅ", "nb": "æøåÆØÅ", "nn": "æøåÆØÅ", "sv": "åäöÅÄÖ", "fi": "åäöÅÄÖ"}


def fold(text: str, language: str | None = None) -> str:
    """Text without marks on its letters, but for those that are letters of their own in the language. Case stays."""
    kept = KEPT.get((language or "")[:2], "")
    out = []
    for c in unicodedata.normalize("NFKC", text) if kept else text:
        out.append(c if c in kept else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M")))
    return "".join(out)


@F.pandas_udf(StringType())
def fold_column(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else fold(a, b) for a, b in zip(text, language, strict=True)])


_TOKEN = re.compile(r"\w+(?:['’.]\w+)*")


def tokens(text: str, language: str | None = None) -> list[str]:
    """Words in lower case after folding. An approximation of Unicode's word breaks."""
    return _TOKEN.findall(fold(text, language).lower())


def token_column(folded: Column) -> Column:
    return F.regexp_extract_all(F.lower(folded), F.lit(r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"), 0)


def with_tokens(rows: DataFrame) -> DataFrame:
    """rows (term, language_code; others stay) with the folded term and its tokens. Terms in plain ASCII need no Python."""
    plain = F.col("term").rlike(r"^[\x00-\x7F]*$")
    ascii_rows = rows.where(plain).withColumn("folded", F.col("term"))
    other = rows.where(~plain | plain.isNull()).withColumn("folded", fold_column("term", "language_code"))
    return ascii_rows.unionByName(other).withColumn("tokens", token_column(F.col("folded")))


def searchable(t: Terminology) -> DataFrame:
    """The substrate, whose tokens are stored with it."""
    return t.substrate


def matches(query: str, *, fuzzy: int = 0, language: str | None = None) -> Column | None:
    """All of the query's tokens begin one of the term's, or are within `fuzzy` (2 at most) edits of one. None for a query without tokens."""
    def one(q: str) -> Column:
        near = lambda w: w.startswith(q) | ((F.levenshtein(w, F.lit(q), min(fuzzy, 2)) >= 0) if fuzzy else (w == q))
        return F.exists("tokens", near)

    found = [one(q) for q in tokens(query, language)]
    out = None
    for x in found:
        out = x if out is None else out & x
    return out


def _filtered(t: Terminology, *, inactive_concepts: bool, inactive_descriptions: bool, fsn: bool, concept_refsets: list[int] | None, constraint: DataFrame | None, properties: dict[int, int] | None) -> DataFrame:
    rows = searchable(t)
    if not inactive_concepts:
        rows = rows.where("concept_active")
    if not inactive_descriptions:
        rows = rows.where("description_active")
    if not fsn:
        rows = rows.where(F.col("type_id") != ids.FSN)
    if concept_refsets:
        rows = rows.join(members_of(t.member.where(F.col("refset_id").isin(concept_refsets)).select(F.col("referenced_component_id").alias("concept_id"))), "concept_id", "left_semi")
    if constraint is not None:
        rows = rows.join(members_of(constraint.select(F.col("id").alias("concept_id"))), "concept_id", "left_semi")
    for type_id, value in (properties or {}).items():
        from .graph import expanded

        found = expanded(t).where((F.col("type_id") == type_id) & (F.col("target") == value)).select(F.col("source_id").alias("concept_id"))
        rows = rows.join(members_of(found), "concept_id", "left_semi")
    return rows


def search(t: Terminology, query: str | None = None, *, max_hits: int | None = None, fuzzy: int = 0, fallback_fuzzy: int = 0, inactive_concepts: bool = False, inactive_descriptions: bool = True, fsn: bool = False, concept_refsets: list[int] | None = None, constraint: DataFrame | None = None, properties: dict[int, int] | None = None, refsets: list[int] | None = None, remove_duplicates: bool = False, language: str | None = None) -> DataFrame:
    """description_id, concept_id, term and preferred_term of descriptions that match; shorter terms first, ties by id, if max_hits is given."""
    rows = _filtered(t, inactive_concepts=inactive_concepts, inactive_descriptions=inactive_descriptions, fsn=fsn, concept_refsets=concept_refsets, constraint=constraint, properties=properties)

    def found(k: int) -> DataFrame:
        m = matches(query or "", fuzzy=k, language=language)
        return rows if m is None else rows.where(m)

    out = found(fuzzy)
    if not fuzzy and fallback_fuzzy and out.isEmpty():
        out = found(fallback_fuzzy)
    order = [F.length("term"), F.col("description_id")]
    if max_hits is not None:
        out = out.orderBy(*order).limit(max_hits)
    if remove_duplicates:
        out = consecutive_distinct(out, order)
    from .lookups import preferred_synonym

    names = preferred_synonym(t, refsets or [ids.EN_US]).select("concept_id", F.col("term").alias("preferred_term"))
    return out.select("description_id", "concept_id", "term").join(large(names), "concept_id", "left")


def consecutive_distinct(rows: DataFrame, order: list) -> DataFrame:
    """Rows without those that have the same concept and term as the row before them in an ascending order.

    Rows are dealt by ranges of the order and compared inside these; the first of a range is compared with the last of the
    range before, of which there is one for each range.
    """
    keys = [(F.col(k) if isinstance(k, str) else k).alias(f"__k{i}") for i, k in enumerate(order)]
    names = [f"__k{i}" for i in range(len(keys))]
    dealt = rows.select(*rows.columns, *keys).repartitionByRange(*names).sortWithinPartitions(*names)
    dealt = stored(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    same = lambda a, b: F.coalesce((a == F.col("concept_id")) & (b == F.col("term")), F.lit(False))
    w = Window.partitionBy("__range").orderBy(*names)
    marked = dealt.withColumns({"__first": F.row_number().over(w) == 1, "__same": same(F.lag("concept_id").over(w), F.lag("term").over(w))})
    # one row a range
    ends = dealt.groupBy("__range").agg(F.max_by(F.struct("concept_id", "term"), F.struct(*names)).alias("x"))
    before = ends.select((F.lead("__range").over(Window.orderBy("__range"))).alias("__range"), F.col("x.concept_id").alias("__c"), F.col("x.term").alias("__t")).where("__range IS NOT NULL")
    both = marked.join(F.broadcast(before), "__range", "left")
    return both.where(~F.when(F.col("__first"), same(F.col("__c"), F.col("__t"))).otherwise(F.col("__same"))).select(*rows.columns)


def search_concept_ids(t: Terminology, concepts: DataFrame, refsets: list[int], *, fallback: list[int] | None = None) -> DataFrame:
    """id, description_id, term and preferred_term of each concept's preferred synonym in the first language reference set that has
    one, else in the fallback's; null where there is none. A concept given twice has two rows."""
    from .lookups import preferred_synonym

    order = dict.fromkeys([*refsets, *(fallback if fallback is not None else [ids.EN_US])])
    names = preferred_synonym(t, list(order))
    out = concepts.select("id").join(large(names.withColumnRenamed("concept_id", "id")), "id", "left")
    return out.select("id", "description_id", "term", F.col("term").alias("preferred_term"))


def ranked_search(t: Terminology, query: str, *, max_hits: int = 500, constraint: DataFrame | None = None, **options) -> DataFrame:
    """Descriptions with any of the query's tokens, those with more of them first, then shorter, then by id. A query without tokens matches nothing."""
    words = tokens(query)
    rows = _filtered(t, **({"inactive_concepts": False, "inactive_descriptions": True, "fsn": False, "concept_refsets": None, "constraint": constraint, "properties": None} | options))
    score = F.lit(0)
    begins = lambda q: F.exists("tokens", lambda w: w.startswith(q)).cast("int")
    for q in words:
        score = score + begins(q)
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.length("term"), "description_id").limit(max_hits).select("description_id", "concept_id", "term", "score")
