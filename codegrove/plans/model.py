"""The terminology as tables, and the tables derived from them.

Base tables: concept, description, relationship, concrete_value, refset_member. Derived: edge (distinct active
relationships), tc (the hierarchy's closure without self pairs), member (active reference set members), association,
substrate (one row per description with its concept's flags).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ids
from .storage import few, large, members_of, stored

CONCEPT = "id bigint, effective_time date, active boolean, module_id bigint, definition_status_id bigint"
DESCRIPTION = "id bigint, effective_time date, active boolean, module_id bigint, concept_id bigint, language_code string, type_id bigint, term string, case_significance_id bigint"
RELATIONSHIP = "id bigint, effective_time date, active boolean, module_id bigint, source_id bigint, destination_id bigint, relationship_group int, type_id bigint, characteristic_type_id bigint, modifier_id bigint"
CONCRETE = RELATIONSHIP.replace("destination_id bigint", "value string")
MEMBER = (
    "id string, effective_time date, active boolean, module_id bigint, refset_id bigint, referenced_component_id bigint, component string, fields array<string>,"
    " target_component_id bigint, acceptability_id bigint, map_target string, map_group bigint, map_priority bigint, map_rule string, map_advice string, correlation_id bigint, map_category_id bigint,"
    " value_id bigint, attribute_description_id bigint, attribute_type_id bigint, attribute_order int, source_effective_time date, target_effective_time date, owl_expression string,"
    " domain_id bigint, grouped boolean, attribute_cardinality string, attribute_in_group_cardinality string, rule_strength_id bigint, content_type_id bigint, range_constraint string, attribute_rule string,"
    " domain_constraint string, parent_domain string, proximal_primitive_constraint string, proximal_primitive_refinement string, domain_template_for_precoordination string,"
    " domain_template_for_postcoordination string, guide_url string, mrcm_rule_refset_id bigint"
)


#: Edges of which one task finds the closure's pairs without duplicates.
PART_ROWS = 200_000


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema: missing ones null."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (descendant, ancestor) of edges (descendant, ancestor), without self pairs.

    What has nothing below it, most of a terminology, takes part in no path but its own: its pairs are its edges and what their
    ends reach, found in one join at the end. For the others paths double each round, so that a hierarchy of depth d takes log2(d) rounds. A pair that is more than 2^k and at most
    2^(k+1) edges apart has a first part of 2^k, found in the round before, so that only the last round's pairs are joined
    with the known ones. A round's new pairs end up as a table, so that plans stay short and lost executors cost one round.
    Cycles end as no pair is new.
    """
    edges = stored(edges.where("descendant IS NOT NULL AND ancestor IS NOT NULL AND descendant <> ancestor").distinct(), "edges")
    inner = members_of(stored(edges.select(F.col("ancestor").alias("descendant")).distinct(), "inner"))
    new = stored(edges.join(inner, "descendant", "left_semi").select("descendant", "ancestor"), "closure")
    known = new
    while not new.isEmpty():
        longer = new.toDF("descendant", "middle").join(large(known.toDF("middle", "ancestor")), "middle").where("descendant <> ancestor").select("descendant", "ancestor").distinct()
        new = stored(longer.join(large(known), ["descendant", "ancestor"], "left_anti"), "closure")
        known = known.unionByName(new)
    known = stored(known, "closure")
    outer = edges.join(inner, "descendant", "left_anti").select("descendant", "ancestor")
    above = outer.toDF("descendant", "middle").join(large(known.toDF("middle", "ancestor")), "middle").select("descendant", "ancestor")
    # as many parts as the edges need: parts merged by their compressed size would hold millions of pairs in a task
    parts = edges.count() // PART_ROWS + 1
    return stored(known.unionByName(outer.unionByName(above).repartition(parts, "descendant").distinct()), "closure")


@dataclass
class Terminology:
    """Base tables, and derived ones built when first used. check_ids: whether expressions' identifiers need a right check digit."""

    spark: SparkSession
    concept: DataFrame
    description: DataFrame
    relationship: DataFrame
    concrete_value: DataFrame
    refset_member: DataFrame
    check_ids: bool = True
    headings: DataFrame | None = field(default=None)

    @cached_property
    def edge(self) -> DataFrame:
        """Distinct active relationships; one active row keeps an edge."""
        rows = self.relationship.where("active").select("source_id", "type_id", "relationship_group", "destination_id").distinct()
        return stored(rows, "edge")

    @cached_property
    def isa(self) -> DataFrame:
        return stored(self.edge.where(F.col("type_id") == ids.IS_A).select(F.col("source_id").alias("child"), F.col("destination_id").alias("parent")).distinct(), "isa")

    @cached_property
    def tc(self) -> DataFrame:
        return closure(self.isa.toDF("descendant", "ancestor"))

    @cached_property
    def tc_self(self) -> DataFrame:
        """The closure with self pairs of every concept that has a row or an edge."""
        own = self.concept.select("id").union(self.isa.select("child")).union(self.isa.select("parent")).distinct()
        return self.tc.unionByName(own.select(F.col("id").alias("descendant"), F.col("id").alias("ancestor")))

    @cached_property
    def literal(self) -> DataFrame:
        """Active concrete values with their typed columns."""
        number = F.expr("CASE WHEN value LIKE '#%' THEN try_cast(substring(value, 2) AS double) END")
        return self.concrete_value.where("active").select("source_id", "type_id", "relationship_group", "value", number.alias("number"))

    @cached_property
    def member(self) -> DataFrame:
        return self.refset_member.where("active")

    @cached_property
    def association(self) -> DataFrame:
        return self.member.where("target_component_id IS NOT NULL").select("refset_id", F.col("referenced_component_id").alias("source_id"), F.col("target_component_id").alias("target_id"), "effective_time", "id")

    @cached_property
    def substrate(self) -> DataFrame:
        """One row per description, with its folded tokens. A concept without description has none, and no expression or search finds it."""
        from ..operators.text import with_tokens

        c = self.concept.select(F.col("id").alias("concept_id"), F.col("active").alias("concept_active"), "module_id")
        d = self.description.select(F.col("id").alias("description_id"), "concept_id", "term", "type_id", "language_code", F.col("active").alias("description_active"))
        return stored(with_tokens(d.join(large(c), "concept_id")), "substrate")

    @cached_property
    def installed(self) -> DataFrame:
        """Reference sets with any member, active or not."""
        return self.refset_member.select("refset_id").distinct()

    def attributes(self, root: int) -> frozenset[int]:
        """The concepts below a root of attributes: part of the concept model, a few hundred whatever the number of concepts. Read once."""
        known = self.__dict__.setdefault("_attributes", {})
        if root not in known:
            known[root] = frozenset(r["descendant"] for r in self.tc.where(F.col("ancestor") == root).select("descendant").collect())
        return known[root]

    def ids(self, *values: int) -> DataFrame:
        """Given ids as a table of known size that is broadcast: rows that many share, as of a type, are not dealt by it."""
        if not values:
            return self.spark.range(0)
        return F.broadcast(self.spark.sql(f"SELECT id FROM VALUES {', '.join(f'(CAST({int(v)} AS bigint))' for v in values)} AS v(id)"))


#: The driver's tables as a terminology, in SQL that Spark and DuckDB read alike.
PROJECTION = {
    "brand": "SELECT p_brand AS name, CAST(7000000000 + row_number() OVER (ORDER BY p_brand) AS bigint) AS id FROM (SELECT DISTINCT p_brand FROM part) b",
    "ptype": "SELECT p_type AS name, CAST(8000000000 + row_number() OVER (ORDER BY p_type) AS bigint) AS id FROM (SELECT DISTINCT p_type FROM part) b",
    "segment": "SELECT c_mktsegment AS name, CAST(9000000000 + row_number() OVER (ORDER BY c_mktsegment) AS bigint) AS id FROM (SELECT DISTINCT c_mktsegment FROM customer) b",
    "priority": "SELECT o_orderpriority AS name, CAST(10000000000 + row_number() OVER (ORDER BY o_orderpriority) AS bigint) AS id FROM (SELECT DISTINCT o_orderpriority FROM orders) b",
    "meta": f"""SELECT CAST({ids.CONCEPT_ATTRIBUTE} AS bigint) AS id, 'Concept model attribute' AS name, CAST({ids.ROOT} AS bigint) AS parent
 UNION ALL SELECT CAST({ids.CONCRETE_ATTRIBUTE} AS bigint), 'Concept model data attribute', CAST({ids.ROOT} AS bigint)
 UNION ALL SELECT CAST({ids.IS_A} AS bigint), 'Is a', CAST({ids.ROOT} AS bigint)
 UNION ALL SELECT CAST(11000000001 AS bigint), 'Has part', CAST({ids.CONCEPT_ATTRIBUTE} AS bigint)
 UNION ALL SELECT CAST(11000000002 AS bigint), 'Has supplier', CAST({ids.CONCEPT_ATTRIBUTE} AS bigint)
 UNION ALL SELECT CAST(11000000003 AS bigint), 'Has quantity', CAST({ids.CONCRETE_ATTRIBUTE} AS bigint)
 UNION ALL SELECT CAST({ids.ASSOCIATIONS} AS bigint), 'Historical association', CAST({ids.ROOT} AS bigint)
 UNION ALL SELECT CAST({ids.SAME_AS} AS bigint), 'Same as', CAST({ids.ASSOCIATIONS} AS bigint)
 UNION ALL SELECT CAST({ids.REPLACED_BY} AS bigint), 'Replaced by', CAST({ids.ASSOCIATIONS} AS bigint)
 UNION ALL SELECT CAST({ids.MOVED_TO} AS bigint), 'Moved to', CAST({ids.ASSOCIATIONS} AS bigint)""",
    "concept_names": f"""SELECT CAST({ids.ROOT} AS bigint) AS id, 'Root' AS name, 'root' AS kind, true AS active, false AS defined
 UNION ALL SELECT CAST(1000000000 + r_regionkey AS bigint), r_name, 'region', true, false FROM region
 UNION ALL SELECT CAST(2000000000 + n_nationkey AS bigint), n_name, 'nation', true, false FROM nation
 UNION ALL SELECT 3000000000 + c_custkey, c_name, 'customer', NOT (c_acctbal < 0 AND c_custkey > 0), false FROM customer
 UNION ALL SELECT 4000000000 + s_suppkey, s_name, 'supplier', true, false FROM supplier
 UNION ALL SELECT 5000000000 + p_partkey, p_name, 'part', true, p_partkey % 2 = 0 FROM part
 UNION ALL SELECT 6000000000 + o_orderkey, concat('Order ', CAST(o_orderkey AS varchar(20))), 'order', o_orderstatus <> 'P', false FROM orders
 UNION ALL SELECT id, name, 'brand', true, false FROM brand UNION ALL SELECT id, name, 'type', true, false FROM ptype
 UNION ALL SELECT id, name, 'segment', true, false FROM segment UNION ALL SELECT id, name, 'priority', true, false FROM priority
 UNION ALL SELECT id, name, 'metadata', true, false FROM meta""",
    "isa_edge": f"""SELECT CAST(1000000000 + r_regionkey AS bigint) AS child, CAST({ids.ROOT} AS bigint) AS parent FROM region
 UNION ALL SELECT CAST(2000000000 + n_nationkey AS bigint), CAST(1000000000 + n_regionkey AS bigint) FROM nation
 UNION ALL SELECT 3000000000 + c_custkey, CAST(2000000000 + c_nationkey AS bigint) FROM customer
 UNION ALL SELECT 3000000000 + c_custkey, id FROM customer JOIN segment ON name = c_mktsegment
 UNION ALL SELECT 4000000000 + s_suppkey, CAST(2000000000 + s_nationkey AS bigint) FROM supplier
 UNION ALL SELECT 5000000000 + p_partkey, id FROM part JOIN brand ON name = p_brand
 UNION ALL SELECT 5000000000 + p_partkey, id FROM part JOIN ptype ON name = p_type
 UNION ALL SELECT 6000000000 + o_orderkey, 3000000000 + o_custkey FROM orders
 UNION ALL SELECT 6000000000 + o_orderkey, id FROM orders JOIN priority ON name = o_orderpriority
 UNION ALL SELECT id, CAST({ids.ROOT} AS bigint) FROM brand UNION ALL SELECT id, CAST({ids.ROOT} AS bigint) FROM ptype
 UNION ALL SELECT id, CAST({ids.ROOT} AS bigint) FROM segment UNION ALL SELECT id, CAST({ids.ROOT} AS bigint) FROM priority
 UNION ALL SELECT id, parent FROM meta""",
    "rel": f"""SELECT child AS source_id, CAST({ids.IS_A} AS bigint) AS type_id, 0 AS relationship_group, parent AS destination_id FROM isa_edge
 UNION ALL SELECT 6000000000 + l_orderkey, CAST(11000000001 AS bigint), l_linenumber, 5000000000 + l_partkey FROM lineitem
 UNION ALL SELECT 6000000000 + l_orderkey, CAST(11000000002 AS bigint), l_linenumber, 4000000000 + l_suppkey FROM lineitem""",
    "lit": """SELECT 6000000000 + l_orderkey AS source_id, CAST(11000000003 AS bigint) AS type_id, l_linenumber AS relationship_group,
 concat('#', CAST(CAST(l_quantity AS int) AS varchar(20))) AS value, l_quantity AS number FROM lineitem""",
    "descr": f"""SELECT id * 10 + 1 AS id, id AS concept_id, CAST({ids.SYNONYM} AS bigint) AS type_id, name AS term, true AS active, 'en' AS language_code FROM concept_names
 UNION ALL SELECT id * 10 + 2, id, CAST({ids.FSN} AS bigint), concat(name, ' (', kind, ')'), true, 'en' FROM concept_names
 UNION ALL SELECT id * 10 + 3, id, CAST({ids.SYNONYM} AS bigint), concat('Code ', CAST(id AS varchar(20))), id % 3 <> 0, 'en' FROM concept_names WHERE kind IN ('part', 'supplier')""",
    "members": f"""SELECT concat('seg-', CAST(c_custkey AS varchar(20))) AS id, segment.id AS refset_id, 3000000000 + c_custkey AS component_id, CAST(NULL AS bigint) AS target_id, CAST(NULL AS bigint) AS acceptability_id, CAST(NULL AS varchar(50)) AS map_target, CAST(NULL AS bigint) AS map_priority, c_custkey % 10 <> 0 AS active FROM customer JOIN segment ON name = c_mktsegment
 UNION ALL SELECT concat('map-', CAST(p_partkey AS varchar(20))), CAST(12000000001 AS bigint), 5000000000 + p_partkey, CAST(NULL AS bigint), CAST(NULL AS bigint), p_brand, CAST(p_size AS bigint), p_partkey % 7 <> 0 FROM part
 UNION ALL SELECT concat('his-', CAST(c_custkey AS varchar(20))), CASE c_custkey % 3 WHEN 0 THEN CAST({ids.SAME_AS} AS bigint) WHEN 1 THEN CAST({ids.REPLACED_BY} AS bigint) ELSE CAST({ids.MOVED_TO} AS bigint) END, 3000000000 + c_custkey, 3000000000 + c_custkey - 1, CAST(NULL AS bigint), CAST(NULL AS varchar(50)), CAST(NULL AS bigint), true FROM customer WHERE c_acctbal < 0 AND c_custkey > 0
 UNION ALL SELECT concat('lan-', CAST(id AS varchar(20))), CAST({ids.EN_US} AS bigint), id * 10 + CASE WHEN kind IN ('part', 'supplier') AND id % 5 = 0 THEN 3 ELSE 1 END, CAST(NULL AS bigint), CAST({ids.PREFERRED} AS bigint), CAST(NULL AS varchar(50)), CAST(NULL AS bigint), true FROM concept_names
 UNION ALL SELECT concat('lag-', CAST(id AS varchar(20))), CAST({ids.EN_GB} AS bigint), id * 10 + 1, CAST(NULL AS bigint), CASE WHEN id % 4 = 0 THEN CAST({ids.ACCEPTABLE} AS bigint) ELSE CAST({ids.PREFERRED} AS bigint) END, CAST(NULL AS varchar(50)), CAST(NULL AS bigint), true FROM concept_names WHERE kind IN ('part', 'supplier')
 UNION ALL SELECT concat('fsn-', CAST(id AS varchar(20))), CAST({ids.EN_US} AS bigint), id * 10 + 2, CAST(NULL AS bigint), CAST({ids.PREFERRED} AS bigint), CAST(NULL AS varchar(50)), CAST(NULL AS bigint), true FROM concept_names""",
}
#: Names in the driver's tables, each on many rows: joined by broadcast if few, so that rows are not dealt by a name.
NAMES = ("brand", "ptype", "segment", "priority")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_made: dict[tuple[str, str], Terminology] = {}


def from_tables(spark: SparkSession, sf_dir: str) -> Terminology:
    """The driver's tables as a terminology. Kept for the application, as an index is; derived tables are in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _made:
        return _made[key]
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for name, sql in PROJECTION.items():
        text = "".join(f" {sql} ")
        views[name] = spark.sql(_named(text, views), **{f"v_{k}": v for k, v in views.items() if _uses(text, k)})
        if name in NAMES:
            views[name] = few(stored(views[name], name))
    concept = views["concept_names"].selectExpr("id", "active", f"{ids.CORE_MODULE} AS module_id", f"CASE WHEN defined THEN {ids.DEFINED} ELSE {ids.PRIMITIVE} END AS definition_status_id")
    member = views["members"].selectExpr("id", "active", "refset_id", "component_id AS referenced_component_id", "target_id AS target_component_id", "acceptability_id", "map_target", "map_priority", "CASE substr(id, 1, 3) WHEN 'seg' THEN 'Simple' WHEN 'map' THEN 'SimpleMap' WHEN 'his' THEN 'Association' ELSE 'Language' END AS component")
    # written once, as an import does, so that no query works the projection out again
    out = Terminology(
        spark,
        _table(concept, "concept", CONCEPT),
        _table(views["descr"], "description", DESCRIPTION),
        _table(views["rel"].withColumn("active", F.lit(True)), "relationship", RELATIONSHIP),
        _table(views["lit"].drop("number").withColumn("active", F.lit(True)), "concrete", CONCRETE),
        _table(member, "member", MEMBER),
        check_ids=False,
    )
    _made[key] = out
    return out


def _table(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """rows stored with the columns they have; those they lack are added when read, as null columns would take a part of the table's size in estimates."""
    typed = conform(rows, schema)
    return conform(stored(typed.select(*[c for c in typed.columns if c in rows.columns]), name), schema)


def _uses(sql: str, name: str) -> bool:
    import re

    return bool(re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql))


def _named(sql: str, views: dict) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{v_{m[2]}}} {m[2]}" if m[2] in views else m[0], sql)


def projection_sql() -> str:
    """The projection as common table expressions for DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in PROJECTION.items())
