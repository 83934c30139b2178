"""Queries over the driver's tables as a terminology, each with its twin in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identifiers
from .operators import graph, history, lookups, members, text
from .plans import ecl, ids
from .plans.model import Terminology, from_tables, projection_sql
from .sources.versions import newest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PART, SUPPLIER, QUANTITY, MAP = 11000000001, 11000000002, 11000000003, 12000000001
ISA = ids.IS_A


def _of(t: Terminology) -> DataFrame:
    return t.concept.select("id")


#: What the twins build on, besides the projection.
_VIEWS = f"""
edge AS MATERIALIZED (SELECT DISTINCT source_id, type_id, relationship_group, destination_id FROM rel),
isa AS MATERIALIZED (SELECT DISTINCT child, parent FROM isa_edge),
tc AS MATERIALIZED (SELECT child AS descendant, parent AS ancestor FROM isa UNION SELECT tc.descendant, isa.parent FROM tc JOIN isa ON isa.child = tc.ancestor),
tcs AS MATERIALIZED (SELECT descendant, ancestor FROM tc UNION SELECT id, id FROM concept_names),
sub AS MATERIALIZED (SELECT descr.id AS description_id, concept_id, term, type_id, descr.active AS description_active, concept_names.active AS concept_active FROM descr JOIN concept_names ON concept_names.id = descr.concept_id),
m AS MATERIALIZED (SELECT * FROM members WHERE active)
"""


def _sql(select: str, *views: str) -> str:
    return f"{projection_sql()}, {_VIEWS}{''.join(f', {v}' for v in views)} {select}"


def query(name: str, sql: str, *views: str):
    def add(f: Callable[[Terminology], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(from_tables(spark, sf_dir))
        ORACLE_SQL[name] = _sql(sql, *views)
        return f

    return add


def constraint(name: str, source: str, sql: str, *views: str):
    """A query for the concepts of an expression constraint."""
    query(name, sql, *views)(lambda t: ecl.concepts(t, source))


def _joined(c: str) -> Column:
    return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))


def _below(t: Terminology, root: int) -> DataFrame:
    return graph.all_children(t, t.ids(root))


NATION, REGION = 2000000003, 1000000001
UNDER = f"SELECT descendant AS id FROM tcs WHERE ancestor = {NATION}"

# graph

query("edges_distinct", "SELECT * FROM edge")(lambda t: t.edge)
query("closure_isa", "SELECT descendant, ancestor FROM tc")(lambda t: t.tc)
query("closure_counts", "SELECT ancestor, count(*) AS n FROM tc GROUP BY ancestor")(lambda t: t.tc.groupBy("ancestor").agg(F.count("*").alias("n")))
query("ancestors_of", "SELECT DISTINCT ancestor AS id FROM tcs")(lambda t: graph.all_parents(t, _of(t)))
query("descendants_of", UNDER)(lambda t: _below(t, NATION))
query("children_of", f"SELECT child AS id FROM isa WHERE parent = {REGION}")(lambda t: graph.children(t, t.ids(REGION)))
query("parents_of", "SELECT DISTINCT parent AS id FROM isa JOIN orders ON child = 6000000000 + o_orderkey WHERE o_orderstatus = 'P'")(
    lambda t: graph.parents(t, t.concept.where("NOT active AND id > 6000000000 AND id < 7000000000").select("id"))
)
query(
    "paths_to_root_count",
    "SELECT id, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM isa WHERE child = last) GROUP BY id",
    "p AS (SELECT id, id AS last FROM concept_names UNION ALL SELECT p.id, isa.parent FROM p JOIN isa ON isa.child = p.last)",
)(lambda t: graph.paths_to_root(t, _of(t)).groupBy("id").agg(F.count("*").alias("n")))
query(
    "paths_to_root",
    "SELECT id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM isa WHERE child = last)",
    "p AS (SELECT id, id AS last, CAST(id AS varchar) AS path FROM concept_names UNION ALL SELECT p.id, isa.parent, concat(p.path, '>', isa.parent) FROM p JOIN isa ON isa.child = p.last)",
)(lambda t: graph.paths_to_root(t, _of(t)).select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path")))
#: Every concept with every region and nation: with every other concept, pairs would grow with the square.
_PAIRS = "pairs AS (SELECT c.id AS a, p.id AS b FROM concept_names c, concept_names p WHERE p.kind IN ('region', 'nation'))"


def _places(t: Terminology) -> list[int]:
    return [r["id"] for r in t.concept.where("id >= 1000000000 AND id < 3000000000").select("id").collect()]


query("subsumed_by", "SELECT a, b, descendant IS NOT NULL AS is_a FROM pairs LEFT JOIN tcs ON descendant = a AND ancestor = b", _PAIRS)(lambda t: graph.subsumed_by_each(t, t.concept, _places(t)))
query(
    "subsumes",
    "SELECT b AS a, a AS b, CASE WHEN a = b THEN 'equivalent' WHEN down.descendant IS NOT NULL THEN 'subsumes' WHEN up.descendant IS NOT NULL THEN 'subsumed-by' ELSE 'not-subsumed' END AS relation"
    " FROM pairs LEFT JOIN tc AS down ON down.descendant = a AND down.ancestor = b LEFT JOIN tc AS up ON up.descendant = b AND up.ancestor = a",
    _PAIRS,
)(lambda t: graph.each_subsumes(t, _places(t), t.concept))
query("are_any", f"SELECT DISTINCT descendant AS id FROM tcs WHERE ancestor IN ({NATION}, {REGION})")(lambda t: graph.are_any(t, _of(t), t.ids(NATION, REGION)))
query("leaves", "SELECT id FROM concept_names WHERE id NOT IN (SELECT ancestor FROM tc)")(lambda t: graph.leaves(t, _of(t)))
query("top_of_set", "SELECT id FROM concept_names WHERE id NOT IN (SELECT descendant FROM tc)")(lambda t: graph.top_leaves(t, _of(t)))
_TARGET = "target AS (SELECT id FROM concept_names WHERE id < 3000000000 OR id > 9000000000 AND id < 10000000000)"
query(
    "map_into",
    "SELECT o.id, h.ancestor AS target_id FROM concept_names AS o LEFT JOIN h ON h.descendant = o.id WHERE o.kind IN ('order', 'part')",
    _TARGET,
    "hits AS MATERIALIZED (SELECT descendant, ancestor FROM tcs JOIN target ON target.id = ancestor)",
    "h AS MATERIALIZED (SELECT * FROM hits EXCEPT SELECT hits.descendant, tc.ancestor FROM hits JOIN tc ON tc.descendant = hits.ancestor)",
)(lambda t: graph.map_into(t, t.concept.where("id >= 5000000000 AND id < 7000000000"), t.concept.where("id < 3000000000 OR id > 9000000000 AND id < 10000000000")))
query(
    "map_to_fallback",
    f"SELECT h.descendant AS id, h.ancestor AS via, map_target FROM h JOIN m ON m.component_id = h.ancestor AND refset_id = {MAP} WHERE h.descendant >= 5000000000 AND h.descendant < 6000000000",
    f"target AS (SELECT DISTINCT component_id AS id FROM m WHERE refset_id = {MAP})",
    "hits AS MATERIALIZED (SELECT descendant, ancestor FROM tcs JOIN target ON target.id = ancestor)",
    "h AS MATERIALIZED (SELECT * FROM hits EXCEPT SELECT hits.descendant, tc.ancestor FROM hits JOIN tc ON tc.descendant = hits.ancestor)",
)(lambda t: graph.map_to(t, t.concept.where("id >= 5000000000 AND id < 6000000000"), MAP).select("id", "via", "map_target"))
query("properties_long", "SELECT source_id, relationship_group, type_id, destination_id AS target, '' AS literal FROM edge UNION ALL SELECT DISTINCT source_id, relationship_group, type_id, 0, value FROM lit")(
    lambda t: graph.properties(t).withColumns({"target": F.coalesce("target", F.lit(0)), "literal": F.coalesce("literal", F.lit(""))})
)
query("properties_expanded", "SELECT DISTINCT source_id, type_id, ancestor AS target FROM edge JOIN tcs ON descendant = destination_id")(graph.expanded)
query(
    "properties_by_group_flat",
    "SELECT source_id, relationship_group, type_id, string_agg(v, ',' ORDER BY v) AS targets FROM (SELECT DISTINCT source_id, relationship_group, type_id, CAST(destination_id AS varchar) AS v FROM edge) x GROUP BY ALL",
)(lambda t: t.edge.groupBy("source_id", "relationship_group", "type_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("destination_id").cast("string"))), ",").alias("targets")))
query("has_property", f"SELECT DISTINCT source_id AS id FROM edge JOIN tcs ON descendant = destination_id WHERE type_id = {ISA} AND ancestor = {NATION}")(
    lambda t: graph.has_property(t, t.concept, ISA, NATION, transitive=True)
)
query("transitive_synonyms", f"SELECT concept_id, descr.id AS description_id, term FROM tcs JOIN descr ON concept_id = descendant WHERE ancestor IN ({NATION}, {REGION}) AND type_id = {ids.SYNONYM} AND active")(
    lambda t: graph.transitive_synonyms(t, t.ids(NATION, REGION))
)

# expression constraints: attributes

O5 = "(< 5000000005 OR 5000000005 OR 5000000006)"
V5 = "(5000000005, 5000000006)"
E = "SELECT DISTINCT source_id AS id FROM edge"
constraint("ecl_self", f"{NATION}", f"SELECT DISTINCT concept_id AS id FROM sub WHERE concept_id = {NATION}")
constraint("ecl_descendant", f"< {REGION}", f"SELECT descendant AS id FROM tc WHERE ancestor = {REGION}")
constraint("ecl_descendant_self", f"<< {REGION}", f"SELECT descendant AS id FROM tcs WHERE ancestor = {REGION}")
constraint("ecl_child", f"<! {REGION}", f"SELECT child AS id FROM isa WHERE parent = {REGION}")
constraint("ecl_child_self", f"<<! {REGION}", f"SELECT child AS id FROM isa WHERE parent = {REGION} UNION SELECT {REGION}")
constraint("ecl_ancestor", "> 6000000000", "SELECT ancestor AS id FROM tc WHERE descendant = 6000000000")
constraint("ecl_ancestor_self", ">> 6000000000", "SELECT ancestor AS id FROM tcs WHERE descendant = 6000000000")
constraint("ecl_parent", ">! 6000000000", "SELECT parent AS id FROM isa WHERE child = 6000000000")
constraint("ecl_parent_self", ">>! 6000000000", "SELECT parent AS id FROM isa WHERE child = 6000000000 UNION SELECT 6000000000")
constraint("ecl_wildcard", "*", "SELECT DISTINCT concept_id AS id FROM sub")
constraint("ecl_wildcard_below", "< *", f"SELECT descendant AS id FROM tc WHERE ancestor = {ids.ROOT}")
constraint("ecl_and", f"< {REGION} AND < 9000000001", f"SELECT descendant AS id FROM tc WHERE ancestor = {REGION} INTERSECT SELECT descendant FROM tc WHERE ancestor = 9000000001")
constraint("ecl_or", f"<! {REGION} OR 9000000001", f"SELECT child AS id FROM isa WHERE parent = {REGION} UNION SELECT 9000000001")
constraint("ecl_minus", f"< {REGION} MINUS < 9000000001", f"SELECT descendant AS id FROM tc WHERE ancestor = {REGION} EXCEPT SELECT descendant FROM tc WHERE ancestor = 9000000001")
constraint(
    "nested_minus",
    f"<< (<! {REGION} MINUS {NATION})",
    f"SELECT DISTINCT descendant AS id FROM tcs JOIN isa ON child = ancestor WHERE parent = {REGION} EXCEPT SELECT descendant FROM tcs WHERE ancestor = {NATION}",
)
constraint("top_of_set_ecl", f"!!> (< {REGION} OR < 9000000001)", "SELECT id FROM s WHERE id NOT IN (SELECT descendant FROM tc JOIN s AS x ON x.id = ancestor)", f"s AS (SELECT DISTINCT descendant AS id FROM tc WHERE ancestor IN ({REGION}, 9000000001))")
constraint("bottom_of_set", f"!!< (< {REGION} OR < 9000000001)", "SELECT id FROM s WHERE id NOT IN (SELECT ancestor FROM tc JOIN s AS x ON x.id = descendant)", f"s AS (SELECT DISTINCT descendant AS id FROM tc WHERE ancestor IN ({REGION}, 9000000001))")
constraint("attribute_eq", f"*: {PART} = (5000000005 OR 5000000006)", f"{E} WHERE type_id = {PART} AND destination_id IN {V5}")
constraint("attribute_eq_hier", f"*: {PART} = < 7000000001", f"{E} JOIN tc ON descendant = destination_id WHERE type_id = {PART} AND ancestor = 7000000001")
constraint("attribute_any", f"*: {PART} = *", f"{E} WHERE type_id = {PART}")
constraint("attribute_name_hier", f"*: << {ids.CONCEPT_ATTRIBUTE} = (5000000005 OR 4000000002)", f"{E} WHERE type_id IN ({PART}, {SUPPLIER}) AND destination_id IN (5000000005, 4000000002)")
constraint("attribute_neq_existential", f"*: {SUPPLIER} != << 4000000002", f"{E} WHERE type_id = {SUPPLIER} AND destination_id <> 4000000002")
constraint("attribute_minus", f"*: {SUPPLIER} = (* MINUS 4000000002)", f"{E} WHERE type_id = {SUPPLIER} EXCEPT SELECT source_id FROM edge WHERE type_id = {SUPPLIER} AND destination_id = 4000000002")
constraint("attribute_wildcard", "*: * = (5000000005 OR 4000000002)", f"{E} WHERE type_id IN ({PART}, {SUPPLIER}) AND destination_id IN (5000000005, 4000000002)")
constraint("attribute_cardinality", f"*: [2..3] {PART} = *", f"SELECT source_id AS id FROM edge WHERE type_id = {PART} GROUP BY source_id HAVING count(DISTINCT destination_id) BETWEEN 2 AND 3")
constraint("attribute_zero", f"< {REGION}: [0..0] {PART} = *", f"SELECT descendant AS id FROM tc WHERE ancestor = {REGION} EXCEPT SELECT source_id FROM edge WHERE type_id = {PART}")
constraint("attribute_zero_or_more", f"< {REGION}: [0..*] {PART} = *", f"SELECT descendant AS id FROM tc WHERE ancestor = {REGION}")
constraint("attribute_or", f"*: {PART} = 5000000005 OR {SUPPLIER} = 4000000002", f"{E} WHERE (type_id = {PART} AND destination_id = 5000000005) OR (type_id = {SUPPLIER} AND destination_id = 4000000002)")
constraint("attribute_and", f"*: {PART} = < 7000000001, {SUPPLIER} = 4000000002", f"{E} JOIN tc ON descendant = destination_id WHERE type_id = {PART} AND ancestor = 7000000001 INTERSECT {E} WHERE type_id = {SUPPLIER} AND destination_id = 4000000002")
constraint("reverse_flag", f"*: R {PART} = < {NATION}", f"SELECT DISTINCT destination_id AS id FROM edge JOIN tc ON descendant = source_id WHERE type_id = {PART} AND ancestor = {NATION}")
constraint("dotted", f"< {NATION} . {SUPPLIER}", f"SELECT DISTINCT destination_id AS id FROM edge JOIN tc ON descendant = source_id WHERE type_id = {SUPPLIER} AND ancestor = {NATION}")
constraint("dotted_chain", f"< {NATION} . {PART} . {ISA}", f"SELECT DISTINCT parent AS id FROM edge JOIN tc ON descendant = source_id JOIN isa ON child = destination_id WHERE type_id = {PART} AND ancestor = {NATION}")
constraint(
    "group_conj",
    f"*: {{ {PART} = < 7000000001, {SUPPLIER} = (4000000002 OR 4000000003 OR 4000000004) }}",
    f"SELECT DISTINCT a.source_id AS id FROM edge a JOIN tc ON descendant = a.destination_id JOIN edge b ON a.source_id = b.source_id AND a.relationship_group = b.relationship_group WHERE a.type_id = {PART} AND ancestor = 7000000001 AND b.type_id = {SUPPLIER} AND b.destination_id IN (4000000002, 4000000003, 4000000004) AND a.relationship_group <> 0",
)
constraint(
    "group_neq",
    f"*: {{ {PART} = < 7000000001, {SUPPLIER} != 4000000002 }}",
    f"SELECT DISTINCT a.source_id AS id FROM edge a JOIN tc ON descendant = a.destination_id JOIN edge b ON a.source_id = b.source_id AND a.relationship_group = b.relationship_group WHERE a.type_id = {PART} AND ancestor = 7000000001 AND b.type_id = {SUPPLIER} AND b.destination_id <> 4000000002 AND a.relationship_group <> 0",
)
constraint(
    "group_numeric",
    f"*: {{ {PART} = < 7000000001, {QUANTITY} >= #45 }}",
    f"SELECT DISTINCT a.source_id AS id FROM edge a JOIN tc ON descendant = a.destination_id JOIN lit b ON a.source_id = b.source_id AND a.relationship_group = b.relationship_group WHERE a.type_id = {PART} AND ancestor = 7000000001 AND CAST(b.number AS int) >= 45 AND a.relationship_group <> 0",
)
for _name, _op in {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    constraint(f"numeric_{_name}", f"*: {QUANTITY} {_op} #{49 if _op in ('>', '>=') else 2}", f"SELECT DISTINCT source_id AS id FROM lit WHERE CAST(number AS int) {_op} {49 if _op in ('>', '>=') else 2}")

# members, history

SEG = 9000000001
constraint("member_of", f"^ {SEG}", f"SELECT DISTINCT component_id AS id FROM m WHERE refset_id = {SEG}")
constraint("member_of_nested", f"^ ({SEG} OR {MAP} OR 9000000002)", f"SELECT DISTINCT component_id AS id FROM m WHERE refset_id IN ({SEG}, 9000000002)")
constraint("member_of_any", "^ *", "SELECT DISTINCT component_id AS id FROM m WHERE component_id IN (SELECT concept_id FROM sub)")
constraint("member_descendants", f"< (^ {SEG})", f"SELECT DISTINCT descendant AS id FROM tc JOIN m ON component_id = ancestor WHERE refset_id = {SEG}")
constraint("member_filter_conj", f'^ {MAP} {{{{ M mapTarget = "Brand#1", mapPriority >= #20 }}}}', f"SELECT DISTINCT component_id AS id FROM m WHERE refset_id = {MAP} AND map_target LIKE 'Brand#1%' AND map_priority >= 20")
constraint("member_prefix", f'^ {MAP} {{{{ M mapTarget = ("Brand#12" "Brand#3") }}}}', f"SELECT DISTINCT component_id AS id FROM m WHERE refset_id = {MAP} AND (map_target LIKE 'Brand#12%' OR map_target LIKE 'Brand#3%')")
constraint("member_wildcard", f'^ {MAP} {{{{ M mapTarget = wild:"Brand#?2" }}}}', f"SELECT DISTINCT component_id AS id FROM m WHERE refset_id = {MAP} AND map_target LIKE 'Brand#_2'")
constraint("member_inactive", f"^ {MAP} {{{{ M active = false, mapPriority < #10 }}}}", f"SELECT DISTINCT component_id AS id FROM members WHERE refset_id = {MAP} AND NOT active AND map_priority < 10")
query("member_field_inactive_too", f"SELECT DISTINCT component_id AS id FROM members WHERE refset_id = {MAP} AND map_target = 'Brand#13'")(lambda t: members.member_field(t, MAP, F.col("map_target") == "Brand#13"))
query("refset_members", f"SELECT DISTINCT component_id AS id FROM members WHERE refset_id IN ({SEG}, {MAP})")(lambda t: members.refset_members(t, t.ids(SEG, MAP)))
query("reverse_map", f"SELECT component_id AS id, map_target, map_priority FROM m WHERE refset_id = {MAP} AND map_target LIKE 'Brand#2%'")(
    lambda t: members.reverse_map(t, MAP, F.col("map_target").startswith("Brand#2")).select(F.col("referenced_component_id").alias("id"), "map_target", "map_priority")
)
query("component_refsets", "SELECT DISTINCT component_id, refset_id FROM m")(lookups.refset_ids)
query("installed_refsets", "SELECT DISTINCT refset_id FROM members")(lambda t: t.installed)
query("refset_sizes", "SELECT refset_id, count(*) AS n, count(*) FILTER (active) AS active_n FROM members GROUP BY refset_id")(
    lambda t: t.refset_member.groupBy("refset_id").agg(F.count("*").alias("n"), F.count_if("active").alias("active_n"))
)
_ALL = f"({ids.SAME_AS}, {ids.REPLACED_BY}, {ids.MOVED_TO})"


def _history(name: str, refsets: str):
    views = (f"x AS (SELECT id FROM concept_names)", f"h AS (SELECT component_id AS s, target_id AS d FROM m WHERE refset_id IN {refsets})", "modern AS (SELECT id FROM x UNION SELECT d FROM h JOIN x ON x.id = s)")
    return name, "SELECT id FROM modern UNION SELECT s FROM h JOIN modern ON modern.id = d", *views


for _name, _refsets in {"MIN": f"({ids.SAME_AS})", "MOD": f"({ids.SAME_AS}, {ids.REPLACED_BY})", "MAX": _ALL}.items():
    query(*_history(f"history_{_name.lower()}", _refsets))(lambda t, n=_name: history.with_historical(t, _of(t), history.profile(t, n)))
query(*_history("with_historical", f"({ids.SAME_AS}, {ids.REPLACED_BY})"))(lambda t: history.with_historical(t, _of(t)))
query("historical_associations", f"SELECT component_id AS source_id, refset_id, target_id FROM m WHERE refset_id IN {_ALL}")(history.historical_associations)
query("source_historical", f"SELECT DISTINCT component_id AS id FROM m JOIN concept_names c ON c.id = target_id WHERE refset_id IN {_ALL}")(lambda t: history.source_historical(t, _of(t)))
query(
    "historical_counts",
    f"SELECT associations, count(*) AS concepts FROM (SELECT c.id, count(target_id) AS associations FROM concept_names c LEFT JOIN m ON component_id = c.id AND refset_id IN {_ALL} WHERE NOT c.active GROUP BY c.id) x GROUP BY associations",
)(history.association_counts)
query("replaced_by", f"SELECT component_id AS source_id, target_id FROM m WHERE refset_id = {ids.REPLACED_BY}")(history.replaced_by)
query(
    "replace_historical",
    f"SELECT c.id, coalesce(CASE WHEN NOT c.active AND t.active THEN t.id END, c.id) AS now FROM concept_names c LEFT JOIN m ON component_id = c.id AND refset_id = {ids.SAME_AS} LEFT JOIN concept_names t ON t.id = m.target_id",
)(lambda t: history.replace_unambiguous(t, t.concept))
constraint(
    "history_supplement",
    f"(< {NATION} AND < 9000000001) {{{{ +HISTORY-MOD }}}}",
    "SELECT id FROM modern UNION SELECT s FROM h JOIN modern ON modern.id = d",
    f"x AS (SELECT descendant AS id FROM tc WHERE ancestor = {NATION} INTERSECT SELECT descendant FROM tc WHERE ancestor = 9000000001)",
    f"h AS (SELECT component_id AS s, target_id AS d FROM m WHERE refset_id IN ({ids.SAME_AS}, {ids.REPLACED_BY}))",
    "modern AS (SELECT id FROM x UNION SELECT d FROM h JOIN x ON x.id = s)",
)

# descriptions and text

_TOK = "list_filter(string_split_regex(lower({}), '[^a-z0-9_]+'), lambda w: w <> '')"
_TK = f"tk AS MATERIALIZED (SELECT *, {_TOK.format('term')} AS tokens FROM sub)"
constraint("desc_type_filter", f'<< {REGION} {{{{ type = fsn, term = "nation" }}}}', f"SELECT DISTINCT concept_id AS id FROM tk JOIN tcs ON descendant = concept_id WHERE ancestor = {REGION} AND type_id = {ids.FSN} AND len(list_filter(tokens, lambda w: w LIKE 'nation%')) > 0", _TK)
constraint("desc_grain_and", '* {{ term = "code" }} AND * {{ type = fsn }}', f"SELECT DISTINCT concept_id AS id FROM tk WHERE type_id = {ids.FSN} AND len(list_filter(tokens, lambda w: w LIKE 'code%')) > 0", _TK)
constraint("term_match", '* {{ term = "cust 0000001" }}', "SELECT DISTINCT concept_id AS id FROM tk WHERE len(list_filter(tokens, lambda w: w LIKE 'cust%')) > 0 AND len(list_filter(tokens, lambda w: w LIKE '0000001%')) > 0", _TK)
constraint("term_wild", '* {{ term = wild:"supplier*7" }}', "SELECT DISTINCT concept_id AS id FROM sub WHERE lower(term) LIKE 'supplier%7'")
constraint("term_not", f'< {REGION} {{{{ term != "customer", type = syn }}}}', f"SELECT DISTINCT concept_id AS id FROM tk JOIN tc ON descendant = concept_id WHERE ancestor = {REGION} AND type_id = {ids.SYNONYM} AND len(list_filter(tokens, lambda w: w LIKE 'customer%')) = 0", _TK)
constraint("description_active_filter", "* {{ active = false }}", "SELECT DISTINCT concept_id AS id FROM sub WHERE NOT description_active")
constraint("concept_active_filter", f"< {REGION} {{{{ C active = false }}}}", f"SELECT DISTINCT concept_id AS id FROM sub JOIN tc ON descendant = concept_id WHERE ancestor = {REGION} AND NOT concept_active")
constraint("dialect_filter", "* {{ dialect = en-gb (accept) }}", f"SELECT DISTINCT concept_id AS id FROM sub JOIN m ON component_id = description_id WHERE refset_id = {ids.EN_GB} AND acceptability_id = {ids.ACCEPTABLE}")
constraint("dialect_id_filter", f"* {{{{ dialectId = {ids.EN_GB} }}}}", f"SELECT DISTINCT concept_id AS id FROM sub JOIN m ON component_id = description_id WHERE refset_id = {ids.EN_GB}")
constraint(
    "dialect_id_set", f"* {{{{ type = syn, dialectId = ({ids.EN_GB} (accept) {ids.EN_US} (prefer)) }}}}",
    f"SELECT DISTINCT concept_id AS id FROM sub JOIN m ON component_id = description_id WHERE type_id = {ids.SYNONYM} AND (refset_id = {ids.EN_GB} AND acceptability_id = {ids.ACCEPTABLE} OR refset_id = {ids.EN_US} AND acceptability_id = {ids.PREFERRED})",
)
constraint("dialect_set_accepted", "* {{ dialect = (en-gb en-us) (accept) }}", f"SELECT DISTINCT concept_id AS id FROM sub JOIN m ON component_id = description_id WHERE refset_id IN ({ids.EN_GB}, {ids.EN_US}) AND acceptability_id = {ids.ACCEPTABLE}")
constraint("type_id_set", f'* {{{{ term = "nation", typeId = ({ids.SYNONYM} |Synonym| {ids.FSN}) }}}}', f"SELECT DISTINCT concept_id AS id FROM tk WHERE type_id IN ({ids.SYNONYM}, {ids.FSN}) AND len(list_filter(tokens, lambda w: w LIKE 'nation%')) > 0", _TK)
constraint("concept_active_zero", f"< {REGION} {{{{ C active = 0 }}}}", f"SELECT DISTINCT concept_id AS id FROM sub JOIN tc ON descendant = concept_id WHERE ancestor = {REGION} AND NOT concept_active")
constraint("description_active_one", '* {{ active = 1, term = "code" }}', "SELECT DISTINCT concept_id AS id FROM tk WHERE description_active AND len(list_filter(tokens, lambda w: w LIKE 'code%')) > 0", _TK)
constraint("term_wild_narrowed", f'< {REGION} {{{{ term = wild:"*" }}}}', f"SELECT descendant AS id FROM tc WHERE ancestor = {REGION}")
constraint("desc_grain_and_same", '* {{ term = "code" }} AND * {{ type = syn }}', f"SELECT DISTINCT concept_id AS id FROM tk WHERE type_id = {ids.SYNONYM} AND len(list_filter(tokens, lambda w: w LIKE 'code%')) > 0", _TK)
query("ecl_expand", f"SELECT description_id, concept_id, term FROM sub JOIN tc ON descendant = concept_id WHERE ancestor = {NATION} AND type_id = {ids.SYNONYM}")(lambda t: ecl.expand(t, f"< {NATION}"))
query(
    "ecl_expand_preferred",
    f"SELECT description_id, concept_id, term FROM sub JOIN m ON component_id = description_id AND refset_id = {ids.EN_US} JOIN tc ON descendant = concept_id WHERE ancestor = {ids.ROOT} AND type_id = {ids.SYNONYM} AND description_active",
)(lambda t: ecl.expand_preferred(t, f"< {ids.ROOT}", [ids.EN_US]))
query("ecl_expand_historic", f"SELECT description_id, concept_id, term FROM sub WHERE type_id = {ids.SYNONYM} AND concept_id IN (SELECT descendant FROM tc WHERE ancestor = {NATION} UNION SELECT component_id FROM m JOIN tc ON descendant = target_id WHERE ancestor = {NATION} AND refset_id IN {_ALL})")(
    lambda t: ecl.expand_historic(t, f"< {NATION}")
)
query("ecl_count", f"SELECT count(*) AS n FROM tc WHERE ancestor = {REGION}")(lambda t: ecl.count(t, f"< {REGION}"))
query("intersect_ecl", f"SELECT DISTINCT descendant AS id FROM tc WHERE ancestor = {REGION} ")(lambda t: ecl.intersect(t, t.concept, f"< {REGION}"))


def _search(sql_where: str, order: str = "") -> str:
    return f"SELECT description_id, concept_id, term, p.term AS preferred_term FROM (SELECT * FROM tk WHERE {sql_where} {order}) x LEFT JOIN p USING (concept_id)".replace("concept_id, term, p.term", "x.concept_id, x.term, p.term")


_P = f"p AS MATERIALIZED (SELECT concept_id, min_by(term, d.id) AS term FROM descr d JOIN m ON component_id = d.id WHERE d.active AND type_id = {ids.SYNONYM} AND refset_id = {ids.EN_US} AND acceptability_id = {ids.PREFERRED} GROUP BY concept_id)"
_HIT = f"concept_active AND type_id <> {ids.FSN} AND "
query("preferred_synonym", "SELECT concept_id, term FROM p", _P)(lambda t: lookups.preferred_synonym(t, [ids.EN_US]).select("concept_id", "term"))
query(
    "preferred_synonym_by_locale",
    "SELECT concept_id, min_by(term, (place, id)) AS term FROM r GROUP BY concept_id",
    f"r AS (SELECT concept_id, d.id, d.term, CASE refset_id WHEN {ids.EN_GB} THEN 0 ELSE 1 END AS place FROM descr d JOIN m ON component_id = d.id WHERE d.active AND type_id = {ids.SYNONYM} AND refset_id IN ({ids.EN_GB}, {ids.EN_US}) AND acceptability_id = {ids.PREFERRED})",
)(lambda t: lookups.preferred_synonym(t, [ids.EN_GB, ids.EN_US]).select("concept_id", "term"))
query("fully_specified_name", f"SELECT concept_id, term FROM descr WHERE type_id = {ids.FSN}")(lambda t: lookups.fully_specified_name(t, [ids.EN_US]).select("concept_id", "term"))
query("search_autocomplete", _search(_HIT + "len(list_filter(tokens, lambda w: w LIKE 'supp%')) > 0"), _TK, _P)(lambda t: text.search(t, "Supp"))
query("search_top_k", _search(_HIT + "len(list_filter(tokens, lambda w: w LIKE 'cust%')) > 0", "ORDER BY length(term), description_id LIMIT 20"), _TK, _P)(lambda t: text.search(t, "cust", max_hits=20))
query("search_fuzzy_fallback", _search(_HIT + "len(list_filter(tokens, lambda w: w LIKE 'suplier%' OR levenshtein(w, 'suplier') <= 1)) > 0"), _TK, _P)(lambda t: text.search(t, "suplier", fallback_fuzzy=1))
query("search_constrained", _search(_HIT + f"concept_id IN (SELECT descendant FROM tcs WHERE ancestor = {NATION}) AND len(list_filter(tokens, lambda w: w LIKE 'order%')) > 0"), _TK, _P)(
    lambda t: text.search(t, "order", constraint=ecl.concepts(t, f"<< {NATION}"))
)
query("search_ranked", f"SELECT description_id, concept_id, term, score FROM (SELECT *, CAST((len(list_filter(tokens, lambda w: w LIKE 'code%')) > 0) AS int) + CAST((len(list_filter(tokens, lambda w: w LIKE '50000000%')) > 0) AS int) AS score FROM tk WHERE concept_active AND type_id <> {ids.FSN}) x WHERE score > 0 ORDER BY score DESC, length(term), description_id LIMIT 50", _TK)(
    lambda t: text.ranked_search(t, "code 50000000", max_hits=50)
)
query(
    "dedupe_consecutive",
    "SELECT description_id, concept_id, term FROM (SELECT *, lag(concept_id) OVER w AS c, lag(term) OVER w AS t FROM (SELECT description_id, concept_id % 2 AS concept_id, term FROM sub) y WINDOW w AS (ORDER BY term, description_id)) x WHERE c IS NULL OR c <> concept_id OR t <> term",
)(lambda t: text.consecutive_distinct(t.substrate.select("description_id", (F.col("concept_id") % 2).alias("concept_id"), "term"), ["term", "description_id"]))
_EXTENDED = """e AS (SELECT c.id, (SELECT count(*) FROM descr d WHERE d.concept_id = c.id) AS n_descriptions, p.term AS preferred_synonym FROM concept_names c LEFT JOIN p ON p.concept_id = c.id),
u AS (SELECT descendant AS id, string_agg(CAST(ancestor AS varchar), ',' ORDER BY ancestor) AS ancestors FROM tc GROUP BY descendant),
r AS (SELECT component_id AS id, string_agg(CAST(refset_id AS varchar), ',' ORDER BY refset_id) AS refsets FROM (SELECT DISTINCT component_id, refset_id FROM m) x GROUP BY component_id),
v AS (SELECT source_id AS id, count(*) AS n_values FROM lit GROUP BY source_id)"""
query("extended_concept_flat", "SELECT id, n_descriptions, coalesce(ancestors, '') AS ancestors, coalesce(refsets, '') AS refsets, coalesce(n_values, 0) AS n_values, preferred_synonym FROM e LEFT JOIN u USING (id) LEFT JOIN r USING (id) LEFT JOIN v USING (id)", _P, _EXTENDED)(
    lambda t: lookups.extended_concept(t, [ids.EN_US]).withColumn("up", F.col("parents")[F.lit(ISA).cast("bigint")]).select(
        "id", F.coalesce(F.size("descriptions"), F.lit(0)).cast("bigint").alias("n_descriptions"), _joined("up").alias("ancestors"), _joined("refsets").alias("refsets"), F.when(F.col("concrete_values").isNull(), 0).otherwise(F.size("concrete_values")).cast("bigint").alias("n_values"), "preferred_synonym"
    )
)
query("status_counts", "SELECT 'concepts' AS name, count(*) AS n FROM concept_names UNION ALL SELECT 'descriptions', count(*) FROM descr UNION ALL SELECT 'relationships', count(*) FROM rel UNION ALL SELECT 'concrete_values', count(*) FROM lit UNION ALL SELECT 'refset_items', count(*) FROM members UNION ALL SELECT 'refsets', count(DISTINCT refset_id) FROM members UNION ALL SELECT 'edges', count(*) FROM edge UNION ALL SELECT 'closure', count(*) FROM tc")(
    lookups.status
)

# lookups of whole tables

_LIST = "string_agg(v, ',' ORDER BY v) AS targets"
query("descriptions", "SELECT id, concept_id, type_id, term, active FROM descr")(lambda t: lookups.descriptions(t, t.concept).select("id", "concept_id", "type_id", "term", "active"))
query("synonyms", f"SELECT id, concept_id, term FROM descr WHERE type_id = {ids.SYNONYM}")(lambda t: lookups.synonyms(t, t.concept).select("id", "concept_id", "term"))
query("synonyms_by_refset", f"SELECT DISTINCT d.id, concept_id, term FROM descr d JOIN m ON component_id = d.id WHERE type_id = {ids.SYNONYM} AND d.active AND refset_id = {ids.EN_GB}")(
    lambda t: lookups.synonyms(t, t.concept, t.ids(ids.EN_GB)).select("id", "concept_id", "term")
)
query("parent_relationships", f"SELECT source_id, type_id, {_LIST} FROM (SELECT DISTINCT source_id, type_id, CAST(destination_id AS varchar) AS v FROM edge) x GROUP BY ALL")(
    lambda t: graph.parent_relationships(t).select("source_id", F.explode("relationships").alias("type_id", "x")).select("source_id", "type_id", F.array_join(F.sort_array(F.transform("x", lambda v: v.cast("string"))), ",").alias("targets"))
)
query(
    "properties_by_group",
    f"SELECT source_id, relationship_group, type_id, {_LIST} FROM (SELECT DISTINCT source_id, relationship_group, type_id, CAST(destination_id AS varchar) AS v FROM edge UNION SELECT source_id, relationship_group, type_id, value FROM lit) x GROUP BY ALL",
)(
    lambda t: graph.properties_by_group(t).select("source_id", F.explode("properties").alias("relationship_group", "x")).select("source_id", "relationship_group", F.explode("x").alias("type_id", "v")).select("source_id", "relationship_group", "type_id", F.array_join("v", ",").alias("targets"))
)
query("properties_by_type", f"SELECT source_id, type_id, relationship_group, {_LIST} FROM (SELECT DISTINCT source_id, type_id, relationship_group, CAST(destination_id AS varchar) AS v FROM edge) x GROUP BY ALL")(
    lambda t: graph.properties_by_type(t).select("source_id", "type_id", F.explode("groups").alias("relationship_group", "x")).select("source_id", "type_id", "relationship_group", F.array_join(F.sort_array(F.transform("x", lambda v: v.cast("string"))), ",").alias("targets"))
)
query(
    "properties_long_expanded",
    "SELECT DISTINCT source_id, relationship_group, type_id, ancestor AS target, '' AS literal FROM edge JOIN tcs ON descendant = destination_id UNION ALL SELECT DISTINCT source_id, relationship_group, type_id, 0, value FROM lit",
)(lambda t: graph.properties(t, expand=True).withColumns({"target": F.coalesce("target", F.lit(0)), "literal": F.coalesce("literal", F.lit(""))}))
query(
    "readable_properties",
    "SELECT source_id, relationship_group, concat_ws(' ', CAST(type_id AS varchar), coalesce(a.term, '')) AS attribute, concat_ws(' ', CAST(destination_id AS varchar), coalesce(b.term, '')) AS value FROM edge LEFT JOIN p a ON a.concept_id = type_id LEFT JOIN p b ON b.concept_id = destination_id"
    " UNION ALL SELECT DISTINCT source_id, relationship_group, concat_ws(' ', CAST(type_id AS varchar), coalesce(a.term, '')), value FROM lit LEFT JOIN p a ON a.concept_id = type_id",
    _P,
)(lambda t: graph.readable_properties(t, [ids.EN_US]))
query("some_indexed", f"SELECT DISTINCT component_id AS id FROM m WHERE refset_id = {MAP}")(lambda t: graph.some_indexed(t, t.concept, MAP))
query("refset_items", f"SELECT id, component_id, map_target FROM m WHERE refset_id = {MAP}")(lambda t: lookups.refset_items(t, t.concept, MAP).select("id", F.col("referenced_component_id").alias("component_id"), "map_target"))
_COMPONENT = "CASE substr(id, 1, 3) WHEN 'seg' THEN 'Simple' WHEN 'map' THEN 'SimpleMap' WHEN 'his' THEN 'Association' ELSE 'Language' END"
query("refset_counts", f"SELECT {_COMPONENT} AS component, count(*) AS n FROM members GROUP BY 1")(lookups.refset_counts)
query("language_refsets", "SELECT DISTINCT refset_id FROM members WHERE acceptability_id IS NOT NULL")(lookups.language_refsets)
query("concept_flags", "SELECT id, defined, NOT defined AS \"primitive\" FROM concept_names")(lookups.concept_flags)
query("description_flags", f"SELECT id, type_id = {ids.FSN} AS is_fsn, type_id = {ids.SYNONYM} AS is_synonym, type_id = {ids.DEFINITION} AS is_definition FROM descr")(lookups.description_flags)
query("concepts_of_descriptions", "SELECT description_id, concept_id FROM sub")(lambda t: lookups.concepts_of(t, t.description))
query("first_ids", "SELECT id FROM concept_names ORDER BY id LIMIT 100")(lambda t: lookups.first_ids(t, 100))
query("search_concept_ids", "SELECT c.id, d.description_id, d.term, d.term AS preferred_term FROM concept_names c LEFT JOIN d ON d.concept_id = c.id", f"d AS (SELECT concept_id, min(d.id) AS description_id, min_by(term, d.id) AS term FROM descr d JOIN m ON component_id = d.id WHERE d.active AND type_id = {ids.SYNONYM} AND refset_id = {ids.EN_US} AND acceptability_id = {ids.PREFERRED} GROUP BY concept_id)")(
    lambda t: text.search_concept_ids(t, t.concept, [ids.EN_US])
)
query("association_targets", f"SELECT DISTINCT target_id AS id FROM m WHERE refset_id = {ids.SAME_AS}")(lambda t: history.association_targets(t, t.concept, ids.SAME_AS))
query("same_as", f"SELECT component_id AS source_id, CAST(target_id AS varchar) AS targets FROM m WHERE refset_id = {ids.SAME_AS}")(lambda t: history.same_as(t).select("source_id", _joined("targets").alias("targets")))
query("moved_to", f"SELECT component_id AS source_id, target_id FROM m WHERE refset_id = {ids.MOVED_TO}")(history.moved_to)
query("source_associations", f"SELECT target_id, refset_id, CAST(component_id AS varchar) AS sources FROM m WHERE refset_id IN {_ALL} AND target_id IN (SELECT id FROM concept_names)")(
    lambda t: history.source_associations(t, t.concept).select("target_id", "refset_id", _joined("sources").alias("sources"))
)
query("example_associations", f"SELECT component_id AS source_id, refset_id, target_id FROM m WHERE refset_id = {ids.REPLACED_BY} ORDER BY component_id LIMIT 5")(lambda t: history.example_associations(t, ids.REPLACED_BY, 5))

# functions and ingest

QUERIES["identifier_partition"] = lambda spark, sf_dir: from_tables(spark, sf_dir).concept.select("id", identifiers.kind_column(F.col("id")).alias("kind"))


def newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return newest(rows, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


QUERIES["newest_wins"] = newest_wins
ORACLE_SQL["newest_wins"] = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) x WHERE r = 1"


def fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.fold_column("text", "lang").alias("f"))
    return folded.select("doc_id", F.length("f").cast("bigint").alias("n"), F.md5("f").alias("folded"))


#: Marks are stripped alike in SQL only where no letter has another form; a test holds all texts against a plain loop.
QUERIES["fold_text"] = fold_documents
