"""Compositional expressions: parse, render, normalise, compare.

An expression's close-to-user form has focus concepts, ungrouped attributes and groups; its classifiable form has the
same in sets, with concepts defined by others replaced by these. Expressions are small and handled in Python; what they
need of the terminology comes as a Lookup, read in bulk for all expressions of a batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.identifiers import is_valid
from . import ids
from .model import Terminology

EQUIVALENT, SUBTYPE = "===", "<<<"


class ScgError(ValueError):
    pass


@dataclass(frozen=True)
class Concept:
    id: int
    term: str | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Expression:
    focus: tuple[Concept, ...]
    ungrouped: tuple[tuple[Concept, object], ...] = ()
    groups: tuple[tuple[tuple[Concept, object], ...], ...] = ()
    status: str = EQUIVALENT


_TOKENS = re.compile(r"\s+|(?P<status>===|<<<)|(?P<id>\d{6,18})|(?P<term>\|[^|]*\|)|(?P<number>#[+-]?\d+(?:\.\d+)?)|(?P<text>\"(?:[^\"\\]|\\.)*\")|(?P<flag>(?i:true|false)\b)|(?P<mark>[:+,={}()])")


class _Parser:
    def __init__(self, source: str, check_ids: bool):
        self.items, at = [], 0
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise ScgError(f"unexpected {source[at : at + 10]!r} at {at}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[0], at))
            at = m.end()
        self.i, self.check_ids = 0, check_ids

    def peek(self, text: str) -> bool:
        return self.i < len(self.items) and self.items[self.i][0] == "mark" and self.items[self.i][1] == text

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.i += 1
            return True
        return False

    def kind(self, name: str) -> str | None:
        if self.i < len(self.items) and self.items[self.i][0] == name:
            self.i += 1
            return self.items[self.i - 1][1]
        return None

    def fail(self) -> ScgError:
        return ScgError(f"unexpected {self.items[self.i][1]!r} at {self.items[self.i][2]}" if self.i < len(self.items) else "unexpected end")

    def whole(self) -> Expression:
        status = self.kind("status") or EQUIVALENT
        out = self.expression(status)
        if self.i < len(self.items):
            raise self.fail()
        return out

    def expression(self, status: str = EQUIVALENT) -> Expression:
        focus = [self.concept()]
        while self.take("+"):
            focus.append(self.concept())
        ungrouped, groups = [], []
        if self.take(":"):
            while True:
                if self.take("{"):
                    pairs = [self.pair()]
                    while self.take(","):
                        pairs.append(self.pair())
                    if not self.take("}"):
                        raise self.fail()
                    groups.append(tuple(pairs))
                elif groups and not self.items[self.i : self.i + 1]:
                    raise self.fail()
                else:
                    ungrouped.append(self.pair())
                if not self.take(",") and not self.peek("{"):
                    break
        return Expression(tuple(focus), tuple(ungrouped), tuple(groups), status)

    def concept(self) -> Concept:
        text = self.kind("id")
        if text is None:
            raise self.fail()
        if self.check_ids and not is_valid(text):
            raise ScgError(f"invalid identifier {text}")
        term = self.kind("term")
        return Concept(int(text), term[1:-1].strip() if term else None)

    def pair(self) -> tuple[Concept, object]:
        name = self.concept()
        if not self.take("="):
            raise self.fail()
        if self.take("("):
            value: object = self.expression()
            if not self.take(")"):
                raise self.fail()
        elif (x := self.kind("number")) is not None:
            value = float(x[1:])
        elif (x := self.kind("text")) is not None:
            value = re.sub(r"\\(.)", r"\1", x[1:-1])
        elif (x := self.kind("flag")) is not None:
            value = x.lower() == "true"
        else:
            value = self.concept()
        return name, value


def parse(source: str, *, check_ids: bool = True) -> Expression:
    return _Parser(source, check_ids).whole()


def is_valid_expression(source: str, *, check_ids: bool = True) -> bool:
    try:
        parse(source, check_ids=check_ids)
        return True
    except ScgError:
        return False


def _literal(value: object) -> str | None:
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"#{value:g}"
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return None


def render(e: Expression, *, terms: str | None = None, names: dict[int, str] | None = None, status: str = "auto") -> str:
    """terms: None as they are, strip, update (where there is one) or add; names: preferred terms. status: auto (only subtypes) or always."""

    def concept(c: Concept) -> str:
        term = c.term
        if terms == "strip":
            term = None
        elif terms == "add" or (terms == "update" and term is not None):
            term = (names or {}).get(c.id, term)
        return f"{c.id} |{term}|" if term else str(c.id)

    def value(v: object) -> str:
        if isinstance(v, Concept):
            return concept(v)
        return f"({inner(v)})" if isinstance(v, Expression) else _literal(v)

    def pairs(ps) -> str:
        return ", ".join(f"{concept(n)} = {value(v)}" for n, v in ps)

    def inner(x: Expression) -> str:
        parts = ([pairs(x.ungrouped)] if x.ungrouped else []) + [f"{{ {pairs(g)} }}" for g in x.groups]
        return " + ".join(map(concept, x.focus)) + (f" : {', '.join(parts)}" if parts else "")

    head = f"{e.status} " if status == "always" or (status == "auto" and e.status == SUBTYPE) else ""
    return head + inner(e)


def strip_terms(e: Expression) -> Expression:
    return parse(render(e, terms="strip", status="always"), check_ids=False)


def canonical(e: Expression) -> Expression:
    """Focus concepts by id, attributes by their ids, groups by their smallest attribute's id."""
    key = lambda p: (p[0].id, _key(p[1]))
    inner = lambda v: canonical(v) if isinstance(v, Expression) else v
    order = lambda ps: tuple(sorted(((n, inner(v)) for n, v in ps), key=key))
    return Expression(tuple(sorted(e.focus, key=lambda c: c.id)), order(e.ungrouped), tuple(sorted(map(order, e.groups), key=lambda g: [key(p) for p in g])), e.status)


def _key(v: object) -> str:
    return str(v.id) if isinstance(v, Concept) else render(canonical(v), terms="strip") if isinstance(v, Expression) else _literal(v)


def concepts_of(e: Expression) -> set[int]:
    out = {c.id for c in e.focus}
    for n, v in (*e.ungrouped, *(p for g in e.groups for p in g)):
        out.add(n.id)
        out |= concepts_of(v) if isinstance(v, Expression) else {v.id} if isinstance(v, Concept) else set()
    return out


@dataclass
class Lookup:
    """Of concepts and all above them: what is above each, whether it is defined and active, its parents and grouped properties."""

    above: dict[int, frozenset[int]]
    defined: frozenset[int]
    active: frozenset[int]
    known: frozenset[int]
    parents: dict[int, tuple[int, ...]]
    properties: dict[int, dict[int, frozenset[tuple[int, int]]]]

    @classmethod
    def of(cls, t: Terminology, concepts: set[int]) -> Lookup:
        """Reads what the given concepts need: sizes go with the expressions of one batch, not with the terminology."""
        seeds = t.ids(*concepts)
        near = t.tc.join(seeds.toDF("descendant"), "descendant", "left_semi").select(F.col("ancestor").alias("id")).union(seeds).distinct()
        edges = t.edge.join(near.toDF("source_id"), "source_id", "left_semi").collect()
        values = {r["destination_id"] for r in edges}
        every = t.ids(*(concepts | values)).union(near).distinct()
        pairs = t.tc.join(every.toDF("descendant"), "descendant", "left_semi").groupBy("descendant").agg(F.collect_list("ancestor").alias("a")).collect()
        rows = t.concept.join(every, "id", "left_semi").select("id", "active", "definition_status_id").collect()
        parents: dict[int, list[int]] = {}
        properties: dict[int, dict[int, set]] = {}
        for r in edges:
            if r["type_id"] == ids.IS_A:
                parents.setdefault(r["source_id"], []).append(r["destination_id"])
            else:
                properties.setdefault(r["source_id"], {}).setdefault(r["relationship_group"], set()).add((r["type_id"], r["destination_id"]))
        return cls(
            {r["descendant"]: frozenset(r["a"]) for r in pairs},
            frozenset(r["id"] for r in rows if r["definition_status_id"] == ids.DEFINED),
            frozenset(r["id"] for r in rows if r["active"]),
            frozenset(r["id"] for r in rows),
            {k: tuple(sorted(v)) for k, v in parents.items()},
            {k: {g: frozenset(x) for g, x in v.items()} for k, v in properties.items()},
        )

    def is_a(self, a: int, b: int) -> bool:
        return a == b or b in self.above.get(a, ())


@dataclass(frozen=True)
class Classifiable:
    """focus, ungrouped and groups as sets; a value is a concept id, a Classifiable, or a tagged literal."""

    focus: frozenset[int]
    ungrouped: frozenset = frozenset()
    groups: frozenset = frozenset()
    status: str = EQUIVALENT


def classifiable(e: Expression) -> Classifiable:
    """A change of shape only."""

    def value(v: object):
        return v.id if isinstance(v, Concept) else classifiable(Expression(v.focus, v.ungrouped, v.groups)) if isinstance(v, Expression) else _literal(v)

    pairs = lambda ps: frozenset((n.id, value(v)) for n, v in ps)
    return Classifiable(frozenset(c.id for c in e.focus), pairs(e.ungrouped), frozenset(map(pairs, e.groups)), e.status)


def _value_is(look: Lookup, a: object, b: object) -> bool:
    """Concepts by the hierarchy; literals and (normal) expressions only if they are the same."""
    return look.is_a(a, b) if isinstance(a, int) and isinstance(b, int) else a == b


def _pair_is(look: Lookup, a: tuple, b: tuple) -> bool:
    return look.is_a(a[0], b[0]) and _value_is(look, a[1], b[1])


def _group_is(look: Lookup, a: frozenset, b: frozenset) -> bool:
    return all(any(_pair_is(look, x, y) for x in a) for y in b)


def subsumes(look: Lookup, a: Classifiable, b: Classifiable) -> bool:
    """Whether all that a says holds of b: each of its focus concepts, ungrouped attributes and groups has one as specific among b's of the same
    kind. An attribute in a group of b does not meet an ungrouped one of a. Without focus concepts nothing subsumes or is subsumed."""
    return bool(
        a.focus
        and b.focus
        and all(any(look.is_a(y, x) for y in b.focus) for x in a.focus)
        and all(any(_pair_is(look, y, x) for y in b.ungrouped) for x in a.ungrouped)
        and all(any(_group_is(look, h, g) for h in b.groups) for g in a.groups)
    )


def relation(look: Lookup, a: Classifiable, b: Classifiable) -> str:
    down, up = subsumes(look, a, b), subsumes(look, b, a)
    return "equivalent" if down and up else "subsumes" if down else "subsumed-by" if up else "not-subsumed"


def normalise(e: Expression, look: Lookup) -> Classifiable:
    """Defined focus concepts give way to the primitive ones nearest above and to their attributes; nested expressions are normalised alike.

    Of the attributes of one type, ungrouped or in one group, those with the most specific concepts stay; of the groups, those that no other one is
    as specific as. All focus concepts stay. Unknown and inactive concepts raise.
    """
    wrong = (concepts_of(e) - look.known) | (concepts_of(e) & look.known) - look.active
    if wrong:
        raise ScgError(f"unknown or inactive concepts {sorted(wrong)}")
    done: dict[int, tuple[set[int], set, set]] = {}

    def primitives(c: int) -> tuple[set[int], set, set]:
        if c not in done:
            loose = {(n, v) for n, v in look.properties.get(c, {}).get(0, ())}
            groups = {frozenset(g) for k, g in look.properties.get(c, {}).items() if k != 0}
            focus = {c}
            if c in look.defined and look.parents.get(c):
                focus = set()
                for p in look.parents[c]:
                    f, u, g = primitives(p)
                    focus |= f
                    loose |= u
                    groups |= g
            done[c] = focus, loose, groups
        return done[c]

    def most_specific(pairs: set) -> frozenset:
        return frozenset((n, v) for n, v in pairs if not (isinstance(v, int) and any(m == n and isinstance(w, int) and w != v and look.is_a(w, v) for m, w in pairs)))

    def own(ps) -> set:
        return {(n.id, normalise(v, look) if isinstance(v, Expression) else v.id if isinstance(v, Concept) else _literal(v)) for n, v in ps}

    focus: set[int] = set()
    loose, groups = own(e.ungrouped), {frozenset(own(g)) for g in e.groups}
    for c in e.focus:
        f, u, g = primitives(c.id)
        focus |= f
        loose |= u
        groups |= g
    groups = {most_specific(g) for g in groups}
    groups = {g for g in groups if not any(h != g and _group_is(look, h, g) for h in groups)}
    return Classifiable(frozenset(focus), most_specific(loose), frozenset(groups), SUBTYPE)


def from_classifiable(c: Classifiable) -> Expression:
    def value(v: object):
        if isinstance(v, int):
            return Concept(v)
        if isinstance(v, Classifiable):
            return from_classifiable(v)
        return float(v[1:]) if v.startswith("#") else v == "TRUE" if v in ("TRUE", "FALSE") else re.sub(r"\\(.)", r"\1", v[1:-1])

    pairs = lambda ps: tuple((Concept(n), value(v)) for n, v in ps)
    return canonical(Expression(tuple(map(Concept, c.focus)), pairs(c.ungrouped), tuple(map(pairs, c.groups)), c.status))


def to_ecl(c: Classifiable) -> str:
    """A constraint for what an expression subsumes."""
    def value(v: object) -> str:
        return f"<< {v}" if isinstance(v, int) else f"({to_ecl(v)})" if isinstance(v, Classifiable) else v

    def pairs(ps) -> str:
        return ", ".join(f"<< {n} = {value(v)}" for n, v in sorted(ps, key=repr))

    parts = ([pairs(c.ungrouped)] if c.ungrouped else []) + [f"{{ {pairs(g)} }}" for g in sorted(c.groups, key=repr)]
    focus = " AND ".join(f"<< {x}" for x in sorted(c.focus))
    return (f"({focus})" if len(c.focus) > 1 and parts else focus) + (f" : {', '.join(parts)}" if parts else "")


def to_owl(c: Classifiable, name: str = ":expression") -> str:
    """An axiom in OWL's functional syntax. A group is the role group 609096000."""
    def value(v: object) -> str:
        return f":{v}" if isinstance(v, int) else inner(v) if isinstance(v, Classifiable) else v

    def some(p: tuple) -> str:
        return f"ObjectSomeValuesFrom(:{p[0]} {value(p[1])})" if not isinstance(p[1], str) else f'DataHasValue(:{p[0]} "{p[1].lstrip("#")}")'

    def joined(parts: list[str]) -> str:
        return parts[0] if len(parts) == 1 else f"ObjectIntersectionOf({' '.join(parts)})"

    def inner(x: Classifiable) -> str:
        parts = [f":{f}" for f in sorted(x.focus)] + [f"ObjectSomeValuesFrom(:609096000 {some(p)})" for p in sorted(x.ungrouped, key=repr)]
        return joined(parts + [f"ObjectSomeValuesFrom(:609096000 {joined([some(p) for p in sorted(g, key=repr)])})" for g in sorted(x.groups, key=repr)])

    return f"{'EquivalentClasses' if c.status == EQUIVALENT else 'SubClassOf'}({name} {inner(c)})"


def of_concept(t: Terminology, concept_id: int) -> Expression:
    """A primitive concept is itself with its attributes, a subtype; a defined one its parents with its attributes."""
    look = Lookup.of(t, {concept_id})
    defined = concept_id in look.defined
    focus = look.parents.get(concept_id, ()) if defined else (concept_id,)
    own = look.properties.get(concept_id, {})
    pairs = lambda ps: tuple((Concept(n), Concept(v)) for n, v in sorted(ps))
    return canonical(Expression(tuple(map(Concept, focus or (concept_id,))), pairs(own.get(0, ())), tuple(pairs(v) for g, v in own.items() if g), EQUIVALENT if defined else SUBTYPE))


def errors(e: Expression, look: Lookup) -> list[tuple[str, int]]:
    """Unknown and inactive concepts, and attributes that are none."""
    out = [("not-found", c) for c in sorted(concepts_of(e) - look.known)]
    out += [("inactive", c) for c in sorted((concepts_of(e) & look.known) - look.active)]

    def names(x: Expression):
        for n, v in (*x.ungrouped, *(p for g in x.groups for p in g)):
            yield n.id
            if isinstance(v, Expression):
                yield from names(v)

    return out + [("invalid-attribute", n) for n in sorted(set(names(e)) & look.known) if not (look.is_a(n, ids.CONCEPT_ATTRIBUTE) or look.is_a(n, ids.CONCRETE_ATTRIBUTE) or look.is_a(n, ids.UNAPPROVED_ATTRIBUTE))]


def replace_historical(t: Terminology, expressions: list[Expression], profile: str = "MIN") -> list[Expression]:
    """Expressions with each inactive concept, nested ones too, replaced by its target where the profile gives exactly one and that is active.

    One lookup serves all the expressions of a batch; its size goes with the concepts in them. A replaced concept loses its term.
    """
    from ..operators.history import replace_unambiguous

    named = set().union(*map(concepts_of, expressions))
    now = {r["id"]: r["now"] for r in replace_unambiguous(t, t.ids(*sorted(named)), profile).collect()} if named else {}

    def concept(c: Concept) -> Concept:
        new = now.get(c.id, c.id)
        return c if new == c.id else Concept(new)

    def whole(e: Expression) -> Expression:
        value = lambda v: concept(v) if isinstance(v, Concept) else whole(v) if isinstance(v, Expression) else v
        pairs = lambda ps: tuple((concept(n), value(v)) for n, v in ps)
        return Expression(tuple(map(concept, e.focus)), pairs(e.ungrouped), tuple(map(pairs, e.groups)), e.status)

    return [whole(e) for e in expressions]


def validate(t: Terminology, sources: list[str], *, rules: bool = True) -> list[list[tuple]]:
    """What is wrong with each expression: a parse error alone; else unknown, inactive and misplaced concepts; else, with `rules`, attributes
    that none of the focus concepts' domains allows and values outside an attribute's range. An empty list: valid."""
    from ..operators import mrcm

    out: list[list[tuple]] = []
    parsed: list[Expression | None] = []
    for source in sources:
        try:
            parsed.append(parse(source, check_ids=t.check_ids))
            out.append([])
        except ScgError as e:
            parsed.append(None)
            out.append([("parse-error", str(e))])
    good = [e for e in parsed if e is not None]
    if not good:
        return out
    look = Lookup.of(t, set().union(*map(concepts_of, good)))
    for k, e in enumerate(parsed):
        if e is not None:
            out[k] = errors(e, look)
    if not rules:
        return out

    def parts(e: Expression):
        """Focus concepts, and (attribute, value, grouped) of an expression and those nested in it."""
        pairs = [(n.id, v, False) for n, v in e.ungrouped] + [(n.id, v, True) for g in e.groups for n, v in g]
        yield [c.id for c in e.focus], pairs
        for _, v, _ in pairs:
            if isinstance(v, Expression):
                yield from parts(v)

    checked = {k: list(parts(e)) for k, e in enumerate(parsed) if e is not None and not out[k]}
    focus = sorted({c for ps in checked.values() for f, _ in ps for c in f})
    asked = sorted({(n, c) for ps in checked.values() for _, pairs in ps for n, v, _ in pairs for c in ([v.id] if isinstance(v, Concept) else [x.id for x in v.focus] if isinstance(v, Expression) else [])})
    allowed: dict[int, dict[int, set]] = {}
    if focus:
        for r in mrcm.allowed_attributes(t, t.ids(*focus)).collect():
            allowed.setdefault(r["id"], {}).setdefault(r["attribute_id"], set()).add(r["grouped"])
    bad = set()
    if asked:
        pairs = t.spark.createDataFrame(asked, "attribute_id bigint, value_id bigint")
        bad = {(r["attribute_id"], r["value_id"]) for r in mrcm.in_range(t, pairs).where("NOT ok").collect()}
    for k, ps in checked.items():
        for f, pairs in ps:
            for n, v, grouped in pairs:
                may = set().union(*(allowed.get(c, {}).get(n, set()) for c in f))
                if not may:
                    out[k].append(("attribute-not-in-domain", n))
                elif grouped and may == {False}:
                    out[k].append(("attribute-must-be-ungrouped", n))
                for c in [v.id] if isinstance(v, Concept) else [x.id for x in v.focus] if isinstance(v, Expression) else []:
                    if (n, c) in bad:
                        out[k].append(("value-out-of-range", n, c))
    return out
