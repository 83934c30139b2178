"""Expression constraints: a parser to a small tree, and the tree as DataFrames.

Constraints compose at the grain of descriptions: a value is a set of rows (description_id, concept_id) of the substrate
until an operator needs concepts. An operator over (A MINUS B) is its value over A without its value over B. Clauses that
the language has and that are not supported raise EclError("not-supported") when evaluated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import is_valid, kind as kind_of
from ..functions.locales import dialect
from ..operators import graph, history, text
from ..operators.members import compare, components, wildcard
from . import ids
from .model import Terminology
from .storage import members_of, present


class EclError(ValueError):
    """kind: syntax-error, invalid-code, not-found, invalid-value or not-supported."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass
class Node:
    kind: str
    args: dict = field(default_factory=dict)

    def __getattr__(self, name: str):
        try:
            return self.__dict__["args"][name]
        except KeyError:
            raise AttributeError(name) from None


_OPERATORS = ["<<!", ">>!", "!!>", "!!<", "<<", ">>", "<!", ">!", "<", ">"]
_COMPARE = ["<=", ">=", "!=", "<>", "=", "<", ">"]
#: Keywords of filters, in any case.
_KEYWORDS = {x.lower(): x for x in ("term", "type", "typeId", "dialect", "dialectId", "active", "moduleId", "effectiveTime", "language", "definitionStatus", "definitionStatusId", "id")}


class Parser:
    def __init__(self, source: str, check_ids: bool = True):
        self.s, self.i, self.check_ids = source, 0, check_ids

    def fail(self, what: str) -> EclError:
        return EclError("syntax-error", f"{what} at {self.i}: {self.s[self.i : self.i + 20]!r}")

    def space(self) -> None:
        m = re.compile(r"(?:\s|/\*.*?\*/)*", re.S).match(self.s, self.i)
        self.i = m.end()

    def peek(self, token: str, *, word: bool = False) -> bool:
        self.space()
        end = self.i + len(token)
        same = self.s[self.i : end].lower() == token.lower() if word else self.s.startswith(token, self.i)
        return same and not (word and re.match(r"\w", self.s[end : end + 1] or " "))

    def take(self, token: str, *, word: bool = False) -> bool:
        if self.peek(token, word=word):
            self.i += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise self.fail(f"expected {token!r}")

    def match(self, pattern: str) -> str | None:
        self.space()
        m = re.compile(pattern).match(self.s, self.i)
        if m:
            self.i = m.end()
            return m[0]
        return None

    def parse(self) -> Node:
        out = self.expression()
        self.space()
        if self.i < len(self.s):
            raise self.fail("unexpected")
        return out

    def expression(self) -> Node:
        left = self.sub()
        if self.peek(":"):
            self.take(":")
            return Node("refined", {"of": left, "by": self.refinement()})
        if self.peek("."):
            names = []
            while self.take("."):
                names.append(self.sub())
            return Node("dotted", {"of": left, "names": names})
        parts = [left]
        for kind, tokens in (("and", ("AND", ",")), ("or", ("OR",)), ("minus", ("MINUS",))):
            while any(self.take(x, word=x.isalpha()) for x in tokens):
                parts.append(self.sub())
                if kind == "minus":
                    break
            if len(parts) > 1:
                return Node(kind, {"parts": parts})
        return left

    def sub(self) -> Node:
        op = next((x for x in _OPERATORS if self.take(x)), None)
        member, fields = self.take("^"), None
        if member and self.take("["):
            fields = self.match(r"[^\]]*")
            self.need("]")
        if self.take("("):
            focus = Node("nested", {"of": self.expression()})
            self.need(")")
        elif self.take("*"):
            focus = Node("any")
        else:
            focus = self.concept()
        out = Node("sub", {"op": op, "member": member, "fields": fields, "focus": focus, "filters": []})
        while self.take("{{"):
            out.filters.append(self.filter())
            self.need("}}")
        return out

    def concept(self) -> Node:
        digits = self.match(r"[0-9]+")
        if digits is None:
            if self.match(r"[A-Za-z][\w.-]*#"):
                self.match(r'"[^"]*"|[\w.-]+')
                return Node("alternate")
            raise self.fail("expected a concept")
        if not 6 <= len(digits) <= 18:
            raise self.fail("an identifier has 6 to 18 digits")
        if self.check_ids and (not is_valid(digits) or kind_of(digits) != "concept"):
            raise EclError("invalid-code", digits)
        if self.take("|"):
            if self.match(r"[^|]*") is None or not self.take("|"):
                raise self.fail("expected '|'")
        return Node("concept", {"id": int(digits)})

    # refinements

    def refinement(self) -> Node:
        return self.joined(self.sub_refinement)

    def joined(self, one) -> Node:
        parts = [one()]
        for kind, tokens in (("and", ("AND", ",")), ("or", ("OR",))):
            while any(self.take(x, word=x.isalpha()) for x in tokens):
                parts.append(one())
            if len(parts) > 1:
                return Node(kind, {"parts": parts})
        return parts[0]

    def sub_refinement(self) -> Node:
        at = self.i
        card = self.cardinality()
        if self.take("{"):
            inner = self.joined(self.sub_attribute)
            self.need("}")
            return Node("group", {"of": inner, "cardinality": card})
        self.i = at
        if self.peek("("):
            try:
                self.need("(")
                inner = self.refinement()
                self.need(")")
                if not self.compare_ahead():
                    return inner
            except EclError as e:
                if e.kind != "syntax-error":
                    raise
            self.i = at
        return self.attribute()

    def compare_ahead(self) -> bool:
        return any(self.peek(x) for x in _COMPARE)

    def sub_attribute(self) -> Node:
        at = self.i
        if self.peek("("):
            try:
                self.need("(")
                inner = self.joined(self.sub_attribute)
                self.need(")")
                if not self.compare_ahead():
                    return Node("set", {"of": inner})  # attribute sets in a group are not evaluated
            except EclError as e:
                if e.kind != "syntax-error":
                    raise
            self.i = at
        return self.attribute()

    def cardinality(self) -> tuple[int, int | None] | None:
        text = self.match(r"\[\s*\d+\s*(?:\.\.|\s+to\s+)\s*(?:\d+|\*)\s*\]")
        if text is None:
            return None
        low, high = re.findall(r"\d+|\*", text)
        return int(low), None if high == "*" else int(high)

    def attribute(self) -> Node:
        card = self.cardinality()
        reverse = bool(self.match(r"[Rr](?=[\s<>*^(0-9])"))
        name = self.sub()
        op = next((x for x in _COMPARE if self.take(x)), None)
        if op is None:
            raise self.fail("expected a comparison")
        op = "!=" if op == "<>" else op
        value = self.literal()
        if value is None:
            if op not in ("=", "!="):
                raise self.fail("expected a number")
            value = self.sub()
        return Node("attribute", {"cardinality": card, "reverse": reverse, "name": name, "op": op, "value": value})

    def literal(self) -> Node | None:
        if (x := self.match(r"#[+-]?\d+(?:\.\d+)?")) is not None:
            return Node("number", {"value": float(x[1:])})
        if (x := self.match(r'"(?:[^"\\]|\\.)*"')) is not None:
            return Node("string", {"value": re.sub(r"\\(.)", r"\1", x[1:-1])})
        if (x := self.match(r"(?i:true|false)\b")) is not None:
            return Node("flag", {"value": x.lower() == "true"})
        return None

    # filters

    def filter(self) -> Node:
        if self.take("+"):
            if not self.match(r"(?i:HISTORY)"):
                raise self.fail("expected HISTORY")
            name = self.match(r"[-_](?i:MIN|MOD|MAX)\b")
            subset = None
            if not name and self.take("("):
                subset = self.expression()
                self.need(")")
            return Node("history", {"name": name[1:].upper() if name else None, "subset": subset})
        letter = self.match(r"[DdCcMm](?=\s)") or "D"
        items = [self.filter_item()]
        while self.take(","):
            items.append(self.filter_item())
        return Node({"D": "descriptions", "C": "concepts", "M": "members"}[letter.upper()], {"items": items})

    def acceptability(self) -> list[int] | None:
        """A set of acceptabilities in parentheses, by token or id; None if there is none."""
        at = self.i
        if not self.take("("):
            return None
        out = []
        while not self.take(")"):
            if (word := self.match(r"(?i:accept\w*|prefer\w*)")) is not None:
                out.append(ids.PREFERRED if word.lower().startswith("prefer") else ids.ACCEPTABLE)
            elif self.match(r"(?=[0-9])") is not None:
                out.append(self.concept().id)
            else:
                self.i = at
                raise self.fail("expected an acceptability")
        if not out:
            raise self.fail("expected an acceptability")
        return out

    def id_set(self, dialect: bool) -> list[Node] | None:
        """Concepts in parentheses without an operator between them, each of a dialect with acceptabilities if need be; None where there is no such set."""
        at, out = self.i, []
        if not self.take("("):
            return None
        while self.match(r"(?=[0-9])") is not None:
            focus = self.concept()
            x = Node("expression", {"of": Node("sub", {"op": None, "member": False, "fields": None, "focus": focus, "filters": []})})
            if dialect and self.peek("("):
                x.args["acceptability"] = self.acceptability()
            out.append(x)
        if self.take(")") and (len(out) > 1 or (out and dialect)):
            return out
        self.i = at
        return None

    def filter_item(self) -> Node:
        name = self.match(r"[A-Za-z]+")
        op = next((x for x in _COMPARE if self.take(x)), None)
        if name is None or op is None:
            raise self.fail("expected a filter")
        name, op = _KEYWORDS.get(name.lower(), name), "!=" if op == "<>" else op
        dialect = name in ("dialect", "dialectId")
        if name == "active" and (x := self.match(r"[01](?=\s*(?:,|\}))")) is not None:
            return Node("item", {"name": name, "op": op, "values": [Node("flag", {"value": x == "1"})], "kinds": ["match"]})
        if (several := self.id_set(dialect)) is not None:
            return Node("item", {"name": name, "op": op, "values": self.accepted(several) if dialect else several, "kinds": ["match"] * len(several)})
        values, kinds = [], []
        many = self.peek("(") and not self.peek("(<")
        at = self.i
        if many:
            self.take("(")
        while True:
            k = self.match(r"(?i:match|wild)(?=\s*:)")
            if k:
                self.take(":")
                if self.take("("):
                    while (x := self.literal()) is not None:
                        values.append(x), kinds.append(k.lower())
                    self.need(")")
                    if not many or self.peek(")"):
                        break
                    continue
            x = self.literal()
            if x is None and (w := self.match(r"[A-Za-z][\w-]*(?=[\s,)}(])")) is not None:
                x = Node("word", {"value": w.lower()})
            elif x is None:
                if many and values:
                    break
                if many:
                    self.i, many = at, False
                x = Node("expression", {"of": self.sub()})
            if dialect and many and self.peek("("):
                x.args["acceptability"] = self.acceptability()
            values.append(x), kinds.append((k or "match").lower())
            if not many or self.peek(")"):
                break
        if many:
            self.need(")")
        return Node("item", {"name": name, "op": op, "values": self.accepted(values) if dialect else values, "kinds": kinds})

    def accepted(self, dialects: list[Node]) -> list[Node]:
        """Acceptabilities behind the whole filter are those of the dialects without their own."""
        common = self.acceptability()
        for x in dialects:
            x.args.setdefault("acceptability", common)
        return dialects


def parse(source: str, *, check_ids: bool = True) -> Node:
    return Parser(source, check_ids).parse()


def is_valid_ecl(source: str, *, check_ids: bool = True) -> bool:
    try:
        parse(source, check_ids=check_ids)
        return True
    except EclError:
        return False


@dataclass
class Rows:
    """Rows of the substrate; and if they are a difference, its two sides. everything: all rows."""

    df: DataFrame
    sides: tuple[Rows, Rows] | None = None
    everything: bool = False


_TYPES = {"syn": ids.SYNONYM, "fsn": ids.FSN, "def": ids.DEFINITION}
class Evaluator:
    def __init__(self, t: Terminology):
        self.t = t
        self.s = t.substrate.select("description_id", "concept_id")

    def rows(self, source: str | Node) -> Rows:
        return self.eval(parse(source, check_ids=self.t.check_ids) if isinstance(source, str) else source)

    def concepts(self, source: str | Node) -> DataFrame:
        """Distinct ids of the concepts that a constraint selects."""
        return self.rows(source).df.select(F.col("concept_id").alias("id")).distinct()

    def realise(self, x: Rows) -> DataFrame:
        return members_of(x.df.select(F.col("concept_id").alias("id")).distinct())

    def lift(self, concepts: DataFrame, *, given: bool = False) -> Rows:
        """The rows of a set of concepts, computed or given as ids."""
        concepts = concepts if given else members_of(concepts)
        return Rows(self.s.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").select("description_id", "concept_id"))

    def all(self) -> Rows:
        return Rows(self.s, everything=True)

    def both(self, a: Rows, b: Rows) -> Rows:
        if a.everything or b.everything:
            return b if a.everything else a
        return Rows(a.df.join(members_of(b.df.select("description_id")), "description_id", "left_semi").select("description_id", "concept_id"))

    def either(self, a: Rows, b: Rows) -> Rows:
        return Rows(a.df.union(b.df).distinct())

    def without(self, a: Rows, b: Rows) -> Rows:
        return Rows(a.df.join(members_of(b.df.select("description_id")), "description_id", "left_anti").select("description_id", "concept_id"), (a, b))

    def eval(self, n: Node) -> Rows:
        return getattr(self, f"on_{n.kind}")(n)

    def on_and(self, n: Node) -> Rows:
        out = self.eval(n.parts[0])
        for p in n.parts[1:]:
            out = self.both(out, self.eval(p))
        return out

    def on_or(self, n: Node) -> Rows:
        out = self.eval(n.parts[0])
        for p in n.parts[1:]:
            out = self.either(out, self.eval(p))
        return out

    def on_minus(self, n: Node) -> Rows:
        return self.without(self.eval(n.parts[0]), self.eval(n.parts[1]))

    def on_nested(self, n: Node) -> Rows:
        return self.eval(n.of)

    def on_refined(self, n: Node) -> Rows:
        return self.both(self.eval(n.of), self.eval(n.by))

    def on_dotted(self, n: Node) -> Rows:
        current = self.realise(self.eval(n.of))
        for name in n.names:
            current = members_of(graph.targets(self.t, current, present(self.t.edge, "type_id", self.realise(self.eval(name))).toDF("id")))
        return self.lift(current)

    # focus, operators, filters

    def on_sub(self, n: Node) -> Rows:
        focus, members = n.focus, [f for f in n.filters if f.kind == "members"]
        if n.fields is not None:
            raise EclError("not-supported", "field selection")
        if focus.kind == "alternate":
            raise EclError("not-supported", "alternate identifiers")
        if n.member:
            refsets = None if focus.kind == "any" else (self.t.ids(focus.id).toDF("refset_id") if focus.kind == "concept" else present(self.t.refset_member, "refset_id", self.realise(self.eval(focus))))
            out = self.members(refsets, members) if members else self.lift(components(self.of_refsets(self.t.member, refsets)))
            if n.op:
                out = self.operate(n.op, out, nested=True)
        elif members:
            raise EclError("not-supported", "a member filter without ^")
        elif focus.kind == "any":
            out = self.any(n.op)
        elif focus.kind == "concept":
            if n.op in ("!!>", "!!<"):
                raise EclError("not-supported", f"{n.op} needs an expression in parentheses")
            own = self.t.ids(focus.id)
            out = self.apply(n.op, own) if n.op else self.lift(own, given=True)
        else:
            out = self.eval(focus)
            if n.op:
                out = self.operate(n.op, out, nested=True)
        for f in n.filters:
            if f.kind == "history":
                refsets = self.realise(self.eval(f.subset)) if f.subset else history.profile(self.t, f.name)
                out = self.lift(history.with_historical(self.t, self.realise(out), refsets))
            elif f.kind != "members":
                out = self.both(out, self.filtered(f, narrowed=not out.everything))
        return out

    def any(self, op: str | None) -> Rows:
        if op in (None, "<<", ">>", "<<!", ">>!"):
            return self.all()
        if op in ("<", "<!"):
            return self.apply("<", self.t.ids(ids.ROOT))
        raise EclError("not-supported", f"{op} *")

    def operate(self, op: str, x: Rows, *, nested: bool) -> Rows:
        if x.sides and op not in ("!!>", "!!<"):
            return self.without(self.operate(op, x.sides[0], nested=nested), self.operate(op, x.sides[1], nested=nested))
        return self.apply(op, self.realise(x))

    def apply(self, op: str, s: DataFrame) -> Rows:
        t = self.t
        if op == "<<":
            found = graph.all_children(t, s)
        elif op == "<":
            found = t.tc.join(s.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()
        elif op == "<!":
            found = graph.children(t, s)
        elif op == "<<!":
            found = graph.children(t, s).union(s.select("id")).distinct()
        elif op == ">>":
            found = graph.all_parents(t, s)
        elif op == ">":
            found = graph.all_parents(t, s).join(s.select("id"), "id", "left_anti")
        elif op == ">!":
            found = graph.parents(t, s)
        elif op == ">>!":
            found = graph.parents(t, s).union(s.select("id")).distinct()
        elif op == "!!<":
            found = graph.leaves(t, s)
        else:
            found = graph.top_leaves(t, s)
        return self.lift(found)

    def filtered(self, f: Node, *, narrowed: bool) -> Rows:
        sub = self.t.substrate
        if f.kind == "concepts":
            for x in f.items:
                if x.name != "active":
                    raise EclError("not-supported", f"a concept filter on {x.name}")
                sub = sub.where(F.col("concept_active") == self.flag(x))
        else:
            if any(x.name == "term" for x in f.items):
                sub = text.searchable(self.t)
            for x in f.items:
                sub = self.described(sub, x, narrowed)
        return Rows(sub.select("description_id", "concept_id"))

    def flag(self, x: Node) -> bool:
        v = x.values[0]
        value = v.value if v.kind == "flag" else (v.kind == "number" and v.value == 1) or (v.kind == "word" and v.value == "1")
        if x.op not in ("=", "!="):
            raise EclError("invalid-value", f"{x.name} {x.op}")
        return value if x.op == "=" else not value

    def described(self, sub: DataFrame, x: Node, narrowed: bool) -> DataFrame:
        if x.name == "term":
            out = F.lit(False)
            for v, how in zip(x.values, x.kinds, strict=True):
                if v.kind != "string":
                    raise EclError("syntax-error", "a term is quoted")
                if how == "wild":
                    if not narrowed and not re.search(r"[^\W_]", v.value):
                        raise EclError("invalid-value", "a wildcard without letters over all descriptions")
                    one = F.lower("folded").rlike(wildcard(text.fold(v.value).lower(), single=False))
                else:
                    one = text.matches(v.value)
                    one = F.lit(False) if one is None else one
                out = out | one
            return sub.where(out if x.op == "=" else ~out)
        if x.name in ("type", "typeId"):
            if x.name == "type":
                if any(v.value not in _TYPES for v in x.values):
                    raise EclError("invalid-value", "a description type is syn, fsn or def")
                types = self.t.ids(*[_TYPES[v.value] for v in x.values]).toDF("type_id")
            else:
                types = self.values(x, sub, "type_id").select(F.col("id").alias("type_id"))
            return sub.join(types, "type_id", "left_semi" if x.op == "=" else "left_anti")
        if x.name in ("dialect", "dialectId"):
            if x.op != "=":
                raise EclError("not-supported", "dialect !=")
            out = None
            for v in x.values:
                if v.kind == "word":
                    if dialect(v.value) is None:
                        raise EclError("not-found", f"unknown dialect {v.value}")
                    refset = self.t.ids(dialect(v.value))
                else:
                    refset = self.named(v, self.t.member, "refset_id")
                m = self.t.member.join(refset.select(F.col("id").alias("refset_id")), "refset_id", "left_semi")
                if v.args.get("acceptability"):
                    m = m.where(F.col("acceptability_id").isin(v.acceptability))
                m = m.select(F.col("referenced_component_id").alias("description_id"))
                out = m if out is None else out.union(m)
            return sub.join(members_of(out.distinct()), "description_id", "left_semi")
        if x.name == "active":
            return sub.where(F.col("description_active") == self.flag(x))
        raise EclError("not-supported", f"a description filter on {x.name}")

    def values(self, x: Node, rows: DataFrame | None = None, column: str = "") -> DataFrame:
        """The concepts of all values of a filter; with rows, those that these have in a column of few values."""
        if any(v.kind != "expression" for v in x.values):
            raise EclError("invalid-value", f"{x.name} takes concepts")
        given = [v.of.focus.id for v in x.values if self.plain(v.of)]
        sets = [self.t.ids(*given)] if given else []
        sets += [self.named(v, rows, column) for v in x.values if not self.plain(v.of)]
        out = sets[0]
        for one in sets[1:]:
            out = out.union(one)
        return out

    def plain(self, n: Node) -> bool:
        return n.kind == "sub" and n.focus.kind == "concept" and not n.op and not n.member and not n.filters

    def named(self, v: Node, rows: DataFrame | None = None, column: str = "") -> DataFrame:
        """The concepts of a value: one given by its id need not be described. Of computed ones, with rows, those that these have in a column of few values."""
        if self.plain(v.of):
            return self.t.ids(v.of.focus.id)
        found = self.realise(self.eval(v.of))
        return found if rows is None else present(rows, column, found).toDF("id")

    def of_refsets(self, rows: DataFrame, refsets: DataFrame | None) -> DataFrame:
        return rows.where("refset_id IS NOT NULL") if refsets is None else rows.join(refsets, "refset_id", "left_semi")

    def members(self, refsets: DataFrame | None, filters: list[Node]) -> Rows:
        out = None
        for f in filters:
            rows = self.of_refsets(self.t.refset_member, refsets)
            if not any(x.name == "active" for x in f.items):
                rows = rows.where("active")
            for x in f.items:
                rows = self.member_where(rows, x)
            one = self.lift(components(rows))
            out = one if out is None else self.both(out, one)
        return out

    def member_where(self, rows: DataFrame, x: Node) -> DataFrame:
        name = re.sub(r"(?<!^)(?=[A-Z])", "_", x.name).lower()
        name = {"module_id": "module_id", "target_component": "target_component_id"}.get(name, name)
        if name == "active":
            return rows.where(F.col("active") == self.flag(x))
        if name not in rows.columns:
            raise EclError("invalid-value", f"members have no field {x.name}")
        c, first = F.col(name), x.values[0]
        if first.kind == "string" and name.endswith("effective_time"):
            for v in x.values:
                rows = rows.where(compare(c, x.op, F.to_date(F.lit(v.value), "yyyyMMdd")))
            return rows
        if first.kind == "string":
            one = F.lit(False)
            for v, how in zip(x.values, x.kinds, strict=True):
                one = one | F.coalesce(c.rlike(wildcard(v.value)) if how == "wild" else c.startswith(v.value), F.lit(False))
            return rows.where(one if x.op == "=" else ~one)
        if first.kind == "number":
            return rows.where(compare(c, x.op, first.value))
        if first.kind == "flag":
            return rows.where(compare(c, x.op, first.value))
        if first.kind == "expression":
            values = self.values(x).select(F.col("id").alias(name))
            return rows.join(values, name, "left_semi") if x.op == "=" else rows.where(c.isNotNull()).join(values, name, "left_anti")
        raise EclError("invalid-value", f"a value for {x.name}")

    # attributes

    def types(self, name: Node, root: int) -> list[int]:
        """The attribute's types: those of its concepts that are below the root of attributes. A model has a few hundred of these, read once."""
        known = self.t.attributes(root)
        if name.focus.kind == "concept" and not name.op and not name.member and not name.filters:
            out = [name.focus.id] if name.focus.id in known else []
        elif name.focus.kind == "any" and not name.op and not name.member and not name.filters:
            out = sorted(known)
        else:
            below = self.realise(self.eval(name)).where(F.col("id").isin(sorted(known)))
            out = sorted(r["id"] for r in below.collect())
        if not out:
            raise EclError("invalid-value", "no such attribute")
        return out

    def on_attribute(self, n: Node) -> Rows:
        t, wild = self.t, n.name.kind == "sub" and n.name.focus.kind == "any" and not n.name.op and not n.name.member
        if n.value.kind == "number":
            if wild or n.reverse:
                raise EclError("not-supported", "a number for this attribute")
            found = self.numeric(n).select(F.col("source_id").alias("id")).distinct()
            return self.lift(found)
        if n.value.kind in ("string", "flag"):
            self.types(n.name, ids.CONCRETE_ATTRIBUTE)
            raise EclError("not-supported", "text and truth values")
        anything = n.value.focus.kind == "any" and not n.value.op and not n.value.member and not n.value.filters
        if wild and (anything or n.op == "!=" or n.cardinality or n.reverse):
            raise EclError("not-supported", "this use of the wildcard attribute")
        types = self.types(n.name, ids.CONCEPT_ATTRIBUTE)
        if n.reverse:
            if n.cardinality or n.op == "!=":
                raise EclError("not-supported", "a reversed attribute with cardinality or !=")
            return self.lift(graph.targets(t, self.realise(self.eval(n.value)), t.ids(*types)))
        edges = t.edge.where(F.col("type_id").isin(types))
        value = self.eval(n.value)
        if n.op == "!=":
            if n.cardinality:
                raise EclError("not-supported", "cardinality with !=")
            s = self.realise(value).select(F.col("id").alias("destination_id"))
            return self.lift(edges.join(s, "destination_id", "left_anti").select(F.col("source_id").alias("id")).distinct())
        if n.cardinality:
            low, high = n.cardinality
            if high is not None and high < low:
                raise EclError("invalid-value", "cardinality")
            counted = self.counted(edges, types, low, high)
            return self.lift(counted) if low == 0 else self.both(self.lift(counted), self.has(edges, types, value, anything))
        return self.has(edges, types, value, anything)

    def has(self, edges: DataFrame, types: list[int], value: Rows, anything: bool) -> Rows:
        source = F.col("source_id").alias("id")
        if anything:
            return self.lift(edges.select(source).distinct())
        if value.sides:
            a, b = value.sides
            hit = edges if a.everything else edges.join(self.realise(a).toDF("destination_id"), "destination_id", "left_semi")
            n = len(types)
            barred = edges.join(self.realise(b).toDF("destination_id"), "destination_id", "left_semi").groupBy("source_id").agg(F.countDistinct("type_id").alias("n")).where(F.col("n") == n)
            return self.lift(hit.select(source).distinct().join(barred.select(source), "id", "left_anti"))
        return self.lift(edges.join(self.realise(value).toDF("destination_id"), "destination_id", "left_semi").select(source).distinct())

    def counted(self, edges: DataFrame, types: list[int], low: int, high: int | None) -> DataFrame:
        """Described concepts of which every type has a number of distinct targets in range."""
        n = len(types)
        c = edges.groupBy("source_id", "type_id").agg(F.countDistinct("destination_id").alias("c"))
        fits = (F.col("c") >= low) & (F.lit(True) if high is None else F.col("c") <= high)
        per = c.groupBy(F.col("source_id").alias("id")).agg(F.sum(fits.cast("int")).alias("fit"), F.count("*").alias("some"))
        every = self.s.select(F.col("concept_id").alias("id")).distinct().join(per, "id", "left")
        absent = n - F.coalesce("some", F.lit(0))
        return every.where(F.coalesce("fit", F.lit(0)) + (absent if low == 0 else F.lit(0)) == n).select("id")

    def numeric(self, n: Node) -> DataFrame:
        types = self.types(n.name, ids.CONCRETE_ATTRIBUTE)
        return self.t.literal.where(F.col("type_id").isin(types)).where(compare(F.col("number"), n.op, n.value.value))

    def on_group(self, n: Node) -> Rows:
        if n.cardinality:
            raise EclError("not-supported", "group cardinality")
        parts = [n.of] if n.of.kind == "attribute" else (n.of.parts if n.of.kind == "and" else None)
        if parts is None or any(p.kind != "attribute" for p in parts):
            raise EclError("not-supported", "OR and nesting in a group")
        found = None
        for p in parts:
            if p.reverse or p.cardinality or p.value.kind in ("string", "flag"):
                raise EclError("not-supported", "this attribute in a group")
            one = self.grouped(p).where("relationship_group <> 0").select("source_id", "relationship_group").distinct()
            found = one if found is None else found.join(one, ["source_id", "relationship_group"], "left_semi")
        return self.lift(found.select(F.col("source_id").alias("id")).distinct())

    def grouped(self, p: Node) -> DataFrame:
        if p.value.kind == "number":
            return self.numeric(p)
        types = self.types(p.name, ids.CONCEPT_ATTRIBUTE)
        edges = self.t.edge.where(F.col("type_id").isin(types))
        if p.op == "=" and p.value.focus.kind == "any" and not p.value.op and not p.value.member:
            return edges
        value = self.eval(p.value)
        if p.op == "=" and value.sides:
            a, b = (self.realise(x).toDF("destination_id") for x in value.sides)
            hit = edges if value.sides[0].everything else edges.join(a, "destination_id", "left_semi")
            return hit.join(b, "destination_id", "left_anti")
        return edges.join(self.realise(value).toDF("destination_id"), "destination_id", "left_semi" if p.op == "=" else "left_anti")


def concepts(t: Terminology, source: str) -> DataFrame:
    return Evaluator(t).concepts(source)


def expand(t: Terminology, source: str) -> DataFrame:
    """description_id, concept_id and term of the synonyms that a constraint selects, whatever is active."""
    rows = Evaluator(t).rows(source).df
    return t.substrate.where(F.col("type_id") == ids.SYNONYM).join(members_of(rows.select("description_id")), "description_id", "left_semi").select("description_id", "concept_id", "term")


def expand_preferred(t: Terminology, source: str, refsets: list[int]) -> DataFrame:
    """One row a concept: its preferred synonym, if the constraint selects that."""
    from ..operators.lookups import preferred_synonym

    return expand(t, source).join(members_of(preferred_synonym(t, refsets).select("description_id")), "description_id", "left_semi")


def expand_historic(t: Terminology, source: str) -> DataFrame:
    """expand(), and the synonyms of the concepts that have associations to what it selects."""
    ev = Evaluator(t)
    old = history.source_historical(t, ev.concepts(source))
    more = t.substrate.where(F.col("type_id") == ids.SYNONYM).join(members_of(old.select(F.col("id").alias("concept_id"))), "concept_id", "left_semi").select("description_id", "concept_id", "term")
    return expand(t, source).union(more).distinct()


def contains(t: Terminology, concept_id: int, source: str) -> bool:
    """Whether a constraint selects a concept."""
    return not concepts(t, source).where(F.col("id") == concept_id).isEmpty()


def intersect(t: Terminology, given: DataFrame, source: str) -> DataFrame:
    return given.select("id").distinct().join(members_of(concepts(t, source)), "id", "left_semi")


def count(t: Terminology, source: str) -> DataFrame:
    return concepts(t, source).agg(F.count("*").alias("n"))
