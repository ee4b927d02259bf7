"""Templates of nested records over parsed pages, compiled to one expression.

A template is plain Python: dicts and lists of constants, selectors and terminals.

    [each(el("article"), {"title": el("h1").first_text(), "paras": [each(el("p"), {"text": deep_text()})]})]

- ``el("li").starts_with("id", "result_")`` selects elements below a domain, in document order.
- A terminal (first_text, deep_text, attr) is a string or null: of the domain itself, or of the first element selected.
- ``scope(selector)`` in a list of members makes the first match the domain of the members after it, up to the next scope;
  ``scope()`` goes back to the object's own. Without a match the domain is the object's.
- ``each(selector, element)`` in a list gives one element for every match, none where there is none.
- ``root(selector, template)`` narrows the whole page to the first match, if there is one.

A page's nodes are an array in document order, in which what is below a node is a slice; selectors filter slices, iteration
maps over them. So a template is one projection over parsed pages, without a join or a shuffle, and lists come in
document order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.nodes import below, bound, deep, first_of, paged, texts


@dataclass(frozen=True)
class Selector:
    """Elements of a name (None: the domain itself) that meet every condition."""

    name: str | None = None
    tests: tuple = ()

    def equals(self, attr: str, value: str) -> Selector:
        return replace(self, tests=(*self.tests, ("equals", attr, value)))

    def starts_with(self, attr: str, value: str) -> Selector:
        return replace(self, tests=(*self.tests, ("starts", attr, value)))

    def children_count(self, n: int) -> Selector:
        return replace(self, tests=(*self.tests, ("children", n, None)))

    def text_equals(self, value: str) -> Selector:
        return replace(self, tests=(*self.tests, ("text", value, None)))

    def first_text(self) -> Terminal:
        return Terminal(self, "first_text")

    def deep_text(self) -> Terminal:
        return Terminal(self, "deep_text")

    def attr(self, name: str) -> Terminal:
        return Terminal(self, "attr", name)

    def matches(self, node: Column) -> Column:
        out = (node["kind"] == "element") & (node["name"] == self.name)
        for kind, a, b in self.tests:
            out &= {
                "equals": lambda: P.has_attribute_value(a, b, node["attrs"]),
                "starts": lambda: F.coalesce(P.get_attribute(a, node["attrs"]).startswith(b), F.lit(False)),
                "children": lambda: node["n_children"] == a,
                "text": lambda: deep(node) == a,
            }[kind]()
        return out

    def among(self, domain: Column) -> Column:
        """All matches below a domain."""
        return F.filter(below(domain), self.matches)


@dataclass(frozen=True)
class Terminal:
    selector: Selector
    kind: str
    arg: str | None = None


@dataclass(frozen=True)
class Scope:
    selector: Selector | None


@dataclass(frozen=True)
class Each:
    selector: Selector
    element: object = field(hash=False)


@dataclass(frozen=True)
class Root:
    selector: Selector
    template: object = field(hash=False)


def el(name: str) -> Selector:
    return Selector(name)


def first_text() -> Terminal:
    return Selector().first_text()


def deep_text() -> Terminal:
    return Selector().deep_text()


def scope(selector: Selector | None = None) -> Scope:
    return Scope(selector)


def each(selector: Selector, element) -> Each:
    return Each(selector, element)


def root(selector: Selector, template) -> Root:
    return Root(selector, template)


def members(template) -> list[tuple[Selector | None, str, object]]:
    """(scope, name, value) of an object: a dict, or a list of scopes and (name, value) pairs under the key None of a dict's
    place. Of repeated names the first counts."""
    pairs = list(template.items()) if isinstance(template, dict) else list(template.entries)
    out, now, seen = [], None, set()
    for p in pairs:
        if isinstance(p, Scope):
            now = p.selector
            continue
        name, value = p
        if not isinstance(name, str):
            raise ValueError(f"a member's name is a string, not {name!r}")
        if name not in seen:
            out.append((now, name, value))
            seen.add(name)
    if not out:
        raise ValueError("an object without members has no type")
    return out


@dataclass(frozen=True)
class Obj:
    """An object with scopes: obj(scope(...), ("title", ...), scope(), ("img", ...))."""

    entries: tuple = field(hash=False)


def obj(*entries) -> Obj:
    return Obj(entries)


def _is_literal(t) -> bool:
    return t is None or isinstance(t, (str, int, float, bool))


def _check(t, in_array: bool = False) -> None:
    if isinstance(t, Each):
        if not in_array:
            raise ValueError("each() belongs in a list")
        if t.selector.name is None:
            raise ValueError("each() needs a named selector")
        _check(t.element)
    elif isinstance(t, list):
        if not t:
            raise ValueError("an empty list has no type")
        for x in t:
            _check(x, True)
    elif isinstance(t, (dict, Obj)):
        for s, _, v in members(t):
            if s is not None and s.name is None:
                raise ValueError("scope() needs a named selector, or none")
            _check(v)
    elif isinstance(t, Terminal):
        if in_array:
            raise ValueError("a list holds each(), objects, lists and constants, not bare terminals")
        if t.selector.name is None and t.selector.tests:
            raise ValueError("conditions need a named selector")
    elif not _is_literal(t):
        raise ValueError(f"{t!r} can't be in a template")


def _literal(t) -> Column:
    return F.lit(t).cast("string") if t is None else F.lit(t)


def _terminal(t: Terminal, node: Column) -> Column:
    if t.kind == "attr":
        return P.get_attribute(t.arg, node["attrs"])
    return deep(node) if t.kind == "deep_text" else first_of(texts(node))["text"]


def _object(parts: list, domain: Column) -> Column:
    """The members, each under its scope; a scope's domain is found once for all of its members."""
    scopes = list(dict.fromkeys(s for s, _, _ in parts if s is not None))

    def within(left: list, own: dict) -> Column:
        if not left:
            return F.struct(*[value(t, own[s]).alias(n) for s, n, t in parts])
        s = left[0]
        return bound(F.coalesce(first_of(s.among(domain)), domain), lambda d: within(left[1:], {**own, s: d}))

    return within(scopes, {None: domain})


def _each(t: Each, domain: Column) -> Column:
    return F.transform(t.selector.among(domain), lambda n: value(t.element, n))


def value(t, domain: Column) -> Column:
    """The value of a template's part over a domain, a node."""
    if _is_literal(t):
        return _literal(t)
    if isinstance(t, list):
        return F.concat(*[_each(x, domain) if isinstance(x, Each) else F.array(value(x, domain)) for x in t])
    if isinstance(t, (dict, Obj)):
        return _object(members(t), domain)
    return _terminal(t, domain) if t.selector.name is None else bound(first_of(t.selector.among(domain)), lambda n: _terminal(t, n))


def extract(table: DataFrame, template) -> DataFrame:
    """(page_id, record) of each page: the template's value over its document. ValueError where the template is malformed.

    ``table`` is of parsed pages, or a whole flat node table.
    """
    base = template.template if isinstance(template, Root) else template
    if not isinstance(base, (dict, list, Obj)):
        raise ValueError("a template is an object or a list")
    _check(base)
    document = F.col("nodes")[0]
    if isinstance(template, Root):
        document = F.coalesce(first_of(template.selector.among(document)), document)
    return paged(table).select("page_id", bound(document, lambda d: value(base, d)).alias("record"))
