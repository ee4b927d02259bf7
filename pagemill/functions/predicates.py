"""Predicates and accessors of element nodes, as columns over a node table (attrs: map<string,string>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dom import FORM_ASSOCIATED, FORMATTING

#: Element names.
SUBMITTABLE = ("button", "input", "keygen", "object", "select", "textarea")
MATHML_TEXT = ("mi", "mo", "mn", "ms", "mtext")
SVG_HTML = ("foreignObject", "foreignobject", "desc", "title")

#: The attributes of a row; of a node within an array, ``node["attrs"]`` is given instead.
ATTRS = "attrs"


def _of(node: Column | None, field: str) -> Column:
    """A field of a node of an array, or of the row."""
    return F.col(field) if node is None else node[field]


def has_attribute(name: str, attrs: Column | str = ATTRS) -> Column:
    return F.coalesce(F.map_contains_key(attrs, F.lit(name)), F.lit(False))


def get_attribute(name: str, attrs: Column | str = ATTRS) -> Column:
    """Its value, or null."""
    return F.try_element_at(attrs, F.lit(name))


def has_attribute_value(name: str, value: str, attrs: Column | str = ATTRS) -> Column:
    return F.coalesce(get_attribute(name, attrs) == value, F.lit(False))


def attribute_equals(name: str, value: str | None, attrs: Column | str = ATTRS) -> Column:
    """Case-sensitive; a missing attribute equals null only."""
    return get_attribute(name, attrs).eqNullSafe(F.lit(value))


def attribute_count(attrs: Column | str = ATTRS) -> Column:
    return F.coalesce(F.size(attrs), F.lit(0))


def attribute_missing_or_empty(name: str, attrs: Column | str = ATTRS) -> Column:
    return F.coalesce(get_attribute(name, attrs), F.lit("")) == ""


def set_attribute(name: str, value: Column | str, attrs: Column | str = ATTRS) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.map_concat(remove_attribute(name, attrs), F.create_map(F.lit(name), value.cast("string")))


def remove_attribute(name: str, attrs: Column | str = ATTRS) -> Column:
    return F.map_filter(attrs, lambda k, _: k != name)


def is_disabled(attrs: Column | str = ATTRS) -> Column:
    """By its own attribute alone."""
    return has_attribute("disabled", attrs)


def is_checked(attrs: Column | str = ATTRS) -> Column:
    return has_attribute("checked", attrs)


def has_element_name(name: str, namespace: str = "html", node: Column | None = None) -> Column:
    return F.coalesce(_of(node, "name") == name, F.lit(False)) & is_in_namespace(namespace, node)


def is_in_namespace(namespace: str, node: Column | None = None) -> Column:
    return F.coalesce(_of(node, "namespace") == namespace, F.lit(False))


def is_formatting(node: Column | None = None) -> Column:
    return is_in_namespace("html", node) & _of(node, "name").isin(*sorted(FORMATTING))


def is_form_associated(node: Column | None = None) -> Column:
    return is_in_namespace("html", node) & _of(node, "name").isin(*sorted(FORM_ASSOCIATED))


is_reassociateable = is_form_associated


def is_submittable(node: Column | None = None) -> Column:
    return is_in_namespace("html", node) & _of(node, "name").isin(*SUBMITTABLE)


def is_mathml_text_integration_point() -> Column:
    return is_in_namespace("math") & F.col("name").isin(*MATHML_TEXT)


def is_html_integration_point() -> Column:
    encoding = F.lower(F.coalesce(get_attribute("encoding"), F.lit("")))
    math = is_in_namespace("math") & (F.col("name") == "annotation-xml") & encoding.isin("text/html", "application/xhtml+xml")
    return math | (is_in_namespace("svg") & F.col("name").isin(*SVG_HTML))


def element_tag(verbose: bool = True, node: Column | None = None) -> Column:
    """<name k="v" ...>, or <name/> without attributes; just the name where not verbose."""
    name, attrs = _of(node, "name"), _of(node, ATTRS)
    if not verbose:
        return name
    said = F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e.key, F.lit('="'), e.value, F.lit('"'))), "")
    return F.when(F.size(attrs) > 0, F.concat(F.lit("<"), name, said, F.lit(">"))).otherwise(F.concat(F.lit("<"), name, F.lit("/>")))


def with_ancestor(nodes: DataFrame, name: str, among: DataFrame | None = None) -> DataFrame:
    """Adds has_ancestor: whether an element of this name holds the node. Elements are nested or apart, so one holds a node if the
    greatest last rank of those before it reaches it: a running maximum over a page's nodes, in one shuffle, without pairs.

    among: the table of all nodes, if nodes is a part of it; it is joined then by its rows' ranks."""
    every = nodes if among is None else among
    before = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(has_element_name(name), F.col("last"))).over(before)
    held = every.withColumn("has_ancestor", F.coalesce(reach >= F.col("pre"), F.lit(False)))
    return held if among is None else nodes.join(held.select("page_id", "pre", "has_ancestor"), ["page_id", "pre"], "left")
