"""Forms: associated controls, data sets, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.urls import is_http, resolve, url_encode_pairs
from .nodes import bound, by_url, deep, elements, first_of, paged, with_base


def page_forms(table: DataFrame, text: bool = False) -> DataFrame:
    """(page_id, forms), and base if the pages' URLs are known: every form of a page in tree order, with its controls within."""
    page = paged(table)
    base = [F.col("url").alias("base")] * ("url" in page.columns)
    return with_forms(page, text).select("page_id", *base, "forms")


def with_forms(page: DataFrame, text: bool = False) -> DataFrame:
    """Adds forms to parsed pages: every form of a page in tree order, with its controls within.

    A form is (idx, form_id, action, method, enctype, id, name, tag, controls); a control, a submittable element with that form as its owner, is
    (pre, name, control, type, attrs, in_datalist), and its deep text if asked for. All of it is one expression over the page's nodes."""

    def control(n: Column, lists: Column) -> Column:
        name, kind = (P.get_attribute(k, n["attrs"]) for k in ("name", "type"))
        inside = F.exists(lists, lambda a: (a["pre"] < n["pre"]) & (a["last"] >= n["pre"]))
        said = [deep(n).alias("text")] * text
        return F.struct(n["pre"].alias("pre"), name.alias("name"), n["name"].alias("control"), kind.alias("type"), n["attrs"].alias("attrs"), inside.alias("in_datalist"), *said)

    def form(f: Column, idx: Column, fields: Column) -> Column:
        attrs = [P.get_attribute(k, f["attrs"]).alias(k) for k in ("action", "method", "enctype", "id", "name")]
        own = F.transform(F.filter(fields, lambda c: c["owner"] == f["node_id"]), lambda c: c["control"])
        return F.struct(idx.alias("idx"), f["node_id"].alias("form_id"), *attrs, P.element_tag(node=f).alias("tag"), own.alias("controls"))

    owned = F.filter("nodes", lambda n: P.is_submittable(n) & n["form_owner_id"].isNotNull())
    fields = bound(elements("datalist"), lambda lists: F.transform(owned, lambda n: F.struct(n["form_owner_id"].alias("owner"), control(n, lists).alias("control"))))
    every = bound(fields, lambda found: F.transform(elements("form"), lambda f, i: form(f, i, found)))
    return page.withColumn("forms", every)


def controls(table: DataFrame) -> DataFrame:
    """(page_id, form_id, idx, pre, name, control, type, attrs, in_datalist) of page_forms(), a row for each control."""
    found = page_forms(table).select("page_id", F.explode("forms").alias("f"))
    return found.select("page_id", "f.form_id", F.posexplode("f.controls").alias("idx", "c")).select("page_id", "form_id", "idx", "c.*")


def first_form(forms: Column, pattern: str) -> Column:
    """The first of a page's forms whose id, name or action holds the pattern, in any case; null if there is none."""
    said = lambda f: F.lower(F.concat_ws("\n", f["id"], f["name"], f["action"]))
    return first_of(F.filter(forms, lambda f: F.contains(said(f), F.lit(pattern.lower()))))


def first_control(of: Column, name: str) -> Column:
    """The first of a form's controls with this name, in any case; null if there is none."""
    return first_of(F.filter(of, lambda c: F.lower(c["name"]) == name.lower()))


def with_value(of: Column, name: str, value: str) -> Column:
    """A form's controls with the value attribute of the first one of this name set."""
    at = F.array_position(F.transform(of, lambda c: F.coalesce(F.lower(c["name"]), F.lit(""))), name.lower())
    changed = lambda c: c.withField("attrs", P.set_attribute("value", value, c["attrs"]))
    return bound(at, lambda first: F.transform(of, lambda c, i: F.when(i + 1 == first, changed(c)).otherwise(c)))


def data_set(of: Column, standard: bool = False) -> Column:
    """array<struct<name,value,type>>: what a form's controls send, in tree order.

    Left out: controls in a datalist, disabled ones, buttons, unchecked boxes and radios, those without a name, objects,
    images, selects and files. A box or radio without a value is "on". A textarea gives its value attribute and types are compared as
    they are written; ``standard``, over page_forms(text=True), takes a textarea's text and types in any case.
    """

    def fits(c: Column) -> Column:
        is_input, kind = c["control"] == "input", _kind(c, standard)
        box = is_input & kind.isin("checkbox", "radio")
        skip = c["in_datalist"] | P.is_disabled(c["attrs"]) | c["control"].isin("button", "object", "select") | (box & ~P.is_checked(c["attrs"]))
        return ~(skip | (is_input & kind.isin("image", "file", "object")) | P.attribute_missing_or_empty("name", c["attrs"]))

    def entry(c: Column) -> Column:
        box = (c["control"] == "input") & _kind(c, standard).isin("checkbox", "radio")
        value = F.when(box & P.attribute_missing_or_empty("value", c["attrs"]), F.lit("on"))
        if standard:
            value = value.when(c["control"] == "textarea", c["text"])
        return F.struct(c["name"].alias("name"), value.otherwise(P.get_attribute("value", c["attrs"])).alias("value"), c["type"].alias("type"))

    return F.transform(F.filter(of, fits), entry)


def _kind(c: Column, standard: bool) -> Column:
    return F.lower(F.coalesce(c["type"], F.lit(""))) if standard else F.coalesce(c["type"], F.lit(""))


def submitted(table: DataFrame, values: dict[str, str] | None = None, standard: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """requests() of every form with these controls set: one projection over parsed pages, nothing is joined or shuffled unless URLs come from ``pages``."""
    found = page_forms(table, text=standard)
    found = found.select("page_id", *(c for c in found.columns if c == "base"), F.explode("forms").alias("f"))
    of = F.col("f.controls")
    for name, value in (values or {}).items():
        of = with_value(of, name, value)
    return _requests(with_base(found, pages).select("page_id", "f.form_id", "f.action", "f.method", "f.enctype", "base", data_set(of, standard).alias("data")))


def find_control(found: DataFrame, name: str) -> DataFrame:
    """The first control of each form with this name, in any case."""
    rest = [c for c in found.columns if c not in ("page_id", "form_id")]
    first = found.where(F.lower("name") == name.lower()).groupBy("page_id", "form_id").agg(F.min_by(F.struct(*rest), "pre").alias("_f"))
    return first.select("page_id", "form_id", "_f.*")


def set_control_value(found: DataFrame, name: str, value: str) -> DataFrame:
    """found with the value attribute of each form's first control of this name set."""
    first = find_control(found, name).select("page_id", "form_id", F.col("pre").alias("_p"))
    joined = found.join(first, ["page_id", "form_id"], "left")
    return joined.withColumn("attrs", F.when(F.col("pre") == F.col("_p"), P.set_attribute("value", value)).otherwise(F.col("attrs"))).drop("_p")


def data_sets(found: DataFrame, standard: bool = False) -> DataFrame:
    """(page_id, form_id, data) of rows of controls(), gathered by form: data as data_set() gives it."""
    rows = F.array_sort(F.collect_list(F.struct(*[c for c in ("pre", "name", "control", "type", "attrs", "in_datalist", "text") if c in found.columns])), lambda a, b: a["pre"] - b["pre"])
    return found.groupBy("page_id", "form_id").agg(rows.alias("of")).select("page_id", "form_id", data_set(F.col("of"), standard).alias("data"))


def requests(forms: DataFrame, sets: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, form_id, method, url, content_type, body, error): what submitting each form would send.

    An empty action is the document's URL; GET puts the data in the query, POST in the body as
    application/x-www-form-urlencoded. Anything else, and URLs that aren't HTTP, gives an error instead of a request.
    pages gives the documents' URLs where they weren't parsed with the forms.
    """
    return _requests(with_base(forms, pages).select("page_id", "form_id", "action", "method", "enctype", "base").join(sets, ["page_id", "form_id"], "left"))


def request(action: Column, method: Column, enctype: Column, base: Column, data: Column) -> Column:
    """struct<method, url, content_type, body, error>: what a form sends, as requests() says."""
    empty = F.expr("cast(array() as array<struct<name:string,value:string,type:string>>)")
    verb = F.upper(F.when(F.coalesce(method, F.lit("")) == "", "get").otherwise(method))
    url = F.when(F.coalesce(action, F.lit("")) == "", base).otherwise(resolve(base, action))
    kind = F.when(F.coalesce(enctype, F.lit("")) == "", "application/x-www-form-urlencoded").otherwise(F.lower(enctype))
    given = F.struct(verb.alias("verb"), url.alias("url"), kind.alias("kind"), url_encode_pairs(F.coalesce(data, empty)).alias("payload"))

    def said(x: Column) -> Column:
        post, get = x["verb"] == "POST", x["verb"] == "GET"
        error = (
            F.when(x["url"].isNull(), "action can't be resolved").when(~is_http(x["url"]), "scheme isn't http")
            .when(~(post | get), "method isn't supported").when(post & (x["kind"] != "application/x-www-form-urlencoded"), "enctype isn't supported")
        )
        ok = error.isNull()
        query = F.concat(F.regexp_replace(x["url"], r"[?#].*$", ""), F.lit("?"), x["payload"])
        return F.struct(
            F.when(ok, x["verb"]).alias("method"), F.when(ok & get, query).when(ok, x["url"]).alias("url"),
            F.when(ok & post, x["kind"]).alias("content_type"), F.when(ok & post, x["payload"]).alias("body"), error.alias("error"),
        )

    return bound(given, said)


def _requests(df: DataFrame) -> DataFrame:
    sent = request(F.col("action"), F.col("method"), F.col("enctype"), F.col("base"), F.col("data"))
    return df.withColumn("_sent", sent).select("page_id", "form_id", "_sent.*")


def submit(sent: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds target_page_id: the stored page of each request's URL, if there is one."""
    return sent.join(by_url(pages, "url", "target_page_id"), "url", "left")


def describe(data: Column) -> Column:
    """name=value lines of a data set, for people."""
    return F.array_join(F.transform(data, lambda e: F.concat(e["name"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\n")
