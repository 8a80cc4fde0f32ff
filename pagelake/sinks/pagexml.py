"""Nested page rows to page-layout XML bytes: element order and layout are fixed, so equal pages give equal bytes.

What an element has is said once, in ELEMENTS; one emitter follows that for any of them.
"""

from __future__ import annotations

import datetime as dt
import xml.etree.ElementTree as ET
from collections.abc import Callable
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.sources.pagexml import NAMESPACE

XSI = "http://www.w3.org/2001/XMLSchema-instance"


def given(value: Any) -> bool:
    """Whether a field is there: no null, NaN, NaT, empty text or empty list."""
    return len(value) > 0 if hasattr(value, "__len__") else value is not None and not pd.isna(value)


def utc(t: dt.datetime) -> str:
    """A time as UTC with a Z; one without a zone is UTC already. Fractions only if there are any."""
    moment = pd.Timestamp(t)
    moment = moment.tz_localize("UTC") if moment.tzinfo is None else moment.tz_convert("UTC")
    return moment.tz_localize(None).isoformat() + "Z"


def corners(points: Any) -> str:
    return " ".join("{x},{y}".format_map(p) for p in points if p is not None)


class Element(NamedTuple):
    """attributes: (name, field, as text, always there). children: (element, rows of it from its parent's row). text: field and as text."""

    attributes: tuple[tuple[str, str, Callable[[Any], str], bool], ...] = ()
    children: tuple[tuple[str, Callable[[dict], list[dict]]], ...] = ()
    text: tuple[str, Callable[[Any], str]] | None = None


def _same(row: dict) -> list[dict]:
    return [row]


def _rows(field: str) -> Callable[[dict], list[dict]]:
    return lambda row: list(row[field]) if given(row.get(field)) else []


def _with(field: str) -> Callable[[dict], list[dict]]:
    return lambda row: [row] if given(row.get(field)) else []


def _ordered(page: dict) -> list[dict]:
    """The reading order, or else the regions' own, with its places."""
    ids = page["reading_order"] if given(page.get("reading_order")) else [r["id"] for r in page["regions"]]
    return [{"index": k, "id": i} for k, i in enumerate(ids)]


def _by_index(row: dict) -> list[dict]:
    return sorted(_rows("equivs")(row), key=lambda e: e["index"])


ELEMENTS = {
    "PcGts": Element((("pcGtsId", "pc_gts_id", str, False),), (("Metadata", _same), ("Page", _same))),
    "Metadata": Element(children=(("Creator", _same), ("Created", _same), ("LastChange", _same), ("MetadataItem", _rows("steps")))),
    "Creator": Element(text=("creator", str)),
    "Created": Element(text=("created", utc)),
    "LastChange": Element(text=("last_change", utc)),
    "MetadataItem": Element((("type", "type", str, True), ("name", "name", str, True), ("value", "value", str, True), ("date", "date", utc, False))),
    "Page": Element(
        (("imageFilename", "image_filename", str, True), ("imageWidth", "image_width", str, True), ("imageHeight", "image_height", str, True)),
        (("ReadingOrder", lambda page: [page] if _ordered(page) else []), ("TextRegion", _rows("regions"))),
    ),
    "ReadingOrder": Element(children=(("OrderedGroup", _same),)),
    "OrderedGroup": Element((("id", "group_id", str, True),), (("RegionRefIndexed", _ordered),)),
    "RegionRefIndexed": Element((("index", "index", str, True), ("regionRef", "id", str, True))),
    "TextRegion": Element((("id", "id", str, True), ("type", "type", str, True), ("custom", "custom", str, False)), (("Coords", _same), ("TextLine", _rows("lines")), ("TextEquiv", _by_index))),
    "TextLine": Element((("id", "id", str, True),), (("Coords", lambda line: [{"polygon": line["polygon"]}]), ("Baseline", _with("baseline")), ("TextEquiv", _by_index))),
    "Coords": Element((("points", "polygon", corners, True), ("conf", "confidence", lambda x: str(float(x)), False))),
    "Baseline": Element((("points", "baseline", corners, True),)),
    "TextEquiv": Element((("index", "index", str, True),), (("Unicode", _same),)),
    "Unicode": Element(text=("unicode", str)),
}
#: What stands for a field that isn't given.
ELSE = {"group_id": "reading-order", "type": "processingStep"}


def emit(name: str, row: dict, up: ET.Element | None = None) -> ET.Element:
    shape, tag = ELEMENTS[name], f"{{{NAMESPACE}}}{name}"
    node = ET.Element(tag) if up is None else ET.SubElement(up, tag)
    for attribute, field, text, always in shape.attributes:
        value = row.get(field)
        if not given(value) and field in ELSE:
            value = ELSE[field]
        if always or given(value):
            node.set(attribute, text(value))
    if shape.text:
        field, text = shape.text
        node.text = None if row[field] is None else text(row[field])
    for child, rows in shape.children:
        for r in rows(row):
            emit(child, r, node)
    return node


def render(page: dict) -> bytes:
    """One page as XML; texts by index, the regions' own order if no reading order is given."""
    ET.register_namespace("", NAMESPACE)
    ET.register_namespace("xsi", XSI)
    root = emit("PcGts", page)
    known = dict(root.attrib)
    root.attrib.clear()
    root.attrib.update({f"{{{XSI}}}schemaLocation": f"{NAMESPACE} {NAMESPACE}/pagecontent.xsd"} | known)
    ET.indent(root, space="  ")
    return ET.tostring(root, encoding="utf-8", xml_declaration=True) + b"\n"


@F.pandas_udf(T.BinaryType())
def to_page_xml(page: pd.DataFrame) -> pd.Series:
    return pd.Series([render(row) for row in page.to_dict("records")])


def page_xml(page: Column, kind: T.StructType) -> Column:
    """What render gives, as an expression without Python, for pages of a struct type; fields that the type lacks aren't given.

    Times of the session's zone come as UTC. A null polygon has no points.
    """
    field = lambda row, t, f: (row[f], t[f].dataType) if f in t.names else (F.lit(None).cast("string"), T.StringType())
    text = lambda row, t, f: field(row, t, f)[0].cast("string")
    return F.concat(F.lit("<?xml version='1.0' encoding='utf-8'?>\n"), _document(page, kind, field, text), F.lit("\n")).cast("binary")


def _escaped(c: Column, also: tuple[tuple[str, str], ...] = ()) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *also):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _attribute(name: str, c: Column, otherwise: str | None = None) -> Column:
    """The attribute, or, for a null, one with another value or none."""
    quoted = F.concat(F.lit(f' {name}="'), _escaped(c, (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;"))), F.lit('"'))
    return F.coalesce(quoted, F.lit("" if otherwise is None else f' {name}="{otherwise}"'))


def _element(name: str, depth: int, attributes: list[Column], children: Column | None = None, inner: Column | None = None, bare: Column | None = None) -> Column:
    """An element on a line of its own, with lines of children (bare: whether there are none) or with a text. Each part stands in the expression once."""
    line = "\n" + "  " * depth
    head = F.concat(F.lit(f"{line if depth else ''}<{name}"), *attributes)
    if inner is not None:
        return F.concat(head, F.coalesce(F.concat(F.lit(">"), _escaped(F.nullif(inner, F.lit(""))), F.lit(f"</{name}>")), F.lit(" />")))
    if children is None:
        return F.concat(head, F.lit(" />"))
    full = F.concat(F.lit(">"), children, F.lit(f"{line}</{name}>"))
    return F.concat(head, full if bare is None else F.when(bare, " />").otherwise(full))


def _number(c: Column) -> Column:
    """A double as Python writes it, from 0.00001 to 10,000,000 as far as the engine's digits are the same."""
    said, e = c.cast("double").cast("string"), lambda k: F.concat(F.lit(r"E-"), F.lit(str(k)))
    small = F.concat(F.lit("0.000"), F.regexp_replace(F.regexp_replace(said, "E-4$", ""), r"\.0?(?=$)|\.", ""))
    tiny = F.regexp_replace(F.regexp_replace(said, r"(\.0)?E-([5-9])$", "e-0$2"), r"(\.0)?E-(\d\d+)$", "e-$2")
    return F.when(F.endswith(said, e(4)), small).when(F.contains(said, F.lit("E-")), tiny).otherwise(said)


def _moment(c: Column) -> Column:
    t = F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    fraction = F.when(F.unix_micros(t) % 1_000_000 != 0, F.date_format(t, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def _document(page: Column, kind: T.StructType, field: Callable, text: Callable) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))

    def each(row: Column, t: T.StructType, name: str, make: Callable[[Column, T.DataType], Column]) -> Column:
        rows, type_ = field(row, t, name)
        return F.coalesce(F.array_join(F.transform(rows, lambda r: make(r, type_.elementType)), ""), F.lit("")) if isinstance(type_, T.ArrayType) else F.lit("")

    def points(row: Column, t: T.StructType, name: str) -> Column:
        rows, type_ = field(row, t, name)
        at = lambda p, c: F.coalesce(p[c].cast("string"), F.lit("None"))
        return F.array_join(F.transform(F.filter(rows, lambda p: p.isNotNull()), lambda p: F.concat(at(p, "x"), F.lit(","), at(p, "y"))), " ") if isinstance(type_, T.ArrayType) else F.lit("")

    def equivs(row: Column, t: T.StructType, depth: int) -> Column:
        rows, type_ = field(row, t, "equivs")
        if not isinstance(type_, T.ArrayType):
            return F.lit("")
        in_order = F.array_sort(F.transform(rows, lambda e, i: F.struct(e["index"].alias("k"), i.alias("i"), e["unicode"].cast("string").alias("u"))))
        made = F.transform(in_order, lambda e: _element("TextEquiv", depth, [_attribute("index", e["k"].cast("string"), "None")], _element("Unicode", depth + 1, [], inner=e["u"])))
        return F.coalesce(F.array_join(made, ""), F.lit(""))

    def line(row: Column, t: T.StructType) -> Column:
        base = points(row, t, "baseline")
        given_ = F.size(field(row, t, "baseline")[0]) > 0 if "baseline" in t.names else F.lit(False)
        baseline = F.when(given_, _element("Baseline", 4, [_attribute("points", base, "")])).otherwise("")
        return _element("TextLine", 3, [_attribute("id", text(row, t, "id"), "None")], F.concat(_element("Coords", 4, [_attribute("points", points(row, t, "polygon"), "")]), baseline, equivs(row, t, 4)))

    def region(row: Column, t: T.StructType) -> Column:
        sure = text(row, t, "confidence")
        own = [_attribute("id", text(row, t, "id"), "None"), _attribute("type", some(text(row, t, "type")), ELSE["type"]), _attribute("custom", some(text(row, t, "custom")))]
        coords = _element("Coords", 3, [_attribute("points", points(row, t, "polygon"), ""), _attribute("conf", _number(F.nullif(sure, F.lit("NaN"))))])
        return _element("TextRegion", 2, own, F.concat(coords, each(row, t, "lines", line), equivs(row, t, 3)))

    def step(row: Column, t: T.StructType) -> Column:
        date = _attribute("date", _moment(row["date"])) if "date" in t.names else F.lit("")
        return _element("MetadataItem", 2, [_attribute("type", some(text(row, t, "type")), ELSE["type"]), _attribute("name", text(row, t, "name"), "None"), _attribute("value", text(row, t, "value"), "None"), date])

    time = lambda name, f: _element(name, 2, [], inner=_moment(page[f]))
    metadata = _element("Metadata", 1, [], F.concat(_element("Creator", 2, [], inner=page["creator"].cast("string")), time("Created", "created"), time("LastChange", "last_change"), each(page, kind, "steps", step)))
    ids = F.transform(page["regions"], lambda r: r["id"].cast("string"))
    order = F.when(F.size(page["reading_order"]) > 0, page["reading_order"]).otherwise(ids) if "reading_order" in kind.names else ids
    refs = F.array_join(F.transform(order, lambda x, i: _element("RegionRefIndexed", 4, [_attribute("index", i.cast("string")), _attribute("regionRef", x, "None")])), "")
    group = _element("OrderedGroup", 3, [_attribute("id", some(text(page, kind, "group_id")), ELSE["group_id"])], refs)
    reading = F.when(F.size(order) > 0, _element("ReadingOrder", 2, [], group)).otherwise("")
    size = [_attribute(a, text(page, kind, f), "None") for a, f in (("imageFilename", "image_filename"), ("imageWidth", "image_width"), ("imageHeight", "image_height"))]
    bare = (F.coalesce(F.size(order), F.lit(0)) <= 0) & (F.coalesce(F.size(page["regions"]), F.lit(0)) <= 0)
    sheet = _element("Page", 1, size, F.concat(reading, each(page, kind, "regions", region)), bare=bare)
    names = F.lit(f' xmlns="{NAMESPACE}" xmlns:xsi="{XSI}" xsi:schemaLocation="{NAMESPACE} {NAMESPACE}/pagecontent.xsd"')
    return _element("PcGts", 0, [names, _attribute("pcGtsId", some(text(page, kind, "pc_gts_id")))], F.concat(metadata, sheet))
