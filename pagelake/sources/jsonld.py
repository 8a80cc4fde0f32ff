"""Catalog exports in JSON-LD: checked, unwrapped, exploded to items and photos.

What is wrong with a whole file is in `error`; what is wrong with one photo is in its `status`, so one bad entry
doesn't lose the others.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.operators.catalog import TITLE_PROPERTIES, is_absolute, normal_path, path_status

# Limits of an export, and keys of a title in order.
MOST_BYTES, MOST_DEPTH, MOST_NODES = 64 * 1024 * 1024, 32, 50_000
SUFFIXES = (".json", ".jsonld")
TITLE_KEYS = (TITLE_PROPERTIES[0], "title", "dc:title", TITLE_PROPERTIES[1])


#: One step of a JSON text: a string, another scalar, a bracket that opens, one that closes, a comma or colon, or the end.
_STEP = re.compile(
    r'[ \t\n\r]*+(?:("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity)|([\[{])|([\]}])|([,:])|(\Z))'
)


def budget(text: str) -> tuple[int, int, str | None]:
    """Depth, nodes (objects and arrays) and error of a JSON text, read step by step: no tree is built, and reading ends with the first error."""
    if len(text) > MOST_BYTES or (not text.isascii() and len(text) * 4 > MOST_BYTES and len(text.encode(errors="surrogatepass")) > MOST_BYTES):
        return 0, 0, "too large"
    at, depth, nodes, open_, want = int(text.startswith("\ufeff")), 0, 0, [], "value"
    while True:
        m = _STEP.match(text, at)
        kind, at = (m.lastindex, m.end()) if m else (0, at)
        if kind == 1 and want in ("key", "first key"):
            want = "colon"
        elif kind in (1, 2) and want in ("value", "first value"):
            if not open_:
                return (0, 1, "scalar root") if _STEP.match(text, at) and _STEP.match(text, at).lastindex == 6 else (0, 0, "no JSON")
            want = "next"
        elif kind == 3 and want in ("value", "first value"):
            nodes += 1
            if nodes > MOST_NODES:
                return depth, nodes, "too many nodes"
            if len(open_) > depth:
                depth = len(open_)
                if depth > MOST_DEPTH:
                    return depth, nodes, "too deep"
            open_.append(m[3])
            want = "first key" if m[3] == "{" else "first value"
        elif kind == 4 and open_ and m[4] == {"{": "}", "[": "]"}[open_[-1]] and want in ("next", "first key", "first value"):
            open_.pop()
            want = "next" if open_ else "end"
        elif kind == 5 and m[5] == ":" and want == "colon":
            want = "value"
        elif kind == 5 and m[5] == "," and want == "next":
            want = "key" if open_[-1] == "{" else "value"
        elif kind == 6 and want == "end":
            return depth, nodes, None
        else:
            return 0, 0, "no JSON"


@F.pandas_udf(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("nodes", T.IntegerType()), T.StructField("error", T.StringType())]))
def json_budget(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([budget(t or "") for t in text], columns=["depth", "nodes", "error"])


def canonical(text: str | None) -> str | None:
    """A JSON text with sorted keys, no spaces and letters as they are; null if it is none."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return pd.Series([canonical(t) for t in text], dtype=object)


def group_id(node: str, index: int) -> str:
    return f"{hashlib.sha256(canonical(node).encode()).hexdigest()[:12]}:{index}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, folder, text and error of export files; too large ones are listed, not read."""
    f = spark.read.format("binaryFile").load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    error = F.when(~(name.endswith(SUFFIXES[0]) | name.endswith(SUFFIXES[1])), "file type").when(F.col("length") > MOST_BYTES, "too large")
    clean = F.regexp_replace("path", "^file:/+", "/")
    return f.select(clean.alias("path"), F.regexp_replace(clean, "/[^/]*$", "").alias("folder"), F.when(error.isNull(), F.decode("content", "UTF-8")).alias("text"), error.alias("error"))


def _list(v: Column) -> Column:
    """A VARIANT as an array: an array's elements, or the one value."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), v.try_cast("array<variant>")).when(v.isNotNull(), F.array(v))


def _title(node: Column, index: Column) -> Column:
    fields = node.try_cast("map<string,variant>")

    def text(key: str) -> Column:
        v = F.get(_list(fields[key]), F.lit(0))
        inner = F.coalesce(v.try_cast("map<string,variant>")["@value"], v)
        return F.when(F.schema_of_variant(inner) == "STRING", F.nullif(F.trim(inner.try_cast("string")), F.lit("")))

    return F.coalesce(*[text(k) for k in TITLE_KEYS], F.concat(F.lit("Item "), (index + 1).cast("string")))


def items(exports: DataFrame) -> DataFrame:
    """path, folder, idx, title, node (JSON), photos (array of VARIANT) of every item in the sound exports (path, folder, text)."""
    e = exports.withColumn("b", json_budget("text")).where("b.error is null").withColumn("v", F.try_parse_json("text"))
    graph = F.coalesce(F.when(F.schema_of_variant("v").startswith("OBJECT"), _list(F.col("v").try_cast("map<string,variant>")["@graph"])), _list(F.col("v")))
    n = e.select("path", "folder", F.posexplode(graph).alias("idx", "node")).where(F.schema_of_variant("node").startswith("OBJECT"))
    kinds = F.transform(_list(F.col("node").try_cast("map<string,variant>")["@type"]), lambda t: t.try_cast("string"))
    n = n.where(F.exists(kinds, lambda t: F.coalesce((t == "Item") | t.endswith("#Item"), F.lit(False))))
    photos = F.col("node").try_cast("map<string,variant>")["photo"]
    kind = F.schema_of_variant(photos)
    return n.select("path", "folder", "idx", _title(F.col("node"), F.col("idx")).alias("title"), F.to_json("node").alias("node"), F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), _list(photos)).alias("photos"))


def photos(found: DataFrame, home: str = "/home/user") -> DataFrame:
    """path, idx, title, photo_index, path_rel, resolved, mimetype, checksum, page, status of every photo entry.

    status: 'ok', 'not_object', 'no_path', 'needs_folder' (skipped with a warning), or why its path is refused.
    """
    p = found.select("path", "folder", "idx", "title", F.posexplode("photos").alias("photo_index", "p"))
    p = p.withColumn("m", F.when(F.schema_of_variant("p").startswith("OBJECT"), F.col("p").try_cast("map<string,variant>")))
    text = lambda k: F.when(F.schema_of_variant(F.col("m")[k]) == "STRING", F.col("m")[k].try_cast("string"))
    rel = F.replace(text("path"), F.lit("\\"), F.lit("/"))
    p = p.withColumns({"path_rel": rel, "mimetype": F.coalesce(text("mimetype"), F.lit("")), "checksum": F.coalesce(text("checksum"), F.lit("")), "number": F.col("m")["page"].try_cast("double")})
    r = F.col("path_rel")
    status = (
        F.when(F.col("m").isNull(), "not_object").when(F.coalesce(F.trim(r), F.lit("")) == "", "no_path").when(r.startswith("//"), "unc").when(is_absolute(r), path_status(r, home))
        .when(F.col("folder").isNull(), "needs_folder").when(F.array_contains(F.split(r, "/"), ".."), "escapes").otherwise("ok")
    )
    page = F.when(F.col("number").isNotNull(), F.col("number").cast("int")).when(F.col("mimetype") == "application/pdf", 0)
    resolved = F.when(is_absolute(r), normal_path(r)).otherwise(normal_path(F.concat_ws("/", "folder", "path_rel")))
    return p.select("path", "idx", "title", "photo_index", "path_rel", resolved.alias("resolved"), "mimetype", "checksum", page.alias("page"), status.alias("status"))
