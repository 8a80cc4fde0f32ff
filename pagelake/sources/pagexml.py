"""Page-layout XML to nested rows, in the JVM: from_xml does the parsing, expressions the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the format's namespace.
NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
_EQUIV = "array<struct<_index:string,Unicode:string>>"
_COORDS = "struct<_points:string,_conf:string>"
SCHEMA = f"""struct<_xmlns:string,_pcGtsId:string,
 Metadata:struct<Creator:string,Created:string,LastChange:string,MetadataItem:array<struct<_type:string,_name:string,_value:string,_date:string>>>,
 Page:struct<_imageFilename:string,_imageWidth:string,_imageHeight:string,
  ReadingOrder:struct<OrderedGroup:struct<_id:string,RegionRefIndexed:array<struct<_index:string,_regionRef:string>>>>,
  TextRegion:array<struct<_id:string,_type:string,_custom:string,Coords:{_COORDS},TextEquiv:{_EQUIV},
   TextLine:array<struct<_id:string,Coords:{_COORDS},Baseline:{_COORDS},TextEquiv:{_EQUIV}>>>>>>""".replace("\n", "")


def points(text: Column) -> Column:
    """'x,y x,y' to an array of points; null for none."""
    pair = lambda p: F.split(p, ",")
    return F.transform(F.filter(F.split(text, r"\s+"), lambda p: p != ""), lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("int").alias("x"), F.get(pair(p), F.lit(1)).try_cast("int").alias("y")))


def _equivs(e: Column) -> Column:
    return F.transform(F.coalesce(e, F.array().cast(_EQUIV)), lambda t: F.struct(F.coalesce(t["_index"], F.lit("0")).try_cast("int").alias("index"), F.coalesce(t["Unicode"], F.lit("")).alias("unicode")))


def parse(df: DataFrame, xml: str = "xml") -> DataFrame:
    """df with page (struct) and error (null, or why a text is no such document).

    Reading order: by index; without one the regions' own. Attributes that miss become '' or their defaults.
    """
    d = df.withColumn("_x", F.from_xml(F.col(xml), SCHEMA, {"mode": "PERMISSIVE", "rowTag": "PcGts", "ignoreNamespace": "true"}))
    page, regions = F.col("_x.Page"), F.coalesce(F.col("_x.Page.TextRegion"), F.array().cast("array<struct<_id:string,_type:string,_custom:string,Coords:" + _COORDS + ",TextEquiv:" + _EQUIV + ",TextLine:array<struct<_id:string,Coords:" + _COORDS + ",Baseline:" + _COORDS + ",TextEquiv:" + _EQUIV + ">>>>"))
    line = lambda t: F.struct(F.coalesce(t["_id"], F.lit("")).alias("id"), points(t["Coords"]["_points"]).alias("polygon"), points(t["Baseline"]["_points"]).alias("baseline"), _equivs(t["TextEquiv"]).alias("equivs"))
    region = lambda r: F.struct(
        F.coalesce(r["_id"], F.lit("")).alias("id"), F.coalesce(r["_type"], F.lit("other")).alias("type"), F.coalesce(r["_custom"], F.lit("")).alias("custom"), points(r["Coords"]["_points"]).alias("polygon"),
        r["Coords"]["_conf"].try_cast("double").alias("confidence"), _equivs(r["TextEquiv"]).alias("equivs"), F.coalesce(F.transform(r["TextLine"], line), F.array()).alias("lines"),
    )
    group = F.col("_x.Page.ReadingOrder.OrderedGroup")
    refs = F.transform(F.array_sort(F.transform(group["RegionRefIndexed"], lambda r, i: F.struct(F.coalesce(r["_index"], F.lit("0")).try_cast("int").alias("k"), i.alias("i"), F.coalesce(r["_regionRef"], F.lit("")).alias("ref")))), lambda r: r["ref"])
    steps = F.transform(F.filter(F.coalesce("_x.Metadata.MetadataItem", F.array().cast("array<struct<_type:string,_name:string,_value:string,_date:string>>")), lambda m: m["_type"] == "processingStep"), lambda m: F.struct(F.coalesce(m["_name"], F.lit("")).alias("name"), F.coalesce(m["_value"], F.lit("")).alias("value"), m["_date"].try_cast("timestamp").alias("date")))
    made = F.struct(
        F.coalesce(page["_imageFilename"], F.lit("")).alias("image_filename"), page["_imageWidth"].try_cast("int").alias("image_width"), page["_imageHeight"].try_cast("int").alias("image_height"),
        F.col("_x.Metadata.Creator").alias("creator"), F.col("_x.Metadata.Created").try_cast("timestamp").alias("created"), F.col("_x.Metadata.LastChange").try_cast("timestamp").alias("last_change"), steps.alias("steps"),
        F.transform(regions, region).alias("regions"), F.coalesce(refs, F.transform(regions, lambda r: F.coalesce(r["_id"], F.lit("")))).alias("reading_order"), F.coalesce(group["_id"], F.lit("reading-order")).alias("group_id"), F.col("_x._pcGtsId").alias("pc_gts_id"),
    )
    bad_points = F.exists("_p.regions", lambda r: r["polygon"].isNull() | F.exists(r["polygon"], lambda p: p["x"].isNull() | p["y"].isNull()))
    error = (
        F.when(F.col(xml).isNull() | F.col("_x").isNull() | ~F.coalesce(F.col(xml).rlike(r"<(\w+:)?PcGts[\s>]"), F.lit(False)), "not a page document").when(~F.contains(F.col(xml), F.lit(NAMESPACE)), "another namespace")
        .when(F.col("_x.Metadata").isNull(), "no metadata").when(F.col("_p.created").isNull() | F.col("_p.last_change").isNull(), "timestamp").when(page.isNull(), "no page")
        .when(F.col("_p.image_width").isNull() | F.col("_p.image_height").isNull(), "image size").when(F.coalesce(bad_points, F.lit(False)), "coordinates").when(F.exists("_p.regions", lambda r: F.exists(r["equivs"], lambda t: t["index"].isNull())), "text index")
    )
    d = d.withColumn("_p", made).withColumn("error", error)
    return d.withColumn("page", F.when(F.col("error").isNull(), F.col("_p"))).drop("_x", "_p")


def page_text(page: Column, stage_index: int, glue: str = "\n\n") -> Column:
    """A stage's non-empty region texts in reading order."""
    listed = F.transform(page["reading_order"], lambda i: F.get(F.filter(page["regions"], lambda r: r["id"] == i), F.lit(0)))
    rest = F.filter(page["regions"], lambda r: ~F.array_contains(page["reading_order"], r["id"]))
    texts = F.transform(F.filter(F.concat(listed, rest), lambda r: r.isNotNull()), lambda r: F.get(F.filter(r["equivs"], lambda t: t["index"] == stage_index), F.lit(0))["unicode"])
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), glue)
