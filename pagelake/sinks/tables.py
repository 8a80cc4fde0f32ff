"""Stage tables, manifests and project folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.store import task_store

SCHEMA_VERSION = "1.0"


def write_stage(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of one or more stages, partitioned by stage, so a later read of one stage lists only its files."""
    df.write.mode(mode).partitionBy("stage").parquet(path)


def write_files(df: DataFrame, folder: str, suffix: str = ".txt") -> None:
    """A text file for each row (stem, text); each task writes its own rows, to the file system that the folder's address names."""

    def save(rows) -> None:
        store, base = task_store(folder)
        for r in rows:
            path = f"{base}/{r['stem']}{suffix}"
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write((r["text"] or "").encode())

    df.select("stem", "text").foreachPartition(save)


def manifest_json(entries: DataFrame, export: str, imported: Column) -> DataFrame:
    """One row: a manifest of stem -> entry (JSON text), keys in order. The whole manifest is one value by its format."""
    pairs = F.array_sort(F.collect_list(F.struct("stem", "entry")))
    body = F.array_join(F.transform(pairs, lambda p: F.concat(F.regexp_extract(F.to_json(F.struct(p["stem"].alias("k"))), r'(?s)^\{"k":(.*)\}$', 1), F.lit(":"), p["entry"])), ",")
    head = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(F.lit(export).alias("name"), imported.alias("imported")).alias("export")))
    return entries.agg(body.alias("b")).select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"pages":{'), "b", F.lit("}}")).alias("manifest"))


def provenance(fields: dict[str, Column]) -> Column:
    """JSON of the fields that aren't null or empty, keys sorted."""
    names = sorted(fields)
    return F.to_json(F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), fields[n].cast("string"))]), lambda _, v: v.isNotNull() & (v != "")))
