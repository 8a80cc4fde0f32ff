"""Project folders and texts handed over between applications by files in a folder."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.sources.files import _local, stem_of
from pagelake.store import dealt, file_system, stash, task_store

HANDOVER = "version int, source string, target string, kind string, created string, body_file string"
#: How long a handover counts.
KEPT_SECONDS = 3600
#: Names of run files, and how many of these a task reads, about.
RUN_FILE, TASK_FILES = r"\d{8}-\d{6}-[0-9a-f]{8}\.json", 5_000


def _slugs(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders below root/projects that hold a file, hidden ones left out. A project's own file is looked for first: folders of many files aren't listed for it."""
    hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name)
    fs, base = file_system(spark, f"{root}/projects")
    found = []
    for s in fs.listStatus(base):
        name = s.getPath().getName()
        if not s.isDirectory() or hidden(name):
            continue
        holds = fs.isFile(file_system(spark, f"{s.getPath()}/project.json")[1])
        files = None if holds else fs.listFiles(s.getPath(), True)
        while not holds and files.hasNext():
            holds = not any(map(hidden, str(files.next().getPath())[len(str(s.getPath())) + 1 :].split("/")))
        if holds:
            found.append(name)
    return found


def projects(spark: SparkSession, root: str) -> DataFrame:
    """slug, name, path of the folders below root/projects that hold a file; the name is that of project.json, else the folder's."""
    base = re.sub("^file:/+", "/", root.rstrip("/")) + "/projects"
    slug = lambda p: F.regexp_extract(F.replace(p, F.lit(base + "/"), F.lit("")), "^([^/]+)/", 1)
    seen = spark.createDataFrame([(s,) for s in _slugs(spark, root)], "slug string")
    fs, own_files = file_system(spark, f"{root}/projects/*/project.json")
    if not len(fs.globStatus(own_files)):
        return seen.select("slug", F.col("slug").alias("name"), F.concat(F.lit(base + "/"), "slug").alias("path"))
    t = spark.read.option("recursiveFileLookup", True).text(f"{root}/projects/*/project.json", wholetext=True)
    at = F.replace(_local(F.col("_metadata.file_path")), F.lit(base + "/"), F.lit(""))
    own = t.where(F.size(F.split(at, "/")) == 2).select(slug(_local(F.col("_metadata.file_path"))).alias("slug"), F.nullif(F.get_json_object("value", "$.name"), F.lit("")).alias("name"))
    return seen.join(own, "slug", "left").select("slug", F.coalesce("name", "slug").alias("name"), F.concat(F.lit(base + "/"), "slug").alias("path"))


def runs(spark: SparkSession, root: str) -> DataFrame:
    """slug, file, value (its text) of the runs of all projects below root. Tasks list the folders and read the files; the driver sees the projects only."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs

        store, base = task_store(root)
        for slug in (s for b in batches for s in b["slug"]):
            folder = f"{base.rstrip('/')}/projects/{slug}/run-history"
            if store.get_file_info(folder).type != fs.FileType.Directory:
                continue
            names = (e.name for e in os.scandir(folder)) if isinstance(store, fs.LocalFileSystem) else (i.base_name for i in store.get_file_info(fs.FileSelector(folder)))
            some: list[str] = []
            for name in names:
                if re.fullmatch(RUN_FILE, name):
                    some.append(name)
                if len(some) == TASK_FILES:
                    yield pd.DataFrame({"slug": slug, "file": some})
                    some = []
            yield pd.DataFrame({"slug": slug, "file": some})

    def said(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = task_store(root)
        for b in batches:
            for at in range(0, len(b), 500):
                some, texts = b.iloc[at : at + 500], []
                for slug, name in zip(some["slug"], some["file"], strict=True):
                    with store.open_input_stream(f"{base.rstrip('/')}/projects/{slug}/run-history/{name}") as f:
                        texts.append(f.read().decode(errors="replace"))
                yield some.assign(value=texts)

    folders = dealt(spark.createDataFrame([(s,) for s in _slugs(spark, root)], "slug string"), 1)
    files = stash(folders.mapInPandas(listed, "slug string, file string"), "run-files")
    return dealt(files, TASK_FILES).mapInPandas(said, "slug string, file string, value string")


def handovers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(manifests: token, value), (bodies: body_file, body) of a folder of *.json and *.txt files."""
    texts = lambda glob: spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(_local(F.col("_metadata.file_path")).alias("path"), "value")
    return texts("*.json").select(stem_of(F.col("path")).alias("token"), "value"), texts("*.txt").select(F.element_at(F.split("path", "/"), -1).alias("body_file"), F.col("value").alias("body"))


def judged_handovers(manifests: DataFrame, now: Column, applications: Iterable[str], seconds: int = KEPT_SECONDS) -> DataFrame:
    """manifests (token, value) with their fields and status: 'ok', 'broken' (no JSON, another version, no time), 'unknown' source or 'expired'."""
    m = manifests.withColumn("m", F.from_json("value", HANDOVER)).select("token", "m.*").withColumn("at", F.try_to_timestamp("created"))
    status = (
        F.when(~F.col("version").eqNullSafe(F.lit(1)) | F.col("at").isNull() | ~F.col("token").rlike("^[0-9a-f]{32}$"), "broken").when(~F.coalesce(F.col("source").isin(*applications), F.lit(False)), "unknown")
        .when(F.unix_timestamp(now) - F.unix_timestamp("at") > seconds, "expired").otherwise("ok")
    )
    return m.select("token", "source", "target", F.coalesce("kind", F.lit("plain-text")).alias("kind"), "body_file", status.alias("status"))


def received(manifests: DataFrame, bodies: DataFrame, target: str, now: Column, applications: Iterable[str], seconds: int = KEPT_SECONDS) -> DataFrame:
    """token, source, kind, body of what was sent to the target, still counts and has its body."""
    ok = judged_handovers(manifests, now, applications, seconds).where((F.col("status") == "ok") & (F.col("target") == target))
    return ok.join(bodies, "body_file").select("token", "source", "kind", "body")


def to_clean_up(manifests: DataFrame, now: Column, applications: Iterable[str], seconds: int = KEPT_SECONDS) -> DataFrame:
    """token, body_file of manifests to delete: expired ones, and broken ones."""
    return judged_handovers(manifests, now, applications, seconds).where("status in ('expired', 'broken')").select("token", "body_file")
