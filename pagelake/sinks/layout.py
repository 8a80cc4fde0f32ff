"""Project folders and their runs, made through the file system that the root's address names, whatever that is.

A file is created only if it isn't there, in one step, so of two jobs that start at once one makes the project and both
get runs of their own. Many runs are made at once by tasks, with the same care (`create_runs`).
"""

from __future__ import annotations

import hashlib
import json
import secrets
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from pagelake.store import dealt, file_system, stash, task_store

LAYOUT_VERSION = 1
# Stages and exports of a project, and where older names of stages lie in it.
STAGES = ("raw-ocr", "cleaned", "structured", "translated", "titles")
EXPORTS = ("pdf", "markdown", "tropy", "ludwiglang", "graph", "obsidian", "transcript", "draft", "page")
CANONICAL = {"raw_ocr": "raw-ocr", "title": "titles"}
FOLDERS = ("run-history", "pipeline", "exports")
#: Runs that a task makes, about.
TASK_RUNS = 2_000


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet; False if it is."""
    fs, p = file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


@dataclass(frozen=True)
class Project:
    """A project below root/projects; slug is the name of its folder."""

    spark: SparkSession
    root: str
    slug: str

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/projects/{self.slug}"

    def ensure(self) -> bool:
        """Make what isn't there; whether this call made the project's own file."""
        for folder in FOLDERS:
            fs, p = file_system(self.spark, f"{self.path}/{folder}")
            fs.mkdirs(p)
        own = {"layout_version": LAYOUT_VERSION, "slug": self.slug, "name": self.slug.replace("-", " ").title(), "created": datetime.now(UTC).isoformat(timespec="seconds")}
        return create(self.spark, f"{self.path}/project.json", json.dumps(own, indent=2) + "\n")

    def create_run(self, metadata: dict | None = None) -> str:
        """A run's id: its time and eight random digits, drawn again if another run has them; its file is in run-history."""
        if not canonical(self.spark, self.path):
            self.ensure()
        while True:
            now = datetime.now(UTC)
            run_id = f"{now:%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:8]}"
            if create(self.spark, f"{self.path}/run-history/{run_id}.json", _said(run_id, now, metadata)):
                return run_id

    def stage(self, name: str) -> str:
        if name not in STAGES:
            raise ValueError(f"no stage is called {name}")
        return f"{self.path}/pipeline/{name}"

    def export(self, kind: str) -> str:
        if kind not in EXPORTS:
            raise ValueError(f"no export is called {kind}")
        return f"{self.path}/exports/{kind}"


def _said(run_id: str, now: datetime, metadata: dict | None) -> str:
    """The text of a run's file."""
    return json.dumps({"run_id": run_id, "layout_version": LAYOUT_VERSION, "started": now.isoformat(timespec="seconds"), **(metadata or {})}, indent=2, ensure_ascii=False) + "\n"


def _create_in_task(store, path: str, text: bytes) -> bool:
    """Write a file unless another one is there. One with this text, or its beginning, is left by an earlier attempt of the task and is made whole.

    In one step on a local or mounted folder; elsewhere a look comes before the writing, as object stores have it.
    """
    import pyarrow.fs as fs

    if isinstance(store, fs.LocalFileSystem):
        try:
            with open(path, "xb") as out:
                out.write(text)
            return True
        except FileExistsError:
            pass
    if store.get_file_info(path).type != fs.FileType.NotFound:
        with store.open_input_stream(path) as f:
            if not text.startswith(f.read()):
                return False
    with store.open_output_stream(path) as out:
        out.write(text)
    return True


def create_runs(spark: SparkSession, root: str, runs: DataFrame) -> None:
    """A run for each row of runs (slug, metadata: a JSON object or null), its file written by a task; projects that aren't there are made.

    The digits are the row's number times an odd number, modulo 2 ** 32, so the ids of one call differ; where another call has
    one, the next is drawn from a hash. A task that is repeated draws the same ids and knows its own files by their
    text, so of two calls within one second, runs with the same metadata that also draw the same digits would be one.
    """
    now, start, step = datetime.now(UTC), secrets.randbits(32), secrets.randbits(32) | 1
    rows = stash(dealt(runs.select("slug", "metadata"), TASK_RUNS), "runs")  # a repeated task has to find the same rows under the same numbers
    for r in rows.select("slug").distinct().collect():
        project = Project(spark, root, r["slug"])
        if not canonical(spark, project.path):
            project.ensure()

    def save(numbered) -> None:
        store, base = task_store(root)
        for (slug, metadata), n in numbered:
            digits, k = f"{(start + n * step) % 2**32:08x}", 0
            while True:
                run_id = f"{now:%Y%m%d-%H%M%S}-{digits}"
                if _create_in_task(store, f"{base.rstrip('/')}/projects/{slug}/run-history/{run_id}.json", _said(run_id, now, json.loads(metadata or "null")).encode()):
                    break
                k += 1
                digits = hashlib.sha256(f"{start} {step} {n} {k}".encode()).hexdigest()[:8]

    rows.rdd.zipWithIndex().foreachPartition(save)


def canonical(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is a project: it has the file and the stages of one."""
    fs, at = file_system(spark, f"{folder}/project.json")
    return fs.isFile(at) and fs.isDirectory(file_system(spark, f"{folder}/pipeline")[1])


def stage_folder(spark: SparkSession, folder: str, stage: str, kind: str = "text") -> str:
    """Where a stage's texts or records lie: in a project below its pipeline, in older folders beside it, with records in `json`."""
    if canonical(spark, folder):
        return f"{folder}/pipeline/{CANONICAL.get(stage, stage)}/{kind}"
    return f"{folder}/{stage}" + ("/json" if kind == "records" else "")


def page_path(spark: SparkSession, folder: str, stem: str) -> str:
    return f"{folder}/pipeline/page/{stem}.xml" if canonical(spark, folder) else f"{folder}/page/{stem}.xml"


def project_of(spark: SparkSession, path: str) -> Project | None:
    """The project that a path lies in: the nearest folder above it that has a project's file and lies in `projects`."""
    scheme, _, rest = path.rstrip("/").rpartition("//") if "//" in path else ("", "", path.rstrip("/"))
    parts = rest.split("/")
    for k in range(len(parts), 1, -1):
        folder = (f"{scheme}//" if scheme else "") + "/".join(parts[:k])
        if parts[k - 2] == "projects":
            fs, at = file_system(spark, f"{folder}/project.json")
            if fs.isFile(at):
                return Project(spark, folder.rsplit("/", 2)[0], parts[k - 1])
    return None
