"""A store of notes that takes all of a batch or nothing: spark.write.format("notes") with a count that has to agree.

Tasks leave their rows in files of their own, which nobody reads yet. The commit counts them, and one small file that
names them, written last, makes them part of the store. A failed task, or another count than the one that was looked at,
leaves the store as it was; a batch that is committed again adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from pagelake.functions.text import note_html, stripped
from pagelake.operators.collect import note_plan
from pagelake.store import file_system, stash

NOTES = "photo_id long, html string, text string, language string"
KINDS = pa.schema([("photo_id", pa.int64()), ("html", pa.string()), ("text", pa.string()), ("language", pa.string())])


class CountChanged(ValueError):
    """There is another number of notes to write than was agreed to: look again."""


@dataclass
class Written(D.WriterCommitMessage):
    file: str
    rows: int


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as Python sees it, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class NoteSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return NOTES

    def writer(self, schema, overwrite: bool) -> D.DataSourceArrowWriter:
        return NoteWriter(self.options["path"], self.options["batch"], int(self.options["expected"]))


class NoteWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, expected: int):
        self.path, self.batch, self.expected = path.rstrip("/"), batch, expected

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's rows, in a file that has the task's attempt for itself."""
        store, base = located(self.path)
        file, rows = f"files/{self.batch}-{uuid.uuid4().hex}.parquet", 0
        store.create_dir(f"{base}/files", recursive=True)
        try:
            with pq.ParquetWriter(f"{base}/{file}", KINDS, filesystem=store) as out:
                for b in iterator:
                    out.write_batch(b.cast(KINDS) if b.schema != KINDS else b)
                    rows += b.num_rows
        except BaseException:
            store.delete_file(f"{base}/{file}")
            raise
        return Written(file, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = located(self.path)
        done = f"{base}/commits/{self.batch}.json"
        if store.get_file_info(done).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        rows = sum(m.rows for m in messages if m)
        if rows != self.expected:
            raise CountChanged(f"{rows} notes instead of {self.expected}: nothing was written")
        store.create_dir(f"{base}/commits", recursive=True)
        draft = f"{done}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"rows": rows, "files": [m.file for m in messages if m and m.rows]}).encode())
        store.move(draft, done)
        self._drop_others({m.file for m in messages if m and m.rows})

    def abort(self, messages: list[Written | None]) -> None:
        store, base = located(self.path)
        self._drop(messages)
        if store.get_file_info(f"{base}/commits/{self.batch}.json").type == fs.FileType.NotFound:
            self._drop_others(set())

    def _drop_others(self, kept: set[str]) -> None:
        """Files that broken attempts at this batch have left; a task that is slow to stop may leave one yet, which nobody reads."""
        store, base = located(self.path)
        for f in store.get_file_info(fs.FileSelector(f"{base}/files", allow_not_found=True)):
            if f.base_name.startswith(f"{self.batch}-") and f"files/{f.base_name}" not in kept:
                store.delete_file(f.path)

    def _drop(self, messages: list[Written | None]) -> None:
        store, base = located(self.path)
        for m in messages:
            if m and store.get_file_info(f"{base}/{m.file}").type != fs.FileType.NotFound:
                store.delete_file(f"{base}/{m.file}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """photo_id, html, text, language of all batches that were committed."""
    store, at = file_system(spark, f"{path}/commits")
    if not store.exists(at):
        return spark.createDataFrame([], NOTES)
    files = spark.read.text(f"{path}/commits/*.json", wholetext=True).select(F.explode(F.from_json("value", "files array<string>")["files"]).alias("f"))
    names = [f"{path}/{r['f']}" for r in files.collect()]  # a name for each task that wrote rows
    return spark.read.schema(NOTES).parquet(*names) if names else spark.createDataFrame([], NOTES)


def commit_notes(entries: DataFrame, photos: DataFrame, path: str, target: str, expected: int, batch: str) -> dict[str, int]:
    """Write the notes of entries that are ready, if there are as many as `expected`; {written, skipped}.

    entries (photo_id, item_id, text, project, language) are planned again, against photos (photo_id, item) and the notes that
    the store has now: what has changed since they were looked at shows in the count, and CountChanged is raised. Of entries
    with one photo and text, white space aside, one is written and the others are skipped. batch names the commit: the same one again writes nothing.
    """
    spark = entries.sparkSession
    store, at = file_system(spark, f"{path}/commits/{batch}.json")
    if store.exists(at):
        return {"written": 0, "skipped": expected}
    plan = stash(note_plan(entries, photos, committed(spark, path).select("photo_id", "text"), target).where("action = 'ready'"), "notes")
    ready = plan.count()
    if ready != expected:
        raise CountChanged(f"{ready} notes instead of {expected}: nothing was written")
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    once = plan.groupBy("photo_id", flat.alias("flat")).agg(F.min(F.struct("text", "language")).alias("n"))
    text = stripped(F.col("n.text"))
    notes = stash(once.select(F.col("photo_id").cast("long").alias("photo_id"), note_html(text).alias("html"), text.alias("text"), F.col("n.language").alias("language")), "notes")
    written = notes.count()
    spark.dataSource.register(NoteSource)
    notes.write.format("notes").mode("append").option("path", path).option("batch", batch).option("expected", str(written)).save()
    return {"written": written, "skipped": ready - written}
