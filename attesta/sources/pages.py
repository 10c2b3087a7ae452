"""Pages as files: written by the executors, each whole or not at all."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

DONE = "_PAGES"


@dataclass
class Written(WriterCommitMessage):
    pages: int
    size: int


class PageWriter(DataSourceWriter):
    """Each page goes to a hidden file beside its place and is then renamed, so
    a task that dies leaves no half page, and one that runs again writes the
    same pages over. The job's marker, with the pages' number and bytes, comes
    last: a folder without it wasn't finished."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self) -> tuple[fs.FileSystem, str]:
        uri = self.folder if "://" in self.folder else "file://" + posixpath.abspath(self.folder)
        return fs.FileSystem.from_uri(uri)

    def _put(self, store: fs.FileSystem, path: str, body: bytes) -> None:
        folder, name = posixpath.split(path)
        store.create_dir(folder, recursive=True)
        hidden = posixpath.join(folder, f".{name[:100]}.{uuid.uuid4().hex}")
        with store.open_output_stream(hidden) as out:
            out.write(body)
        store.move(hidden, path)

    def write(self, iterator: Iterator) -> Written:
        store, root = self._open()
        pages = size = 0
        for row in iterator:
            body = (row["body"] or "").encode()
            self._put(store, posixpath.join(root, row["path"]), body)
            pages, size = pages + 1, size + len(body)
        return Written(pages, size)

    def commit(self, messages: list) -> None:
        store, root = self._open()
        done = [m for m in messages if m is not None]
        self._put(store, posixpath.join(root, DONE), f"{sum(m.pages for m in done)} pages, {sum(m.size for m in done)} bytes\n".encode())

    def abort(self, messages: list) -> None:
        """Pages that were written are whole; without the marker the folder counts as unfinished."""


class Pages(DataSource):
    """``df.write.format("pages").mode("append").save(folder)`` for (path, body)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "path string, body string"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])


def bad_paths(pages: DataFrame) -> DataFrame:
    """(path, code) of pages that can't be files: paths that are blank, lead out
    of the folder or are hidden, and paths of several pages (case ignored, as
    some stores do) or that others need as a folder."""
    p = pages.select(F.coalesce("path", F.lit("")).alias("path"))
    parts = F.split("path", "/")
    odd = F.exists(parts, lambda x: (F.trim(x) == "") | x.startswith(".")) | F.col("path").contains("\\") | (F.col("path") == DONE)
    same = p.groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path"), F.count("*").alias("n"))
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.lower(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    folders = p.where(F.size(parts) > 1).select(F.explode(above).alias("key")).distinct()
    codes = [
        (p.where(odd).select("path").distinct(), "unfit_path"), (same.where("n > 1").select("path"), "clashing_path"),
        (same.join(folders, "key", "left_semi").select("path"), "path_is_a_folder")
    ]
    out = [d.withColumn("code", F.lit(c)) for d, c in codes]
    return out[0].unionByName(out[1]).unionByName(out[2])


def write_pages(pages: DataFrame, folder: str) -> None:
    """Write (path, body) below ``folder``, which all executors share. Nothing
    is written if a path is bad; null bodies are empty pages."""
    spark = pages.sparkSession
    bad = bad_paths(pages).limit(5).collect()
    if bad:
        raise ValueError(f"pages can't be written: {[tuple(r) for r in bad]}")
    spark.dataSource.register(Pages)
    pages.select("path", "body").write.format("pages").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, body) of a folder of pages."""
    root = folder if "://" in folder else "file://" + posixpath.abspath(folder)
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    tail = F.substring_index(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), root.split("://", 1)[1].rstrip("/") + "/", -1)
    return files.select(tail.alias("path"), F.col("value").alias("body"))
