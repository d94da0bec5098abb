"""A source of pages: long text files as many tasks, each reading a range of bytes; and a sink of one report a document."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PAGE_END = b"\f"
SPLIT = 8 << 20
LEAST_CHARS = 40  # a page with fewer is read again by the other reader


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


def pages_of(f, start: int, end: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of the pages that begin in [start, end): a page begins at 0 or after a page's end."""
    at, pending = start, b""
    if start:  # the page that holds the byte before start belongs to an earlier range
        f.seek(start - 1)
        at = start - 1
        while True:
            got = f.read(step)
            if not got:
                return
            cut = got.find(PAGE_END)
            if cut >= 0:
                pending, at = got[cut + 1 :], at + cut + 1
                break
            at += len(got)
    else:
        f.seek(0)
    done = False
    while at < end:
        cut = pending.find(PAGE_END)
        while cut < 0 and not done:
            got = f.read(step)
            done = not got
            cut = got.find(PAGE_END)
            cut = cut + len(pending) if cut >= 0 else -1
            pending += got
        if cut < 0:
            if pending or at < size or at == 0:
                yield at, pending
            return
        yield at, pending[:cut]
        at, pending = at + cut + 1, pending[cut + 1 :]


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.suffix, self.head = options.get("suffix", ""), options.get("head", "").encode()

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(self.suffix)]
        return [Range(x.path, i, min(i + self.split, x.size), x.size) for x in sorted(found, key=lambda x: x.path) for i in range(0, max(x.size, 1), self.split)]

    def read(self, part: Range) -> Iterator[tuple]:
        """Pages as (doc_id, at, text, error); a file that isn't of the kind gives one row with the reason, from its first range."""
        store, root = _store(self.path)
        name = os.path.relpath(part.path, root)
        with store.open_input_file(part.path) as f:
            head = f.read(max(1024, len(self.head)))
            if not part.size or not head.startswith(self.head):
                if part.start == 0:
                    yield name, 0, None, "empty" if not part.size else "another kind of file"
                return
            for at, page in pages_of(f, part.start, part.end, part.size):
                try:
                    yield name, at, page.decode("utf-8"), None
                except UnicodeDecodeError as e:
                    yield name, at, page.decode("utf-8", "replace"), f"not UTF-8 at byte {e.start}"


class Pages(DataSource):
    """spark.read.format("pages"): options path, suffix, head (what a file of the kind begins with), split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "doc_id string, at long, text string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(self.options)


def read(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(pages(doc_id, page, text), rejects(doc_id, at, error)) of a folder's files; page counts from 1 within a file.

    Rejected are files of another kind and empty ones; pages that aren't UTF-8 are rejects too, and read as far as they can be.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    spark.dataSource.register(Pages)
    rows = spark.read.format("pages").options(path=path, **{k: str(v) for k, v in options.items()}).load()
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return rows.where("text IS NOT NULL").select("doc_id", page.alias("page"), "text"), rows.where("error IS NOT NULL").select("doc_id", "at", "error")


def chosen(first: DataFrame, other: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, page, text, ocr): page by page the first reader's text, the other's where that has fewer than least characters and the other more."""
    from pyspark.sql import functions as F

    both = first.select("doc_id", "page", F.col("text").alias("a")).join(other.select("doc_id", "page", F.col("text").alias("b")), ["doc_id", "page"], "full")
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    second = (size("a") < least) & (size("b") > size("a"))
    return both.select("doc_id", "page", F.when(second, F.col("b")).otherwise(F.coalesce("a", "b")).alias("text"), second.alias("ocr"))


# ---------------------------------------------------------------- reports
class Written(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class ReportWriter(DataSourceWriter):
    """Tasks write files under names of their own; only the commit of the whole job moves them to the documents' names."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.path)
        folder = f"{root}/_temporary/{self.job}"
        store.create_dir(folder, recursive=True)
        names = []
        for row in rows:
            part = f"{folder}/{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(row.body.encode())
            names.append((part, row.name))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for part, name in m.names if m else []:
                store.move(part, f"{root}/{name}")
        self._tidy(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy(*_store(self.path))

    def _tidy(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary/{self.job}")


class Reports(DataSource):
    """df.write.format("reports"): a file for each row of (name, body), whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options)


def write_reports(rows: DataFrame, path: str) -> None:
    """A Markdown file for each document of rows(doc_id, section, ord, cells), as reports.sections() gives them.

    Cells of several columns are a table, single ones a list. Names are the ids; of other characters than letters, digits,
    dots, dashes and underscores a mark of the whole id is kept, so that no two documents share a file.
    """
    from pyspark.sql import functions as F

    one = F.when(F.size("cells") > 1, F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))).otherwise(F.concat(F.lit("- "), F.get("cells", F.lit(0))))
    parts = rows.select("doc_id", "section", "ord", one.alias("line")).groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "lines"))), lambda x: F.concat(F.lit("## "), x["section"], F.lit("\n\n"), x["lines"])), "\n\n").alias("body"))
    own = F.col("doc_id").cast("string")
    safe = F.regexp_replace(own, r"[^A-Za-z0-9._-]", "_")
    name = F.concat(safe, F.when(safe != own, F.concat(F.lit("-"), F.left(F.sha2(own, 256), F.lit(12)))).otherwise(""), F.lit(".md"))
    rows.sparkSession.dataSource.register(Reports)
    whole.select(name.alias("name"), "body").write.format("reports").mode("append").option("path", path).save()
