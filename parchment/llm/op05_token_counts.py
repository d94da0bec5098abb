"""Token counts of documents in flat token files without an index, by a scan for separators.

A file is a run of little-endian token ids of 16 or 32 bits, each document followed by the end-of-document id.
Blocks of files are read anywhere in the cluster; one vectorised comparison finds the separators of a block.
Documents that lie across blocks are stitched by a prefix scan over one small row per block: the last separator
before a block is the largest one of all earlier blocks, the number of documents before it their sum.

Files lie in the shared folder, reached through pyarrow.fs. `token_files` writes them from a table of texts; a
file counts only if the task that wrote it succeeded, so lost executors leave no false files.

Defined results: a null or empty text is a document of no tokens; tokens after the last separator of a file
are a document of their own; repeated rows count as often as they come; empty tables and files give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, shared_dir, table
from .op04_packing import tokenizer_path

BLOCK = 8 << 20


def token_files(docs: DataFrame, path: str, end: int, width: int = 2) -> DataFrame:
    """(file, ordinal, doc_id, bytes): a row for each document of each file, and one with ordinal -1 and the file's size; ids of width bytes."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def run(batches):
        from pyarrow import fs

        from .bpe import ByteLevel

        store, where = fs.FileSystem.from_uri(folder)
        enc = _encoder(ByteLevel, path)
        store.create_dir(where, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        tail, n, at, most = np.array([end], f"<u{width}").tobytes(), 0, 0, (1 << 8 * width) - 1
        with store.open_output_stream(f"{where}/{name}") as out:
            for b in batches:
                for text in b.column("text"):
                    ids = np.frombuffer(enc.encode([text.as_py() or ""])[0], "<u4")
                    if ids.max(initial=0) > most:
                        raise ValueError(f"an id of {ids.max()} doesn't fit {width} bytes")
                    ids = ids.astype(f"<u{width}").tobytes() + tail
                    out.write(ids)
                    at += len(ids)
                k = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * k, pa.string()), pa.array(np.arange(n, n + k)), b.column("doc_id").cast(pa.int64()), pa.nulls(k, pa.int64())], names=["file", "ordinal", "doc_id", "bytes"])
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([-1]), pa.nulls(1, pa.int64()), pa.array([at])], names=["file", "ordinal", "doc_id", "bytes"])

    return cut(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, ordinal long, doc_id long, bytes long"))


_held: dict = {}


def _encoder(kind, path: str):
    if path not in _held:
        _held[path] = kind(path, ordinary=True)
    return _held[path]


def scan(files: DataFrame, end: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in files(file, bytes), ids of width bytes."""
    block -= block % width
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(block).cast("long"))).alias("at")
    parts = files.where(F.col("bytes") > 0).select("file", "bytes", starts).repartition(F.col("file"), F.col("at"))

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for file, size, at in zip(*(b.column(c).to_pylist() for c in ("file", "bytes", "at"))):
                store, where = fs.FileSystem.from_uri(file)
                with store.open_input_file(where) as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(min(block, size - at)), f"<u{width}")
                ends = np.flatnonzero(ids == end) + at // width
                if at + block >= size and len(ids) and ids[-1] != end:
                    ends = np.append(ends, size // width)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at]), pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["file", "at", "ends"])

    found = cut(parts.mapInArrow(run, "file string, at long, ends array<long>"))
    # the scan is over one small row a block; the separators stay where they are until it is done
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    before = found.select("file", "at", last.alias("last"), F.size("ends").alias("n"))
    before = before.select("file", "at", F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)).alias("first"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = found.join(before.hint("merge"), ["file", "at"]).select("file", "first", "before", "ends", F.posexplode("ends").alias("pos", "stop"))
    start = F.when(F.col("pos") == 0, F.col("first")).otherwise(F.element_at("ends", F.greatest(F.col("pos"), F.lit(1))) + 1)
    return rows.select("file", (F.col("before") + F.col("pos")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def counted(docs: DataFrame, path: str | None = None, end: int = 50256, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens): texts written to token files, and these scanned; end must be no id of a text. Ids take 4 bytes where the vocabulary needs them."""
    from tokenizers import Tokenizer

    path = path or tokenizer_path()
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end + 1) <= 1 << 16 else 4
    rows = token_files(docs, path, end, width)
    found = scan(rows.where(F.col("ordinal") < 0).select("file", "bytes"), end, width, block)
    return rows.where(F.col("ordinal") >= 0).select("file", "ordinal", "doc_id").join(found.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))
