"""Vectors of texts without an outside model: a randomised singular value decomposition of their TF-IDF rows.

Terms fall into hashed columns, so the matrix has as many rows as there are texts and `columns` columns. A block of
random directions is multiplied by AᵀA a few times; each product is one pass over the rows, whose partial sums are
columns x width numbers a task and are added by block. The driver holds such a block and no row of the matrix. Texts
are split into terms once; a few rows at a time are spread out as a full matrix, whose products need no sorting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept, stored
from .retrieval import term_list

COLUMNS, RANK, MORE, PASSES = 1 << 13, 48, 12, 3
BLOCK = 128  # columns whose sums travel together
ROWS = 256  # texts that are multiplied at once


def rows_of(texts: DataFrame, key: str, stop: list[str], columns: int, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, _at, _w): columns and weights of each text, of unit length; idf(column, idf), of texts if not given).

    A text's columns are counted where it is; only the numbers of texts that have a column are dealt, at most `columns` a task.
    """
    terms = F.transform(term_list(F.coalesce("text", F.lit("")), stop), lambda t: F.pmod(t, F.lit(columns)).cast("int"))
    rows = texts.select(key, terms.alias("_terms"))
    if idf is None:
        rows = stored(rows)
        df = kept(rows.select(F.explode(F.concat(F.array_distinct("_terms"), F.array(F.lit(-1)))).alias("column")).groupBy("column").agg(F.count("*").alias("df")))
        n = df.where("column = -1").agg(F.coalesce(F.max("df"), F.lit(0))).first()[0]
        idf = kept(df.where("column >= 0").select("column", (F.ln((n + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    known = np.full(columns, np.nan)  # what no text has doesn't count
    for column, value in idf.collect():
        known[column] = value
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            lists = batch.column("_terms")
            many = np.diff(lists.offsets.to_numpy())
            at, tf = np.unique(np.repeat(np.arange(batch.num_rows), many) * columns + lists.flatten().to_numpy(), return_counts=True)
            w = (1 + np.log(tf)) * sent.value[at % columns]
            at, w = at[~np.isnan(w)], w[~np.isnan(w)]
            row = at // columns
            w = w / np.sqrt(np.bincount(row, w * w, batch.num_rows))[row]
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32))
            columns_ = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((at % columns).astype(np.int32), w)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns_], names=[key, "_at", "_w"])

    return rows.mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, _at array<int>, _w array<double>"), idf


def _parts(batches):
    """Batches in parts of a few rows, whose products with a block stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of the entries of a batch."""
    at, w = batch.column("_at"), batch.column("_w")
    many = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(len(many)), many), at.flatten().to_numpy().astype(np.int64), w.flatten().to_numpy()


def _spread(batches, columns: int):
    """Parts of batches with their rows as a full matrix; one matrix a task, used again and again."""
    full = None
    for batch in _parts(batches):
        row, column, weight = _flat(batch)
        full = np.zeros((ROWS, columns)) if full is None else full
        full[row, column] = weight
        yield batch, full[: batch.num_rows]
        full[row, column] = 0


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """AᵀA block for the matrix A of rows(_at, _w): one pass; tasks add up before they send, at most one sum for each core."""
    columns, width = block.shape
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        out = None
        for _, rows_ in _spread(batches, columns):
            out = np.zeros((columns, width)) if out is None else out
            out += rows_.T @ (rows_ @ sent.value)
        if out is not None:
            parts = [out[i : i + BLOCK].tobytes() for i in range(0, columns, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], names=["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select("_at", "_w").coalesce(cores).mapInArrow(run, "block long, sums binary").groupBy("block").applyInArrow(add, "block long, sums binary").collect()
    out = np.zeros((columns, width))
    for at, sums in parts:
        got = np.frombuffer(sums).reshape(-1, width)
        out[at * BLOCK : at * BLOCK + len(got)] = got
    return out


@dataclass
class Latent:
    """basis: columns x rank right singular vectors; strength: their singular values; idf(column, idf); rows: those of the texts that made it."""

    basis: np.ndarray
    strength: np.ndarray
    idf: DataFrame
    stop: list[str]
    rows: DataFrame

    def vectors(self, texts: DataFrame, key: str) -> DataFrame:
        """(key, v) of texts(key, text): rows times basis, of unit length; a text without known terms has none."""
        return self._turned(rows_of(texts, key, self.stop, len(self.basis), self.idf)[0], key)

    def own(self) -> DataFrame:
        """(key, v) of the texts that made it, whose rows are there."""
        return self._turned(self.rows, self.rows.columns[0])

    def _turned(self, rows: DataFrame, key: str) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(self.basis)

        def run(batches):
            for batch, full in _spread(batches, len(sent.value)):
                got = full @ sent.value
                size = np.sqrt((got * got).sum(1))
                got /= np.where(size > 1e-12, size, 1)[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1]), pa.int32()), pa.array(got.reshape(-1)), mask=pa.array(size <= 1e-12))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[key, "v"])

        return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, v array<double>")


def fit(texts: DataFrame, key: str, stop: list[str], rank: int = RANK, columns: int = COLUMNS, more: int = MORE, passes: int = PASSES, seed: int = 3) -> Latent:
    """The first rank directions of texts(key, text); more: directions besides, that make the first ones sure."""
    rows, idf = rows_of(texts, key, stop, columns)
    rows = stored(rows)
    block = np.random.default_rng(seed).standard_normal((columns, rank + more))
    for _ in range(passes):
        block = np.linalg.qr(gram_times(rows, block))[0]
    small = block.T @ gram_times(rows, block)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    return Latent(block @ turn[:, order], np.sqrt(np.maximum(values[order], 0)), idf, stop, rows)
