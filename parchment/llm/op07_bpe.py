"""BPE encoding and decoding by content-defined chunks that documents share.

A rolling hash over the bytes cuts texts into chunks that depend on content alone, so copies and repeated
passages give equal chunks wherever they stand. What lies between the first and the last space of a chunk is
encoded and decoded once and kept. Each join of chunks is then repaired: the bytes from the last space before
it to the first space after it are encoded anew, reaching over further chunks until white space stands on
both sides; there this tokenizer's pattern always ends a piece, so the ids agree exactly with those of the
whole text. New chunks are taken apart at every space in the same way before they are encoded.

Kept chunks are bounded per worker; nothing is shuffled. Defined results: a null text is an empty one and has
no ids; repeated rows and ids give repeated rows; an empty table none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .op04_packing import _encoder, tokenizer_path
from .textnp import BASE, BYTES, blocks

WINDOW = 16  # bytes that decide on a cut
MASK = 0x3FF  # one cut in 1024 bytes
WORDS, CHUNKS = 400_000, 8_000  # kept in a worker
MARK = b"\x01"
COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cuts(buf: np.ndarray, window: int = WINDOW, mask: int = MASK) -> np.ndarray:
    """Places in buf after whose last window bytes the rolling hash asks for a cut."""
    n = len(buf) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    table = (BYTES >> np.uint64(32)).astype(np.uint32)
    v, h, step = table[buf], np.zeros(len(buf), np.uint32), np.uint32(BASE & 0xFFFFFFFF)
    power, width = step, 1  # h_2w[i] = h_w[i] * B^w + h_w[i + w]: the window by doubling
    h = v
    with np.errstate(over="ignore"):
        while width < window:
            h = h[: len(h) - width] * power + h[width:]
            power, width = np.uint32(power * power), width * 2
    return np.flatnonzero((h >> np.uint32(8)) & np.uint32(mask) == 0) + window


class Chunked:
    """For a text as bytes with line feeds turned into spaces: (number of ids, ids joined, tokens joined)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.glue = self.tok.decode([0, 0], skip_special_tokens=False)
        one = self.tok.decode([0], skip_special_tokens=False)
        if self.glue != f"{one} {one}":
            raise ValueError("this tokenizer's decoder doesn't join tokens by spaces")
        marked = self.tok.encode(MARK.decode(), add_special_tokens=False).ids
        if len(marked) != 1:
            raise ValueError("this tokenizer has no single id for the mark")
        self.mark = marked[0]
        self.name = [(self.tok.id_to_token(i) or "").encode() for i in range(self.tok.get_vocab_size())]
        self.digits = [b"%d" % i for i in range(self.tok.get_vocab_size())]
        self.ids: dict[bytes, bytes | None] = {}
        self.tokens: dict[bytes, bytes | None] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}

    def _learn(self, chunks: list[bytes]) -> None:
        """Knows every word of these chunks afterwards."""
        words = set()
        for c in chunks:
            words.update(c.split(b" "))
        words.discard(b"")
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > WORDS:
            self.ids.clear()
            self.tokens.clear()
            new = words
        alone = [w for w in new if MARK in w]
        whole = list(new.difference(alone))
        # all new words in one string, each followed by a mark that is a piece of its own
        ids = self.tok.encode_batch_fast([f" {MARK.decode()} ".join([*(w.decode() for w in whole), ""])], add_special_tokens=False)[0].ids
        found, at = [], 0
        for w in whole:
            end = ids.index(self.mark, at)
            found.append(ids[at:end])
            at = end + 1
        found += [e.ids for e in self.tok.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)]
        name, digits = self.name, self.digits
        for w, one in zip(whole + alone, found):
            self.ids[w] = b" ".join([digits[i] for i in one]) if one else None
            self.tokens[w] = b" ".join([name[i] for i in one]) if one else None

    def _words(self, chunk: bytes) -> tuple[bytes, bytes]:
        words = [w for w in chunk.split(b" ") if w]
        return b" ".join(filter(None, map(self.ids.__getitem__, words))), b" ".join(filter(None, map(self.tokens.__getitem__, words)))

    @staticmethod
    def parts(data: bytes, at: int, edges: list[int]) -> list[tuple[bytes, bool]]:
        """What to encode of data from at to the last edge, in order, and whether it lies within a chunk."""
        out, carry = [], b""
        for e in edges:
            chunk, at = data[at:e], e
            i = chunk.find(b" ")
            if i < 0:
                carry += chunk
                continue
            j = chunk.rfind(b" ")
            out += [(carry + chunk[:i], False), (chunk[i + 1 : j], True)]
            carry = chunk[j + 1 :]
        return [p for p in [*out, (carry, False)] if p[0]]

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        flat = np.where(buf == 10, np.uint8(32), buf)
        data, places = flat.tobytes(), cuts(flat)
        split = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            inner = places[np.searchsorted(places, a, "right") : np.searchsorted(places, b, "left")]
            split.append(self.parts(data, a, [*inner.tolist(), b]))
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        self._learn([p for ps in split for p, whole in ps if not (whole and p in self.chunks)])
        out = []
        for ps in split:
            got = []
            for p, whole in ps:
                pair = self.chunks.get(p) if whole else None
                if pair is None:
                    pair = self._words(p)
                    if whole:
                        self.chunks[p] = pair
                if pair[0]:
                    got.append(pair)
            ids = b" ".join([x for x, _ in got])
            out.append((ids.count(b" ") + 1 if ids else 0, ids, b" ".join([x for _, x in got])))
        return out


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and tokens: the ids and the decoded text themselves."""
    return _run(docs, path, "doc_id long, n_tokens long, ids string, decoded string", lambda n, i, t: (n, i.decode(), t.decode()))


def _run(docs: DataFrame, path: str | None, schema: str, row) -> DataFrame:
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        enc = _encoder(Chunked, path)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j, buf, offs in blocks(batch.column("text")):
                cols = list(zip(*[row(*x) for x in enc.texts(buf, offs)]))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    named = schema.replace("ids_sha256", "ids").replace("decoded_sha256", "decoded")
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, named)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _run(docs, path, COLUMNS, lambda n, i, t: (n, sha(i), sha(t))).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op7_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
