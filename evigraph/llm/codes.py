"""Vector code compression: product quantisation in whole numbers.

Components become floor(SCALE * x); a vector is cut into ``parts`` equal
consecutive parts, and each part position has a codebook of at most ``entries``
entries.  The codebooks start as the parts of the vectors with the least ids.
Every round assigns each part to its nearest entry and replaces the entries by
their parts' means, rounded down; entries without parts stay.  A last
assignment gives the codes.

Codebooks are broadcast: parts x entries rows of whole numbers, a size that is
fixed by the parameters.  Tasks stream Arrow batches over their rows and work out
all squared distances of a slice by expanding norms, with exact int64 matrix
products; the first least one wins, so ties go to the lower entry.  A task
keeps one sum and one count for each entry and hands them on at its end;
the grouped shuffle merges them, and parts x entries rows come to the driver.
All sums are whole numbers, so nothing depends on the order of rows or tasks.

Defined cases: vectors that are null, hold a null or non-finite component, or a
component of MOST / SCALE (16,384) or more in size (sums of whose squares may not
fit 64 bits) are left out; so are those of another length than the one with the least
id, and those whose length isn't a multiple of ``parts`` or is WIDEST times it.  Null labels are one label.  Repeated
rows and rows of one id are vectors of their own; null ids come last and are kept;
rows of one id are ordered by their components where they start the codebooks.  With
fewer vectors than entries the codebooks are shorter.  An empty table gives an
empty result.  There are no texts.  Extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Tables

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Scaled components stay below this: a distance over fewer than WIDEST of them fits 63 bits.
MOST, WIDEST = 1 << 24, 1 << 13
#: Rows whose distances are held at a time.
SLICE = 2_000


def scaled(column: pa.Array, parts: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of one length (any length that parts divide, if none is given) and their components, end to end."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, np.diff(column.offsets.to_numpy()), 0).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(values * SCALE)
        good = np.abs(whole) < MOST  # nulls are not a number here
    ends, bad = np.cumsum(sizes), np.concatenate([[0], np.cumsum(~good)])
    keep = (bad[ends] == bad[ends - sizes]) & (sizes > 0) & (sizes % parts == 0) & (sizes < parts * WIDEST)
    if length is not None:
        keep &= sizes == length
    return np.flatnonzero(keep), whole[np.repeat(keep, sizes)].astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its squared distance: |x|^2 - 2 x.c + |c|^2, the first of equal ones."""
    partial = norms - 2 * (x @ book.T)
    code = partial.argmin(axis=1)
    return code, partial[np.arange(len(x)), code] + np.einsum("ij,ij->i", x, x)


def slices(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Usable rows, their parts (part, row, component), codes (part, row) and distances (part, row)."""
    parts, _, width = books.shape
    norms = np.einsum("pec,pec->pe", books, books)
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            some = batch.slice(first, SLICE)
            at, flat = scaled(some.column("embedding"), parts, parts * width)
            if not len(at):
                continue
            x = np.ascontiguousarray(flat.reshape(len(at), parts, width).transpose(1, 0, 2))
            found = [nearest(x[p], books[p], norms[p]) for p in range(parts)]
            yield some.take(pa.array(at)), x, np.stack([f[0] for f in found]), np.stack([f[1] for f in found])


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The starting codebooks (part, entry, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                some = batch.slice(first, SLICE)
                at, flat = scaled(some.column("embedding"), parts)
                sizes = np.diff(some.column("embedding").offsets.to_numpy())[at]
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([some.column("vec_id").take(pa.array(at)), values], names=["vec_id", "v"])

    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, v array<long>")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    got = [r["v"] for r in kept.orderBy(*order).limit(entries).collect()]
    if got and any(len(v) != len(got[0]) for v in got):
        got = [r["v"] for r in kept.where(F.size("v") == len(got[0])).orderBy(*order).limit(entries).collect()]
    if not got:
        return np.zeros((parts, 0, 0), np.int64)
    return np.ascontiguousarray(np.array(got, np.int64).reshape(len(got), parts, -1).transpose(1, 0, 2))


def one_round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one assignment of all vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        parts, entries, width = now.shape
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for _, x, code, _ in slices(batches, now):
            for p in range(parts):
                order = np.argsort(code[p], kind="stable")
                used, start = np.unique(code[p][order], return_index=True)
                sums[p * entries + used] += np.add.reduceat(x[p][order], start, axis=0)
                counts[p * entries + used] += np.diff(np.append(start, len(order)))
        at = np.flatnonzero(counts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(sums[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at), flat, pa.array(counts[at])], names=["entry", "sums", "n"])

    width = books.shape[2]
    partial = vectors.select("embedding").mapInArrow(run, "entry long, sums array<long>, n long")
    merged = partial.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    after = books.reshape(-1, width).copy()
    for row in merged.collect():  # parts x entries rows at most
        after[row["entry"]] = [s // row["n"] for s in row["sums"]]
    sent.unpersist()
    return after.reshape(books.shape)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as an array (part, entry, component)."""
    if not 0 < entries <= 256:
        raise ValueError("codes are one byte a part")
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = one_round(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every usable vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value.size:
            return
        for rows, _, code, error in slices(batches, sent.value):
            text = code.T.astype(np.uint8).tobytes().hex()
            width = 2 * len(code)
            codes = pa.array([text[i : i + width] for i in range(0, len(text), width)])
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), codes, pa.array(error.sum(axis=0))], names=["vec_id", "label", "code", "error"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode(code: str, books: np.ndarray) -> list[int]:
    """The vector that a code stands for, in scaled whole numbers."""
    return [int(c) for p, entry in enumerate(bytes.fromhex(code)) for c in books[p, entry]]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    books = train(vectors, parts, entries, rounds)
    coded = Tables(vectors.sparkSession).put(encode(vectors, books), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", F.col("label_error").cast("long").alias("label_error"), F.lit(books_digest(books)).alias("codebooks_sha256")
    )
