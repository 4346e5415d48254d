"""Embedding near-dedup by a pivot-permutation index.

Vectors are described by the ordered list of their nearest reference points
(pivots).  What a label's vectors have in common is taken off first: ordinary
embeddings share a direction, and so may those of one label, beside which all would
look alike.  It is the mean of the sample's vectors of that label, or of the whole
sample if it holds fewer than FEW of them, near copies counted once.  Where all
are so alike (MOST_COMMON) that the rest would be noise, nothing is taken off, and
they are compared whole.  This serves the index alone; cosines are those of the vectors.
Every pivot has an inverted list of the vectors that name it.  The
lists give, for each pair, the number of pivots shared; pairs that share
``min_shared`` or more are candidates, and only their cosines are worked out, in
double precision, and held against ``threshold``.  Pivots are vectors of the
table itself, those with the smallest digests: a bounded sample, whose size grows
with the table up to ``PIVOT_BYTES``.  Of pivots at one distance the one with the
smaller number is nearer.  A pivot whose cosine with an earlier
one reaches ``APART`` is left out: a dense group, however large, has few pivots of
its own, which all its members name, and recall doesn't fall with the group's
size; lists of dense groups grow with them and are compared whole.  Every vector
is indexed; recall against brute force is a test.

Whole copies are one class with a count, so copies are never paired.  Lists are
dealt out in blocks: a list of c chunks becomes its pairs of chunks, each a task
of its own of at most two chunks; no list, however long, comes together.  A
block returns sums, not pairs: for each vector its number of links and the least
vector of its component there.  A pair is a candidate in the list of its smallest
shared pivot only.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, or whose label is null, link with nothing; so do vectors of different
length; repeated rows are vectors of their own and link with each other; rows with
a null id take part, and have a null component if no other id is reached; rows with
one id and different vectors are told apart by their vectors and keep a row each;
nothing has a size limit; an empty table gives an empty result; only id, label and
vector are read, so extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from evigraph.llm.common import Tables
from evigraph.llm.components import components

PER_PIVOT = 25
MIN_PIVOTS, PIVOT_BYTES = 48, 32 << 20
NEAREST, MIN_SHARED = 12, 3
APART = 0.5
CHUNK = 512
#: Different sample vectors that make a label's mean, those that it is taken of at most, their cosine to be near copies, and the mean cosine from which on nothing is taken off.
FEW, MEAN_OF, COPIES, MOST_COMMON = 8, 4096, 0.9, 0.82
#: Products of rows and pivots that are held at a time.
HELD = 1 << 21


def usable(vector: str = "embedding", label: str = "label"):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """One row for each different (label, vector): rep, mult, and the digests that members are joined by."""
    rows = vectors.where(usable()).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    digests = [F.xxhash64("label", "v").alias("h1"), F.xxhash64("v", "label", F.lit(1)).alias("h2")]
    # single precision travels as such; cosines are worked out in double
    own = vectors.schema["embedding"].dataType.elementType
    vector = F.first("v").cast(ArrayType(own)) if isinstance(own, FloatType) else F.first("v")
    return rows.groupBy(*digests).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), vector.alias("v"))


def apart(vectors: np.ndarray, most: float = APART) -> np.ndarray:
    """Unit vectors, in order, without those too close to an earlier one that stays."""
    out = np.empty_like(vectors)
    n = 0
    for v in vectors:
        if n == 0 or (out[:n] @ v).max() < most:
            out[n] = v
            n += 1
    return out[:n]


def in_common(unit: np.ndarray) -> np.ndarray | None:
    """The mean of different vectors; zero if that is nearly all there is of them; None if they are too few."""
    different = apart(unit, COPIES)
    if len(different) < FEW:
        return None
    mean = different.mean(axis=0)
    return mean if mean @ mean <= MOST_COMMON else np.zeros_like(mean)


class Pivots:
    """Reference points of vectors of one length, and the directions that are taken off before."""

    def __init__(self, labels: list, vectors: np.ndarray):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        whole = in_common(unit[:MEAN_OF])
        self.mean = np.zeros(unit.shape[1]) if whole is None else whole
        places: dict = {}
        for i, label in enumerate(labels[:MEAN_OF]):
            places.setdefault(label, []).append(i)
        found = {label: in_common(unit[at]) for label, at in places.items()}
        self.of_label = {label: mean for label, mean in found.items() if mean is not None}
        self.points = apart(self.residual(labels, unit))

    def residual(self, labels: list, unit: np.ndarray) -> np.ndarray:
        """What is left of unit vectors, scaled to 1; zeros stay zeros."""
        left = unit - np.stack([self.of_label.get(label, self.mean) for label in labels])
        size = np.linalg.norm(left, axis=1, keepdims=True)
        return np.divide(left, size, out=np.zeros_like(left), where=size > 1e-9)

    def order(self, labels: list, vectors: np.ndarray, nearest: int) -> np.ndarray:
        """Numbers of the nearest points, nearest first, slice by slice of the rows."""
        n = min(nearest, len(self.points))
        out = np.empty((len(vectors), n), np.int32)
        step = max(1, HELD // len(self.points))
        for a in range(0, len(vectors), step):
            x = vectors[a : a + step]
            x = self.residual(labels[a : a + step], x / np.linalg.norm(x, axis=1, keepdims=True))
            far = -(x @ self.points.T)
            some = np.sort(np.argpartition(far, n - 1, axis=1)[:, :n], axis=1)
            place = np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable")
            out[a : a + step] = np.take_along_axis(some, place, axis=1)
        return out


def describe(rows: DataFrame, pivots: dict[int, Pivots], nearest: int) -> DataFrame:
    """Adds ``order``: the numbers of the nearest pivots, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            sizes = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy()
            ends = np.cumsum(sizes)
            order: list[list[int]] = [[] for _ in sizes]
            for dim in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == dim)
                for a in range(0, len(which), 1000):
                    some = which[a : a + 1000]
                    x = np.stack([values[ends[i] - dim : ends[i]] for i in some]).astype(float)
                    got = pivots[dim].order([labels[i] for i in some.tolist()], x, nearest)
                    for i, o in zip(some.tolist(), got.tolist(), strict=True):
                        order[i] = o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order, pa.list_(pa.int32()))], names=[*batch.schema.names, "order"])

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1] + ",order:array<int>")


def candidates(left: np.ndarray, right: np.ndarray, pivot: int, least: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share ``least`` pivots and none smaller than this list's: a product of the block's inverted lists counts them."""
    width = left.shape[1]
    named, at = np.unique(np.concatenate([left, right]).ravel(), return_inverse=True)
    lists = np.zeros((len(left) + len(right), len(named)), np.float32)
    lists[np.repeat(np.arange(len(lists)), width), at] = 1
    x, y = lists[: len(left)], lists[len(left) :]
    smaller = int(np.searchsorted(named, pivot))
    found = x @ y.T >= least
    found &= x[:, :smaller] @ y[:, :smaller].T == 0
    return np.nonzero(np.triu(found, 1) if same else found)


def compare(batch: list[pd.DataFrame], threshold: float, min_shared: int) -> pd.DataFrame:
    """Sums for one block: rows of chunk pair (i, j) of one list; those of chunk i have side 0."""
    rows = pd.concat(batch, ignore_index=True) if len(batch) > 1 else batch[0].reset_index(drop=True)
    same = bool(rows["i"].iloc[0] == rows["j"].iloc[0])
    pivot = int(rows["pivot"].iloc[0])
    v = np.stack(rows["v"].to_numpy()).astype(float)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    order = np.stack(rows["order"].to_numpy())
    min_shared = min(min_shared, order.shape[1])  # a table of one dense group has one pivot
    first = np.arange(len(rows)) if same else np.flatnonzero(rows["side"].to_numpy() == 0)
    second = first if same else np.flatnonzero(rows["side"].to_numpy() == 1)
    rep, mult = rows["rep"].to_numpy(), rows["mult"].to_numpy()
    links = np.zeros(len(rows), np.int64)
    root = np.arange(len(rows))
    a, b = candidates(order[first], order[second], pivot, min_shared, same)
    a, b = first[a], second[b]
    whole = v[first] @ v[second].T if 16 * len(a) > len(first) * len(second) else None
    place = np.empty(len(rows), np.int64)
    for at in range(0, len(a), 20_000):
        x, y = a[at : at + 20_000], b[at : at + 20_000]
        if whole is None:
            cosine = np.einsum("ij,ij->i", v[x], v[y])
        else:
            place[second] = np.arange(len(second))
            columns = place[y]
            place[first] = np.arange(len(first))
            cosine = whole[place[x], columns]
        x, y = x[cosine >= threshold], y[cosine >= threshold]
        np.add.at(links, x, mult[y])
        np.add.at(links, y, mult[x])
        # all links are kept as edges to a local root: union by repeated minimum
        root = _union(root, x, y, rep)
    out = pd.DataFrame({"rep": rep, "links": links, "root": rep[root]})
    return out[(out["links"] > 0) | (out["root"] != out["rep"])]


def _union(root: np.ndarray, x: np.ndarray, y: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Components of the links so far and x-y, labelled by the position of their least rep."""
    rank = np.argsort(np.argsort(rep, kind="stable"), kind="stable")
    back = np.argsort(rank)
    label = rank[root]
    while True:
        a, b = label[x], label[y]
        if (a == b).all():
            return back[label]
        # every root of a link goes to the least root that it is linked to, and all follow to the end
        up = np.arange(len(rep))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def link(vectors: DataFrame, threshold: float = 0.93, nearest: int = NEAREST, min_shared: int = MIN_SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    tables = Tables(spark)
    reps = tables.put(classes(vectors), "classes")
    facts = reps.groupBy(F.size("v").alias("dim")).count().collect()  # one row a vector length
    pivots: dict[int, Pivots] = {}
    for row in facts:
        n = int(max(MIN_PIVOTS, min(row["count"] // PER_PIVOT, PIVOT_BYTES // (8 * row["dim"]))))
        got = reps.where(F.size("v") == row["dim"]).orderBy("h1", "h2").limit(n).select("label", "v").collect()
        pivots[row["dim"]] = Pivots([g["label"] for g in got], np.array([g["v"] for g in got], float))
    described = describe(reps.select("rep", "mult", "label", "v"), pivots, nearest)
    listed = described.select("*", F.size("v").alias("dim"), F.explode("order").alias("pivot"))
    listed = tables.put(listed, "lists") if facts else listed
    place = ["label", "dim", "pivot"]
    sizes = listed.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    # few lists have more than a chunk; only their sizes are joined
    many = sizes.where("chunks > 1")
    chunked = listed.join(many, place, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunked = chunked.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(
        *place, "rep", "mult", "v", "order", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    block = [*place, "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = tables.put(dealt.repartition(parts, *block).sortWithinPartitions(*block).mapInPandas(_blocks(block, threshold, min_shared), "rep long, links long, root long"), "sums")
    tables.remove("lists")
    linked = sums.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(sums.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        reps.select("h1", "h2", "rep", "mult")
        .join(linked, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root"))
    )
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    ok = usable()
    rows = vectors.select(
        "vec_id", F.when(ok, F.xxhash64("label", v)).alias("h1"), F.when(ok, F.xxhash64(v, "label", F.lit(1))).alias("h2")
    )
    return rows.join(known, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"),
    )


def _blocks(block: list[str], threshold: float, min_shared: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        done: list[pd.DataFrame] = []
        for batch in batches:
            keys = batch[block].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if held and key != last:
                    done.append(compare(held, threshold, min_shared))
                    held = []
                held.append(batch.iloc[a:b])
                last = key
            if len(done) >= 200:
                yield pd.concat(done)
                done = []
        if held:
            done.append(compare(held, threshold, min_shared))
        if done:
            yield pd.concat(done)

    return run
