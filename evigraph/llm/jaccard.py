"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document's set holds its distinct runs of ``SHINGLE`` words (all its words as
one run if it has fewer).  Two documents link when 100 * |intersection| >=
``percent`` * |union|.  The result is exact: bounds that follow from the sets'
sizes only discard pairs that can't link.

1.  One pass gives each document's set size and a digest of its set; documents
    with equal sets are one class from here on.  The same pass sums up the most
    frequent n-grams (a mergeable summary of bounded size).
2.  All n-grams are put in one order: first those outside the summary, by hash,
    then the summary's, rare ones first.  Of a set of n only the first
    n - ceil(0.75 n) + 1 n-grams are needed: linked sets share one of these.
    They are the entries of the incidence matrix, one row each, dealt out by
    n-gram into blocks of columns; their number does not depend on the blocks.
3.  A block is sorted and multiplied as a stream.  Columns of at most ``SMALL``
    classes give their pairs.  Longer columns give pairs with one leader only, the
    class with the fewest n-grams before this one, and are kept aside.  Overlaps
    are summed over the blocks, and pairs whose sizes, places or sums leave too
    little room for the needed overlap are discarded.
4.  Those pairs are verified on the documents' whole sets, and the links are
    joined to components.
5.  What is left are pairs in long columns that lie in different components.
    Columns in one component are done.  The others are joined by n-gram and
    classes of the sizes that sets and places allow, so that entries which can't
    link don't meet; the sums discard more pairs, and the rest is verified.

Components need no more links than that: pairs inside a component that the
verified links already join are never made, so a group of copies costs rows in
proportion to its size.  ``pairs`` is the whole join, with all links between
different sets.

Defined cases: null text, or text without words, has an empty set and links with
nothing; equal rows, and rows with one id, keep their own rows; a null id takes
part, and its component is the least non-null id reached, or null; very long
texts are taken whole; an empty table gives an empty result; only id and text are
read, so extra columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evigraph.llm.common import Tables
from evigraph.llm.components import components
from evigraph.llm.wordhash import grams, raw_words, trim

SHINGLE = 5
PERCENT = 75
SMALL = 8
SUMMARY = 1 << 17
TASK_SUMMARY = 1 << 16
COUNT_TOKENS = 2_000_000
#: Entries of the incidence matrix a task and, there, a slice; neither changes what is computed or how many rows travel.
BLOCK_TOKENS = 1_000_000
SLICE = 200_000
SEEN = 200_000
#: A long column's entries of a pair of size classes that one task compares with as many others.
CHUNK = 4000
#: Size classes a factor of 4 / 3, the largest between linked sets.
CLASSES = 4
SALTS = 16
MAX_COLLIDED = 100_000
BLOOM_BITS = (1 << 16, 1 << 27)


def shingles(words: np.ndarray) -> np.ndarray:
    """A text's set, from its words' hashes, as sorted 64-bit hashes."""
    return np.unique(grams(words, min(SHINGLE, len(words)))) if len(words) else words


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def prefix_length(n):
    return n - (PERCENT * n + 99) // 100 + 1


def least_overlap(n, m):
    """Smallest intersection of sets of n and m that links them: 100 i >= p (n + m - i)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class Summary:
    """Misra-Gries summary of n-gram counts; any number of them can be added up."""

    def __init__(self, size: int):
        self.size = size
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
        if len(keys) > self.size:
            counts = counts - np.partition(counts, len(keys) - self.size - 1)[len(keys) - self.size - 1]
        self.keys, self.counts = keys[counts > 0], counts[counts > 0]


FACTS = "kind string, n long, f1 long, f2 long"


NAMES = ["kind", "n", "f1", "f2"]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    summary, waiting, size, kept = Summary(TASK_SUMMARY), [], 0, []

    def fold() -> None:
        nonlocal size
        if waiting:
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            summary.add(keys, counts)
        waiting.clear()
        size = 0

    for batch in batches:
        rows = []
        for words in raw_words(batch.column(1)):
            s = shingles(words)
            rows.append((len(s), *fingerprint(s)))
            waiting.append(s)
            size += len(s)
            if size >= COUNT_TOKENS:
                fold()
        n, f1, f2 = zip(*rows, strict=True) if rows else ((), (), ())
        facts = [pa.array(["d"] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in (n, f1, f2))]
        carried = [c for i, c in enumerate(batch.columns) if i != 1]
        kept = [*zip((f.name for i, f in enumerate(batch.schema) if i != 1), (c.type for c in carried), strict=True)]
        yield pa.RecordBatch.from_arrays([*facts, *carried], names=[*NAMES, *(name for name, _ in kept)])
    fold()
    held = np.flatnonzero(summary.counts > 0)
    m = len(held)
    if m:
        found = [pa.array(["s"] * m, pa.string()), pa.array(summary.counts[held]), pa.array(summary.keys[held].view(np.int64)), pa.nulls(m, pa.int64())]
        yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(m, t) for _, t in kept)], names=[*NAMES, *(name for name, _ in kept)])
    trim()


def in_order(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the global order: by hash, then the frequent n-grams, rare ones first."""
    if not len(hot):
        return s
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    frequent = s[is_hot]
    return np.concatenate([s[~is_hot], frequent[np.argsort(rank[at[is_hot]])]])


PREFIX = "token long, node long, n int, place int"


def node_of(print_: tuple[int, int], collided: frozenset) -> int:
    """The number of a class: half of its set's digest, the other half where sets share the first."""
    return print_[1] if print_[0] in collided else print_[0]


def _prefixes(hot: np.ndarray, rank: np.ndarray, collided: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        first, nodes, sizes, ready = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal ready
            many = np.array([len(f) for f in first])
            starts = np.repeat(np.cumsum(many) - many, many)
            columns = [np.concatenate(first).view(np.int64), np.repeat(np.array(nodes, np.int64), many), np.repeat(np.array(sizes, np.int32), many), (np.arange(len(starts)) - starts).astype(np.int32)]
            first.clear(), nodes.clear(), sizes.clear()
            ready = 0
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "place"])

        for batch in batches:
            for words in raw_words(batch.column(0)):
                s = shingles(words)
                if not len(s):
                    continue
                node = node_of(fingerprint(s), collided)
                if node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                first.append(in_order(s, hot, rank)[: prefix_length(len(s))])
                nodes.append(node), sizes.append(len(s))
                ready += len(first[-1])
                if ready >= SLICE:
                    yield out()
        if ready:
            yield out()
        trim()

    return run


#: kind 0 and 1: pair (a, b) of sets of n and place, found in c small columns or with a leader, 1 if it may link;
#: 2: entry (token a, class b) of a long column, for a set of n, at this place.
PRODUCT = "kind int, a long, b long, n int, place int, c int"


def possible(n, i, m, j):
    """Can sets of n and m with a common n-gram at places i and j, none before, overlap enough?"""
    return 1 + np.minimum(n - i - 1, m - j - 1) >= least_overlap(n, m)


def similar_size(n, m):
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def table(kind: int, a, b, n, place, c) -> list[np.ndarray]:
    return [np.full(len(a), kind, np.int32) if np.isscalar(kind) else kind, a, b, n, place, np.full(len(a), c, np.int32) if np.isscalar(c) else c]


def small_pairs(token: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """All pairs of small columns, entries sorted by token, with the number of columns that gave them."""
    found = []
    for d in range(1, SMALL):
        x = np.flatnonzero(token[d:] == token[:-d]) if len(token) > d else np.empty(0, np.int64)
        y = x + d
        close = similar_size(n[x], n[y])
        x, y = x[close], y[close]
        swap = node[x] > node[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        found.append(np.stack([node[x], node[y], n[x], n[y], possible(n[x], place[x], n[y], place[y])], 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    start = np.flatnonzero((np.diff(rows[:, :2], axis=0, prepend=rows[:1, :2] - 1) != 0).any(axis=1))
    if not len(start):
        return table(0, *rows.T[:4], 0)
    # places tell whether any common n-gram leaves room; all are counted, since that bounds the overlap
    fits = np.maximum.reduceat(rows[:, 4], start).astype(np.int32)
    return table(fits, *rows[start].T[:4], np.diff(np.append(start, len(rows))).astype(np.int32))


class LongColumn:
    """A column of more than SMALL classes, in slices: its entries, and one pair an entry with a leader of similar size."""

    def __init__(self):
        self.token, self.leaders = None, []

    def extend(self, token: int, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> list[list[np.ndarray]]:
        if token != self.token:
            self.token, self.leaders = token, []
        out = [table(2, np.full(len(node), token), node, n, place, 0)]
        rest, at = np.arange(len(node)), 0
        while len(rest):
            if at == len(self.leaders):  # the class with the fewest n-grams before this one
                self.leaders.append((node[rest[0]], n[rest[0]], place[rest[0]]))
                rest = rest[1:]
            lead, size, spot = self.leaders[at]
            close = similar_size(n[rest], size)
            x = rest[close & (node[rest] != lead)]
            x = x[possible(n[x], place[x], size, spot)]
            low = node[x] < lead
            out.append(table(1, np.minimum(node[x], lead), np.maximum(node[x], lead), np.where(low, n[x], size), np.where(low, size, n[x]), 0))
            rest, at = rest[~close], at + 1
        return out


def multiply(rows: list[np.ndarray], last: bool, long: LongColumn) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """Product of entries (token, node, n, place) sorted by token, place and node; also returns those whose column may go on."""
    # a class comes once for each task that met it
    fresh = np.ones(len(rows[0]), bool)
    fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    token, node, n, place = (c[fresh] for c in rows)
    n, place = n.astype(np.int64), place.astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(start, len(token)))
    out, kept = [], len(start)
    is_long = size > SMALL
    is_long[0] |= long.token is not None and token[0] == long.token
    if not last and size[-1] < SLICE // 2 and not (len(start) == 1 and is_long[0]):
        kept -= 1  # wait for the rest of it
    for s, m in zip(start[:kept][is_long[:kept]].tolist(), size[:kept][is_long[:kept]].tolist(), strict=True):
        out += long.extend(int(token[s]), node[s : s + m], n[s : s + m], place[s : s + m])
    small = np.flatnonzero(np.repeat(~is_long & (size > 1) & (np.arange(len(size)) < kept), size))
    if len(small):
        out.append(small_pairs(token[small], node[small], n[small], place[small]))
    end = start[kept] if kept < len(start) else len(token)
    return out, [c[end:] for c in (token, node, n, place)]


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a partition in slices: no column is held whole."""
    waiting, size, long = [], 0, LongColumn()

    def of(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, size
        out, rest = multiply([np.concatenate(c) for c in zip(*waiting, strict=True)], last, long)
        waiting, size = ([rest], len(rest[0])) if len(rest[0]) else ([], 0)
        if out:
            kind, a, b, n, place, c = (np.concatenate(x) for x in zip(*out, strict=True))
            for at in range(0, len(kind), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind[cut], pa.int32()), pa.array(a[cut]), pa.array(b[cut]), pa.array(n[cut].astype(np.int32)), pa.array(place[cut].astype(np.int32)), pa.array(c[cut], pa.int32())],
                    names=["kind", "a", "b", "n", "place", "c"],
                )

    for batch in batches:
        if batch.num_rows:
            waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            size += batch.num_rows
        if size >= SLICE:
            yield from of(False)
    if size:
        yield from of(True)
    trim()


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits of the ids' hashes, of bounded size; more ids than it is made for only let more rows through."""
    n = ids.count()
    bits = BLOOM_BITS[0]
    while bits < min(16 * n, BLOOM_BITS[1]):
        bits *= 2
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    word, bit = F.floor(at / 32).cast("long"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}) % 32 as int))")
    words = ids.select(word.alias("w"), bit.alias("b"))
    out = np.zeros(bits // 32, np.uint32)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most bits / 32 rows
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def _texts(bloom: np.ndarray, collided: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(0).filter(pa.array((bloom[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)))
            rows = []
            for text, words in zip(texts, raw_words(texts), strict=True):
                if len(words):
                    rows.append((node_of(fingerprint(shingles(words)), collided), pack.compress(text.as_py().encode("utf-8", "surrogatepass"))))
            if rows:
                a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary())], names=["node", "body"])
        trim()

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, kept = zstandard.ZstdDecompressor(), OrderedDict()

    def set_of(node: int, body) -> np.ndarray:
        s = kept.get(node)
        if s is None:
            text = pa.array([unpack.decompress(body.as_py())]).cast(pa.string(), safe=False)
            s = kept[node] = shingles(next(raw_words(text)))
            if len(kept) > 500:
                kept.popitem(last=False)
        return s

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        links = []
        for i in range(len(a)):
            x, y = set_of(a[i], batch.column(2)[i]), set_of(b[i], batch.column(3)[i])
            if len(x) > len(y):
                x, y = y, x
            if 100 * len(x) >= PERCENT * len(y):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if int((y[at] == x).sum()) >= least_overlap(len(x), len(y)):
                    links.append((a[i], b[i]))
        if links:
            u, v = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["a", "b"])
    trim()


def verify(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes, those that link."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = corpus.classes.join(nodes, "node").select(F.coalesce("rep", F.lit(-1).cast("long")).alias("doc_id"))
    bits = _bloom(wanted)
    at = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long"))), F.lit(32 * len(bits)))
    bodies = corpus.rows.select("text", at.alias("at")).mapInArrow(_texts(bits, corpus.collided), "node long, body binary")
    # a copy of a wanted document can pass the bits too: one text a class
    bodies = bodies.join(nodes, "node", "left_semi").groupBy("node").agg(F.min_by("body", F.length("body")).alias("body"))
    bodies = corpus.tables.put(bodies, "bodies")
    # the smaller number may be a leader with very many pairs: it comes last, when large partitions can be split
    both = pairs.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b").join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    links = corpus.tables.put(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "links")
    corpus.tables.remove("bodies")
    return links


def _rest(n: str):
    """How many n-grams of a set of n aren't in its prefix."""
    return F.ceil(F.col(n) * PERCENT / 100) - 1


def bounded(pairs: DataFrame, in_long: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, n_a, n_b, c) whose accumulated overlap leaves room for a link.

    In the order of n-grams one of the two prefixes ends first.  What it holds
    beyond the c + c' common n-grams is in the other set nowhere, so the overlap
    is at most c + c' and the rest of that set.  c counts the small columns; c' in
    the long ones is at most the entries that either set has there.
    """
    m = lambda end: in_long.select(F.col("node").alias(end), F.col("m").alias(f"m_{end}"))
    rows = pairs.join(m("a"), "a", "left").join(m("b"), "b", "left")
    most = F.col("c") + F.least(F.coalesce("m_a", F.lit(0)), F.coalesce("m_b", F.lit(0)))
    needed = F.ceil(F.lit(PERCENT) * (F.col("n_a") + F.col("n_b")) / (100 + PERCENT))
    return rows.where(most + F.greatest(_rest("n_a"), _rest("n_b")) >= needed).select("a", "b")


def meet(entries: DataFrame, across: bool) -> DataFrame:
    """(a, b, n_a, n_b): pairs of entries (token, node, root, n, place) of one column that sizes and places let link.

    A set of n whose entry leaves r n-grams (itself included) can only link with
    sets of up to ``most`` = (100 + p) r / p - n.  Of a pair the smaller set comes
    with the classes of sizes that it may link with above, the larger one with
    those below, so entries that the bounds rule out have no key in common.
    Entries of one key are dealt out in chunks, and pairs of chunks are joined.
    ``across`` leaves out pairs of one component.
    """
    step = math.log(100 / PERCENT) / CLASSES
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.lit(step)).cast("int")
    n, r = F.col("n"), F.col("n") - F.col("place")
    e = entries.withColumn("most", F.floor((100 + PERCENT) * r / PERCENT) - n)
    above, below = F.least("most", F.floor(n * 100 / PERCENT)), F.ceil(n * PERCENT / 100)
    key, carried = ["token", "ks", "kl"], ["node", "root", "n", "most"]
    smaller = e.where(above >= n).select("token", *carried, size_class(n).alias("ks"), F.explode(F.sequence(size_class(n), size_class(above))).alias("kl"))
    larger = e.where(F.least(F.col("most"), n) >= below)
    larger = larger.select("token", *carried, size_class(n).alias("kl"), F.explode(F.sequence(size_class(below), size_class(F.least(F.col("most"), n)))).alias("ks"))
    counts = smaller.select(*key, F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(larger.select(*key, F.lit(0).alias("s"), F.lit(1).alias("t")))
    # a key is alive if at least two entries meet there
    counts = counts.groupBy(*key).agg(F.sum("s").alias("s"), F.sum("t").alias("t")).where("s > 0 AND t > 0 AND s + t > 2")
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    counts = counts.select(*key, chunks("s").alias("cs"), chunks("t").alias("ct"))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = smaller.join(counts, key).select(*key, *carried, own("cs").alias("i"), every("ct").alias("j")).alias("x")
    y = larger.join(counts, key).select(*key, *carried, own("ct").alias("j"), every("cs").alias("i")).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*key, "i", "j")]
    xn, yn = F.col("x.n"), F.col("y.n")
    fits = (100 * xn >= PERCENT * yn) & (yn <= F.col("x.most")) & (xn <= F.col("y.most")) & ((xn < yn) | (xn == yn) & (F.col("x.node") < F.col("y.node")))
    met = x.join(y, functools.reduce(lambda p, q: p & q, same) & fits & ((F.col("x.root") != F.col("y.root")) if across else F.lit(True)))
    low = F.col("x.node") < F.col("y.node")
    ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.when(low, xn).otherwise(yn).alias("n_a"), F.when(low, yn).otherwise(xn).alias("n_b")]
    return met.select(*ends).distinct()


@dataclass
class Corpus:
    """Rows, their facts, the classes of equal sets, and the product of their prefixes."""

    tables: Tables
    rows: DataFrame
    own: DataFrame
    classes: DataFrame
    collided: frozenset
    product: DataFrame

    def counted(self) -> DataFrame:
        """Pairs from the product: c common n-grams in small columns; kind tells if the pair may link."""
        return self.product.where("kind < 2").groupBy("a", "b").agg(
            F.sum("c").alias("c"), F.max("kind").alias("kind"), F.first("n").alias("n_a"), F.first("place").alias("n_b")
        )

    def entries(self) -> DataFrame:
        return self.product.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("node"), "n", "place")

    def in_long(self) -> DataFrame:
        """How many entries in long columns a class has."""
        return self.product.where("kind = 2").groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("m"))


def prepare(docs: DataFrame, text: str, key: str, carry: tuple[str, ...] = ()) -> Corpus:
    """Steps 1 to 3."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)
    schema = StructType([*StructType.fromDDL(FACTS).fields, *(f for f in rows.schema if f.name != "text")])
    facts = tables.put(rows.mapInArrow(_describe, schema), "facts")
    own = facts.where("kind = 'd'").drop("kind")
    sets = tables.put(own.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "sets")
    # different sets with one half of their digests in common: none until there are billions, and few then
    twice = sets.groupBy("f1").count().where("count > 1").select("f1").limit(MAX_COLLIDED + 1).collect()
    if len(twice) > MAX_COLLIDED:
        raise RuntimeError("too many sets share half a digest")
    collided = frozenset(r["f1"] for r in twice)
    number = F.when(F.col("f1").isin(sorted(collided)), F.col("f2")).otherwise(F.col("f1")) if collided else F.col("f1")
    classes = sets.select(number.alias("node"), "rep", "n")
    top = facts.where("kind = 's'").groupBy("f1").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "f1").limit(SUMMARY).toPandas()  # bounded
    hot = top["f1"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    rank = np.arange(len(hot))[::-1][order]
    shared_hot, shared_rank = spark.sparkContext.broadcast(hot[order]), spark.sparkContext.broadcast(rank)
    total = sets.agg(F.sum(F.floor(F.col("n") * (100 - PERCENT) / 100) + 1)).first()[0] or 0
    parts = max(8, -(-int(total) // BLOCK_TOKENS))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefixes(shared_hot.value, shared_rank.value, collided)(batches)

    entries = rows.select("text").mapInArrow(prefixes, PREFIX).repartition(parts, "token").sortWithinPartitions("token", "place", "node")
    product = tables.put(entries.mapInArrow(_multiply, PRODUCT), "product")
    return Corpus(tables, rows, own.withColumn("node", F.when(F.col("n") > 0, number)), classes, collided, product)


def pairs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The whole join: all links (a, b) between classes of equal sets, and (doc_id, n_shingles, node) of every row.

    As many rows as there are links between different sets, so a dense group of
    k near copies has up to k * k / 2.
    """
    corpus = prepare(docs, text, key)
    small = corpus.counted().select("a", "b", "c", "n_a", "n_b", "kind")
    long = meet(corpus.entries().withColumn("root", F.col("node")), across=False).withColumn("found", F.lit(1))
    every = small.join(long, ["a", "b", "n_a", "n_b"], "full_outer").where("kind = 1 OR found = 1").withColumn("c", F.coalesce("c", F.lit(0)))
    links = verify(corpus, corpus.tables.put(bounded(every, corpus.in_long()), "pairs")).distinct()
    corpus.tables.remove("pairs", "product")
    return links, corpus.own.select("doc_id", F.col("n").alias("n_shingles"), "node")


def link(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, root (the component's number; null for an empty set) and the columns to carry, for every row."""
    corpus = prepare(docs, text, key, carry)
    tables, counted, in_long = corpus.tables, corpus.counted(), corpus.in_long()
    tested = tables.put(bounded(counted.where("kind = 1"), in_long), "pairs")
    links = verify(corpus, tested)
    roots = tables.put(components(links), "roots")

    entries = corpus.entries().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = entries.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("token")
    # salted: one n-gram may have a third of all entries
    open_ = open_.select("token", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    entries = tables.put(entries.join(open_, ["token", "salt"], "left_semi").drop("salt"), "entries")
    if not entries.isEmpty():
        met = meet(entries, across=True)
        met = met.join(tested, ["a", "b"], "left_anti").join(counted.select("a", "b", "c"), ["a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
        more = verify(corpus, tables.put(bounded(met, in_long), "rest"))
        tables.remove("roots")
        roots = tables.put(components(links.unionByName(more)), "roots")
    tables.remove("pairs", "links", "entries", "rest", "product")

    nodes = corpus.classes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = nodes.join(least, "root").select("node", "component_id", "root")
    joined = corpus.own.join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component, "root", *carry)
