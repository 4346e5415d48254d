"""Token ids in a content-addressed store.

Texts become token ids with the tokenizers library and every document ends with
one more id.  A rolling hash over the last ``SPAN`` ids cuts each document's
ids into chunks where its low bits are zero, so equal passages give equal
chunks wherever they stand.  A chunk's key is the BLAKE2b digest of its bytes.

Files.  ``pack`` holds each chunk once (kind ``c``: key and payload, ids as
little-endian 16- or 32-bit integers by the vocabulary's size) and a recipe for
each document (kind ``r``: its chunks' keys).  ``recipes`` holds the recipes in
ascending doc_id order with each document's position and first id's offset.
``manifest`` is a Merkle tree: leaves are the recipes' digests in that order and
a node covers up to ``FANOUT`` nodes below; level by level up to one root.

Reading back recomputes every chunk's key from its payload and every Merkle
node from what it covers, and stops at the first difference.

One shuffle moves the new ids, by chunk key; chunks repeated within a task are
emitted once.  Chunks are joined to recipes by narrow rows (key, length,
checksum), never with their payload.

Encoding.  Byte-level BPE works on pieces that no merge crosses.  The ids of a
piece come from the library's model and are kept, two generations of at most
``CACHE``, so that the words of a text are looked up.  Other tokenizers, and texts that hold a
special token's string, go through the library whole.

Defined cases: null text is empty and has only the end id; a null doc_id comes
first; rows with the same doc_id are ordered by their ids' digest, and whole copies
are interchangeable; very long texts are encoded and stored whole; an empty table
gives an empty result; only doc_id and text are read, so extra columns may have any
name.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.llm.common import materialize_at, new_path

END_ID = 2
SPAN = 16
CUT_MASK = 255
LEAST, MOST = 64, 1024
KEY_BYTES = 16
FANOUT = 1024
CACHE = 700_000
PACK = "kind string, key binary, payload binary, doc_id long, n_tokens long, keys binary"
#: Fixed value: how byte-level BPE splits a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Unsafe(Exception):
    """A unit whose ends could belong to a neighbour's piece."""


class _Kept(dict):
    """Ids as bytes of what was asked for; of two generations the older one goes when the newer one is full."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, text: str) -> bytes:
        value = self.older.get(text)
        if value is None:
            value = self.make(text)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[text] = value
        return value


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.fast = (
            spec["model"].get("type") == "BPE" and not spec.get("normalizer") and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not spec.get("truncation") and not spec.get("padding") and all(t["special"] for t in spec.get("added_tokens", ()))
        )
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.letter = "H" if self.dtype.itemsize == 2 else "I"
        self.short = [struct.Struct(f"<{n}{self.letter}").pack for n in range(32)]
        self.model = self.tokenizer.model
        self.tokenize = self.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes_as = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.space = self.bytes_as[32]
        self.pieces_of = regex.compile(PIECES).findall
        self.pieces, self.heads, self.units = _Kept(self.model_ids, CACHE // 4), _Kept(self.at_start, CACHE // 4), _Kept(self.after_space, CACHE)

    def pack(self, ids: list[int]) -> bytes:
        n = len(ids)
        return self.short[n](*ids) if n < len(self.short) else struct.pack(f"<{n}{self.letter}", *ids)

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def model_ids(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.bytes_as[32])
        else:
            shown = piece.encode().decode("latin-1").translate(self.bytes_as)
        return self.pack([t.id for t in self.tokenize(shown)])

    def after_space(self, word: str) -> bytes:
        """Ids of a word and the single space before it."""
        if word.isascii():  # most words
            if word.isalpha():
                return self.pack([t.id for t in self.tokenize(self.space + word)])
            if word[-1:] in (",", ".") and word[:-1].isalpha():
                return self.units[word[:-1]] + self.pieces[word[-1]]
        return self.word(" ", word, self.units)

    def at_start(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            return self.pack([t.id for t in self.tokenize(word)])
        return self.word("", word, self.heads)

    def word(self, before: str, word: str, kept: _Kept) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Unsafe
        if not word.isascii() and max(word) >= "ɐ":  # letters that Unicode versions may class differently
            return self.whole(before + word)
        if word.isalpha():
            return self.model_ids(before + word)
        if word[-1] in ".," and word[:-1].isalpha():
            return kept[word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.pieces_of(before + word)))

    def line(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        return self.heads[first] + b"".join(map(self.units.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.fast or any(s in text for s in self.special):
            return self.whole(text)
        try:
            # a single line end between others' characters is a piece of its own
            return self.pieces["\n"].join(map(self.line, text.split("\n"))) if "\n" in text else self.line(text)
        except _Unsafe:
            if max(text) >= "ɐ":
                return self.whole(text)
            return b"".join(map(self.pieces.__getitem__, self.pieces_of(text)))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        factor, width = np.uint64(0xBF58476D1CE4E5B9), 1
        while width < SPAN:  # windows of 2, 4, 8, 16 ids
            h[width:] += h[:-width] * factor
            factor *= factor
            width *= 2
        h ^= h >> np.uint64(32)
    spots = np.flatnonzero((h & np.uint64(CUT_MASK)) == 0) + 1
    ends, last = [], 0
    for spot in [*spots.tolist(), n]:
        while spot - last > MOST:
            last += MOST
            ends.append(last)
        if spot - last >= LEAST or spot == n and spot > last:
            ends.append(spot)
            last = spot
    return ends


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY_BYTES).digest()


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, text: str = "text") -> dict[str, str]:
    """Encodes and stores all rows; returns the paths of pack, recipes and manifest."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        end = encoder.pack([end_id])
        width = encoder.dtype.itemsize
        part, row, seen = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder.encode(body.as_py() or "") + end
                last, keys = 0, []
                for stop in cuts(np.frombuffer(data, encoder.dtype)):
                    payload = data[last * width : stop * width]
                    last = stop
                    key = _digest(payload)
                    keys.append(key)
                    if key not in seen:
                        if len(seen) >= CACHE:
                            seen.clear()
                        seen.add(key)
                        rows.append(("c", key, payload, None, None, None))
                row += 1
                rows.append(("r", b"%d:%d" % (part, row), None, doc_id, len(data) // width, b"".join(keys)))
                if len(rows) >= 4000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    path = {k: new_path(spark, k) for k in ("pack", "recipes", "manifest")}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = docs.select("doc_id", text).mapInArrow(encode, PACK)
    # equal chunks of different tasks: the first, by a sort that can spill
    once = encoded.repartition(parts, "key").dropDuplicates(["key"])
    # keys and payloads are all different: a dictionary of them would only be tried and thrown away
    once.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path["pack"])

    recipes = spark.read.schema(PACK).parquet(path["pack"]).where("kind = 'r'").select("doc_id", "n_tokens", "keys")
    recipes = recipes.withColumn("leaf", leaf())
    ordered = prefix_sums(recipes, ["doc_id", "leaf"], "n_tokens")
    ordered.write.parquet(path["recipes"])
    merkle(spark.read.parquet(path["recipes"]).select(F.col("position").alias("node"), F.col("leaf").alias("digest"))).write.parquet(path["manifest"])
    return path


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder, with what it has kept, for all tasks of a Python worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    names = ["kind", "key", "payload", "doc_id", "n_tokens", "keys"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def prefix_sums(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds ``position`` and ``start`` (sum of the values before) in this order.

    Rows are range-partitioned, sorted and written; a row's place in its file
    and the totals of the files before give the results.  Only one row a file
    is windowed in one task.
    """
    spark = rows.sparkSession
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = materialize_at(laid, "ordered")[0].withColumn("_part", F.shiftright("_at", 33))
    totals = laid.groupBy("_part").agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_v").over(ahead), F.lit(0)).alias("_v"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = laid.withColumn("_upto", F.sum(value).over(inside)).join(totals, "_part")
    position = F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.select(*rows.columns, position.cast("long").alias("position"), (F.col("_v") + F.col("_upto") - F.col(value)).cast("long").alias("start"))


def merkle(leaves: DataFrame) -> DataFrame:
    """(node, digest) -> all nodes as (level, node, digest); groups have FANOUT rows at most."""
    level, n = leaves, leaves.count()
    out = leaves.select(F.lit(0).alias("level"), "node", "digest")
    height = 0
    while n > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), "")
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(F.sha2(joined, 256).alias("digest")).withColumnRenamed("up", "node")
        height, n = height + 1, -(-n // FANOUT)
        out = out.unionByName(level.select(F.lit(height).alias("level"), "node", "digest"))
    return out


def leaf():
    """The digest of a recipe."""
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), "keys"), 256)


def verify_manifest(spark: SparkSession, path: dict[str, str]) -> int:
    """Number of Merkle nodes that differ from what they cover, leaves from their recipes."""
    built = merkle(spark.read.parquet(path["recipes"]).select(F.col("position").alias("node"), leaf().alias("digest")))
    kept = spark.read.parquet(path["manifest"])
    both = built.select("level", "node", "digest", F.lit(1).alias("side")).unionByName(kept.select("level", "node", "digest", F.lit(-1).alias("side")))
    # each node once from either, with one digest
    nodes = both.groupBy("level", "node").agg(F.sum("side").alias("sides"), F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    return nodes.where("sides != 0 OR n != 2 OR low != high OR low IS NULL").count()


def chunk_facts(spark: SparkSession, path: dict[str, str], tokenizer: str) -> DataFrame:
    """(key, n, crc) of every stored chunk, read from its payload; a wrong key stops the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = _width(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets, body = batch.column(1).buffers()
            ends = np.frombuffer(offsets, np.int32)[batch.column(1).offset :][: batch.num_rows + 1].astype(np.int64)
            stored = memoryview(body)[ends[0] : ends[-1]]
            ids = memoryview(np.frombuffer(stored, dtype).astype("<u4")).cast("B")
            wide, crcs = 4 // dtype.itemsize, []
            places = (ends - ends[0]).tolist()
            for key, a, b in zip(batch.column(0).to_pylist(), places, places[1:], strict=False):
                if _digest(stored[a:b]) != key:
                    raise ValueError(f"chunk {key.hex()} doesn't hold what its key says")
                crcs.append(zlib.crc32(ids[a * wide : b * wide]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends) // dtype.itemsize), pa.array(crcs, pa.int64())], names=["key", "n", "crc"])

    pack = spark.read.schema(PACK).parquet(path["pack"]).where("kind = 'c'").select("key", "payload")
    return pack.mapInArrow(read, "key binary, n long, crc long")


def _width(tokenizer: str) -> np.dtype:
    return _encoder(tokenizer).dtype


def _times(a: int, b: int) -> int:
    """Product in GF(2)[x] modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
    return out


_tables: list[np.ndarray] = []


def _table(k: int) -> np.ndarray:
    """What a checksum's four bytes become when 2 ** k bytes follow."""
    while len(_tables) <= k:
        power = 0x00800000  # x^8
        for _ in range(len(_tables)):
            power = _times(power, power)
        bits = np.array([_times(1 << i, power) for i in range(32)], np.uint32)
        values = np.arange(256)
        _tables.append(np.stack([np.bitwise_xor.reduce(np.where(values[:, None] >> np.arange(8) & 1, bits[8 * j : 8 * j + 8], np.uint32(0)), axis=1) for j in range(4)]).astype(np.uint32))
    return _tables[k]


def crc_shifted(crcs: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Shares of parts in the CRC-32 of the whole, from their own and the number of bytes after them; xor puts them together."""
    out = crcs.astype(np.uint32)
    for k in range(int(following.max(initial=0)).bit_length()):
        at = np.flatnonzero(following >> k & 1)
        c, t = out[at], _table(k)
        out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out


def crcs_of_wholes(crcs: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of strings put together from parts; each string's parts begin at its start."""
    upto = np.cumsum(sizes)
    many = np.diff(np.append(starts, len(crcs)))
    whole = np.repeat(upto[starts + many - 1], many)
    return np.bitwise_xor.reduceat(crc_shifted(crcs, whole - upto), starts)


def read(spark: SparkSession, path: dict[str, str], tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and n_chunks of every document, from the files; a manifest that differs stops it."""
    if wrong := verify_manifest(spark, path):
        raise ValueError(f"{wrong} nodes of the manifest differ from the recipes")
    recipes = spark.read.parquet(path["recipes"])
    steps = recipes.select(
        "position",
        "doc_id",
        "start",
        F.posexplode(F.expr(f"transform(sequence(0, cast(length(keys) / {KEY_BYTES} as int) - 1), i -> substring(keys, i * {KEY_BYTES} + 1, {KEY_BYTES}))")).alias("at", "key"),
    )
    facts = chunk_facts(spark, path, tokenizer)
    joined = steps.join(facts, "key", "left")
    parts = F.array_sort(F.collect_list(F.struct("at", "n", "crc")))
    docs = joined.groupBy("position", "doc_id", "start").agg(parts.alias("parts"))

    @F.arrow_udf("long")
    def together(parts: pa.Array) -> pa.Array:
        if not len(parts):
            return pa.array([], pa.int64())
        flat, starts = parts.flatten(), parts.offsets.to_numpy()
        crcs, sizes = flat.field("crc").to_numpy(zero_copy_only=False), 4 * flat.field("n").to_numpy(zero_copy_only=False)
        return pa.array(crcs_of_wholes(crcs, sizes, starts[:-1] - starts[0]).astype(np.int64))

    lost = F.exists("parts", lambda p: p["n"].isNull())
    checked = docs.withColumn("parts", F.when(lost, F.raise_error(F.lit("a chunk of a recipe is missing"))).otherwise(F.col("parts")))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    return checked.select("doc_id", "start", total.alias("n_tokens"), together("parts").alias("ids_crc32"), F.size("parts").cast("long").alias("n_chunks"))


def read_ids(spark: SparkSession, path: dict[str, str], tokenizer: str) -> DataFrame:
    """doc_id, start and ids (array) of every document: the store's content."""
    recipes = spark.read.parquet(path["recipes"])
    keys = F.expr(f"transform(sequence(0, cast(length(keys) / {KEY_BYTES} as int) - 1), i -> substring(keys, i * {KEY_BYTES} + 1, {KEY_BYTES}))")
    pack = spark.read.schema(PACK).parquet(path["pack"]).where("kind = 'c'").select("key", "payload")
    parts = F.array_sort(F.collect_list(F.struct("at", "payload")))
    docs = recipes.select("position", "doc_id", "start", F.posexplode(keys).alias("at", "key")).join(pack, "key").groupBy("position", "doc_id", "start").agg(parts.alias("parts"))

    @F.pandas_udf("array<long>")
    def ids(parts: pd.Series) -> pd.Series:
        dtype = _width(tokenizer)
        return pd.Series([np.frombuffer(b"".join(s["payload"] for s in steps), dtype).astype("int64") for steps in parts])

    return docs.select("doc_id", "start", ids("parts").alias("ids"))
