"""Line dedup by a deletion-neighbourhood join, with an edit bound of one character.

Everything is DataFrame functions.  Lines are trimmed; blank ones are not
counted and stay.  A line stays if no equal line and, for lines of ``least``
characters or more, no line within one edit (insert, delete or replace a
character) stands earlier, by doc_id and line number.

1.  Equal lines are summed up first, map-side, to the text with its earliest
    place.  Everything after that works on different texts.
2.  Two lines within one edit share the first or the second half, measured on
    the shorter one's length.  Only lines that share such a half with another
    text go on; after that only their blocks of ``BLOCK`` characters outside of
    which they equal another text.  Both steps count equal hashed keys.
3.  Those blocks emit all their one-deletion variants as hashed keys.  Two lines
    of one length with the same variant at the same place differ there only; a
    line that is another's variant is one deletion away.  So the earliest line of
    a key is found by an aggregate over the key, and no pairs are made.  A key has
    no more texts than one place has characters, or one line has insertions.
4.  Each line that would go is compared with that earlier line by edit distance.

Each text that stays does so at one place, so documents are put together from
the texts, without a join on hot lines.

Defined cases: null or empty text has no lines; a null doc_id stands last; rows
with one doc_id count as copies of one document, and repeated rows keep the same
lines; very long texts and lines are taken whole; an empty table gives an empty
result; extra columns are carried along by ``deduplicate``, whatever their names,
and else ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import carried, materialize, own_names

LEAST = 20
BLOCK = 64
LINE_SPAN = 1 << 31
BITS = 1 << 22
#: After all ids, which are below it.
NO_ID = str(1 << 63)


def numbered(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(pos, line) of every line that isn't blank; pos orders by doc_id and line number."""
    rows = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)"))
    pos = (doc * F.lit(LINE_SPAN).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(30,0)")
    return rows.select(pos.alias("pos"), trimmed(F.col("line")).alias("line")).where("line != ''")


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def _differ(keys: DataFrame) -> DataFrame:
    """Keys that more than one text has."""
    return keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("key")


def _half_keys(line: Column) -> Column:
    n = F.length(line)

    def of(size: Column) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        rest = (size - half).cast("int")
        return [F.xxhash64(F.lit("first"), size, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit("second"), size, F.substring(line, (n - rest + 1).cast("int"), rest))]

    return F.array_distinct(F.array(*of(n), *of(n - 1)))


def near_lines(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(pos, earlier): texts with an earlier one within an edit, and the earliest of those."""
    # a line one character shorter can be the earlier one
    long = texts.where(F.length("line") >= least - 1).select("pos", "line", F.xxhash64("line").alias("id"))
    halves = long.select("id", F.explode(_half_keys(F.col("line"))).alias("key"))
    ids = halves.join(_differ(halves), "key").select("id").distinct()
    # bits of the ids, at most BITS / 64 rows whatever the number of lines; a line that passes by chance only costs work
    at = F.pmod("id", F.lit(BITS))
    word = F.floor(at / 64).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(id, {BITS}) % 64 as int))")
    bits = ids.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))
    lines = long.withColumn("w", word).join(F.broadcast(bits), "w").where(F.col("bits").bitwiseAND(bit) != 0).select("pos", "line", "id")
    lines = materialize(lines, "lines")

    # blocks outside of which a line, as it is (size n) or as the longer one of a pair (size n - 1), equals another
    n = F.length("line")
    sized = lines.select("*", F.explode(F.array(n, n - 1)).alias("size"))
    blocks = sized.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int"))).alias("block"))
    after = F.greatest(F.lit(0), F.col("size") - (F.col("block") + 1) * BLOCK)
    outside = F.xxhash64("size", "block", F.substring(F.col("line"), F.lit(1), F.col("block") * BLOCK), F.substring(F.col("line"), n - after + 1, after))
    blocks = blocks.select("pos", "id", "line", "size", "block", outside.alias("key"))
    open_ = _differ(blocks.select("id", "key"))
    blocks = blocks.join(open_, "key")

    width = F.least(F.lit(BLOCK), F.col("size") - F.col("block") * BLOCK)
    is_longer = F.length("line") != F.col("size")
    inner = F.substring(F.col("line"), F.col("block") * BLOCK + 1, width + is_longer.cast("int"))
    variant = lambda i: F.concat(F.substring(F.col("inner"), F.lit(1), i), F.substring(F.col("inner"), i + 2, F.length("inner")))
    places = F.sequence(F.lit(0), F.length("inner") - 1)
    replaced = F.transform(places, lambda i: F.struct(F.xxhash64("key", F.lit("replace"), i, variant(i)).alias("v"), F.lit(0).alias("role")))
    itself = F.array(F.struct(F.xxhash64("key", F.lit("insert"), "inner").alias("v"), F.lit(1).alias("role")))
    deleted = F.transform(places, lambda i: F.struct(F.xxhash64("key", F.lit("insert"), variant(i)).alias("v"), F.lit(2).alias("role")))
    variants = blocks.select("pos", "key", inner.alias("inner"), is_longer.alias("longer")).select(
        "pos", F.explode(F.when(F.col("longer"), deleted).otherwise(F.concat(replaced, itself))).alias("x")
    )
    same = Window.partitionBy("v")
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("pos"))).over(same)
    met = variants.select("pos", "x.v", "x.role").withColumn("m0", first(0)).withColumn("m1", first(1)).withColumn("m2", first(2))
    earlier = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    met = met.select("pos", earlier.alias("earlier")).where("earlier < pos").groupBy("pos").agg(F.min("earlier").alias("earlier"))
    own = lines.select("pos", "line").where(F.length("line") >= least)
    earlier_line = lines.select(F.col("pos").alias("earlier"), F.col("line").alias("line2"))
    checked = met.join(own, "pos").join(earlier_line, "earlier")
    return checked.where(F.levenshtein("line", "line2", 1) >= 0).select("pos", "earlier")


def kept_lines(docs: DataFrame, least: int = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, kept): the numbers of the lines that stay, from 0; documents that keep none have no row."""
    texts = materialize(numbered(docs, text, key).groupBy("line").agg(F.min("pos").alias("pos")), "texts")
    stay = texts.select("pos").join(near_lines(texts, least), "pos", "left_anti")
    doc = F.floor(F.col("pos") / F.lit(LINE_SPAN).cast("decimal(10,0)")).cast("decimal(20,0)")
    parts = stay.select(doc.alias("doc"), "pos").select("doc", (F.col("pos") - F.col("doc") * F.lit(LINE_SPAN).cast("decimal(10,0)")).cast("int").alias("line_no"))
    rows = parts.groupBy("doc").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))
    return rows.select(F.when(F.col("doc") < F.lit(NO_ID).cast("decimal(20,0)"), F.col("doc").cast("long")).alias("doc_id"), "kept")


def n_lines(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")), F.lit(0)).cast("long")


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_kept and kept_lines (numbers, comma-joined) for every row."""
    kept = kept_lines(docs, least).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines(F.col("text"))).cast("long").alias("n_lines"))
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select(
        "doc_id",
        "n_lines",
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("kept")).cast("long").alias("n_kept"),
        F.coalesce(F.array_join("kept", ","), F.lit("")).alias("kept_lines"),
    )


def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with the lines that stay, and their blank lines."""
    key, numbers = own_names(docs, "key", "kept")
    kept = kept_lines(docs, least).select(F.col("doc_id").alias(key), F.col("kept").alias(numbers))
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left")
    listed = F.coalesce(F.col(numbers), F.array().cast("array<int>"))

    def put_together(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, i: F.when(trimmed(x) == "", i)), lambda i: i.isNotNull())
        return F.array_join(F.transform(F.array_sort(F.concat(listed, blank)), lambda i: F.element_at(lines, i + 1)), "\n")

    text = F.transform(F.array(F.split("text", "\n")), put_together)[0]
    return joined.select(*[F.when(F.col("text").isNotNull(), text).alias(c) if c.lower() == "text" else x for c, x in zip(docs.columns, carried(docs), strict=True)])
