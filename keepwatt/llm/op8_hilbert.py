"""Shards as runs along a Hilbert curve through the documents' metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepwatt.llm.common import read_documents
from keepwatt.session import stage

SHARDS = 40
AXIS_BITS = 8
COARSE_BITS = 16  # of the curve's index: its upper bits, by which rows are counted first
PIECES = 64       # the rows of one place on the curve are ordered in so many pieces
ROW_BYTES = 16
AXES = ("source_axis", "lang_axis", "size_axis", "id_axis")


def hilbert_index(axes: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """Places on the curve of points given as rows of coordinates below 2**bits.

    Walks down from the highest bit. Where a coordinate's bit is set the lower bits of the first
    coordinate are turned over, else they change places with that coordinate's lower bits; this
    undoes the turns of the curve, and a Gray decoding of what is left gives the index.
    """
    x = np.array(axes, np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        high, lower = 1 << level, (1 << level) - 1
        for k in range(n):
            turned = (x[k] & high) != 0
            swap = np.where(turned, 0, (x[0] ^ x[k]) & lower)
            x[0] = np.where(turned, x[0] ^ lower, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turns = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turns = np.where(x[n - 1] & (1 << level), turns ^ ((1 << level) - 1), turns)
    x ^= turns
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            index = index << 1 | x[k] >> level & 1
    return index


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        axes = np.stack([batch.column(name).to_numpy() for name in AXES], axis=1)
        cell = pa.array(hilbert_index(axes))
        kept = ["doc_id", "size", "text_crc32", "piece"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), cell], [*kept, "cell"])


def place_of(value: Column) -> Column:
    """The axis place of a source or language, by hash."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))),
                  F.lit(1 << AXIS_BITS)).cast("long")


def _size_of(text: Column) -> Column:
    return (F.octet_length(text) + ROW_BYTES).cast("long")


def _key(docs: DataFrame) -> DataFrame:
    """``docs`` with size and text_crc32."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("*", _size_of(text).alias("size"), F.crc32(text).alias("text_crc32"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, piece, cell): what sharding needs of a row, without its text.

    Source and language go to one of 256 places by hash, the size by its binary logarithm in
    sixteenths, the doc_id by its place between the smallest and the largest. Each axis is then
    stretched so that its places hold equal shares of the rows, which keeps their order. Missing
    values count as empty, a missing doc_id as the smallest.
    """
    ids = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = ids["low"] or 0, ids["high"] or 0
    top = (1 << AXIS_BITS) - 1
    given = _key(docs.select(F.col("doc_id").cast("long"), "text", "source", "lang")).select(
        "doc_id", "size", "text_crc32",
        place_of(F.col("source")).alias("source_axis"), place_of(F.col("lang")).alias("lang_axis"),
        F.least(F.lit(top), F.floor(16 * (F.log2("size") - 4))).cast("long").alias("size_axis"),
        F.least(F.lit(top), F.floor((F.coalesce("doc_id", F.lit(low)) - low).cast("double")
                                    * (top + 1) / max(high - low + 1, 1))).cast("long")
        .alias("id_axis"))
    rows = stage(given, "hilbert-axes")
    counts = rows.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("axis"), F.col(name).alias("place"))
        for k, name in enumerate(AXES)])).alias("at")).groupBy("at.axis", "at.place").agg(
        F.count("*").alias("n")).collect()  # at most 256 rows for each axis
    shares = np.zeros((len(AXES), top + 1))
    for row in counts:
        shares[row["axis"], row["place"]] = row["n"]
    middle = np.cumsum(shares, axis=1) - shares / 2
    places = (middle * (top + 1) / np.maximum(shares.sum(axis=1, keepdims=True), 1)).astype(int)
    stretched = {name: F.element_at(F.array(*map(F.lit, places[k].tolist())), (
        F.col(name) + 1).cast("int")).cast("long") for k, name in enumerate(AXES)}
    placed = rows.withColumns(stretched).withColumn("piece", F.pmod(
        F.xxhash64("doc_id", "text_crc32"), F.lit(PIECES)).cast("int"))
    return placed.mapInArrow(
        _cells, "doc_id long, size long, text_crc32 long, piece int, cell long")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, cell, shard and slot of every row; shards differ by one row.

    Rows are ordered by the whole index of the curve, in one place of it by a hashed piece, then
    by checksum and doc_id. Counts give the rows before each piece: first of coarse cells, the
    upper bits of the index, then of places and pieces inside one. So only the rows of one piece
    are sorted together, and a crowded coarse cell is ordered by the finer bits of the curve.
    Repeated rows stay and follow each other. An empty table gives an empty result.
    """
    rows = stage(digests(docs).withColumn("coarse", F.shiftright(
        "cell", AXIS_BITS * len(AXES) - COARSE_BITS).cast("int")), "hilbert-digests")
    total = rows.count()
    pieces = rows.groupBy("coarse", "cell", "piece").agg(F.count("*").alias("n"))
    before = Window.unboundedPreceding
    cells = pieces.groupBy("coarse").agg(F.sum("n").alias("in_cell"))  # at most 65,536 rows
    cells = cells.select("coarse", F.coalesce(F.sum("in_cell").over(
        Window.orderBy("coarse").rowsBetween(before, -1)), F.lit(0)).alias("first_cell"))
    within = Window.partitionBy("coarse").orderBy("cell", "piece").rowsBetween(before, -1)
    starts = (pieces.withColumn("first_piece", F.coalesce(F.sum("n").over(within), F.lit(0)))
              .join(cells, "coarse")
              .select("cell", "piece", (F.col("first_cell") + F.col("first_piece")).alias("first")))
    order = Window.partitionBy("cell", "piece").orderBy("text_crc32", "doc_id", "size")
    place = F.col("first") + F.row_number().over(order) - 1
    return (rows.join(starts, ["cell", "piece"]).withColumn("place", place)
            .withColumn("shard", F.expr(f"int(place * {shards} div {max(total, 1)})"))
            .withColumn("slot", F.col("place") - F.expr(
                f"(shard * {total}L + {shards - 1}) div {shards}"))
            .select("doc_id", "size", "text_crc32", "cell", "shard", "slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Store ``docs`` with all columns as one Parquet folder per shard under ``path``/rows, in
    slot order, and the smallest and largest value of each dimension in every shard under
    ``path``/ranges. Columns of ``docs`` named shard or slot are replaced.

    Rows meet their places by doc_id, size and checksum; of repeated rows each takes one place.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    key = ["shard_id", "shard_size", "shard_crc"]
    own = _key(docs.select("text", F.col("doc_id").cast("long").alias("shard_id"), F.struct(*[
        F.col(f"`{c}`") for c in names]).alias("row"))).withColumnsRenamed(
            {"size": "shard_size", "text_crc32": "shard_crc"}).drop("text")
    placed = hilbert_shards(docs, shards).select(
        F.col("doc_id").alias("place_id"), F.col("size").alias("shard_size"),
        F.col("text_crc32").alias("shard_crc"), "shard", "slot")
    repeats = Window.partitionBy(*key).orderBy(F.lit(0))
    turns = Window.partitionBy("place_id", *key[1:]).orderBy("shard", "slot")
    own = own.withColumn("turn", F.row_number().over(repeats))
    placed = placed.withColumn("turn", F.row_number().over(turns))
    # both sides have a row per document
    joined = own.join(placed.hint("merge"), [*key[1:], "turn"]).where(
        F.col("shard_id").eqNullSafe(F.col("place_id")))
    rows = joined.select("row.*", "shard", "slot")
    (rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(f"{path}/rows"))
    shard_ranges(docs.sparkSession.read.parquet(f"{path}/rows")).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/ranges")


def shard_ranges(rows: DataFrame) -> DataFrame:
    """(shard, rows, low and high of the places of source and lang, of size and doc_id)."""
    size = _size_of(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sides = {"source": place_of(F.col("source")), "lang": place_of(F.col("lang")), "size": size,
             "doc_id": F.col("doc_id").cast("long")}
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), *[
        side(value).alias(f"{end}_{name}") for name, value in sides.items()
        for end, side in (("low", F.min), ("high", F.max))])


def shards_to_read(ranges: DataFrame, source: str | None = None, lang: str | None = None,
                   size: tuple[int, int] | None = None,
                   doc_id: tuple[int, int] | None = None) -> list[int]:
    """The shards that may hold rows of a source, of a language, with sizes and doc_ids between
    two values, ends included. There are few shards, and a row for each."""
    wanted = {name: (place_of(F.lit(value)),) * 2 for name, value in
              (("source", source), ("lang", lang)) if value is not None}
    wanted |= {name: tuple(map(F.lit, value)) for name, value in
               (("size", size), ("doc_id", doc_id)) if value is not None}
    for name, (low, high) in wanted.items():
        ranges = ranges.where((F.col(f"low_{name}") <= high) & (F.col(f"high_{name}") >= low))
    return sorted(r["shard"] for r in ranges.select("shard").collect())


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(read_documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
