"""Token counts of documents in flat token files that hold nothing but ids and separators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepwatt.llm.common import read_documents, whole_text
from keepwatt.llm.op1_bpe import RANKS, encoding
from keepwatt.session import stage

END_ID = 50256  # free in the rank file
BLOCK_IDS = 1 << 20
FLAT = "file int, block int, ids binary, ordinal long, doc_id long"


def _flat(path: str, end_id: int):
    schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()),
                        ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoding(path).encode_ordinary, TaskContext.get().partitionId()
        held, block, ordinal = bytearray(), 0, 0
        end = np.array([end_id], "<u2").tobytes()

        def block_row(ids):
            return pa.RecordBatch.from_arrays([
                pa.array([file], pa.int32()), pa.array([block], pa.int32()),
                pa.array([ids], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())],
                schema=schema)

        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, file, np.int32)), pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.binary()), pa.array(np.arange(ordinal, ordinal + n)),
                batch.column(0)], schema=schema)
            ordinal += n
            for text in batch.column(1):
                held += np.array(encode(text.as_py()), "<u2").tobytes() + end
                while len(held) >= 2 * BLOCK_IDS:
                    yield block_row(bytes(held[:2 * BLOCK_IDS]))
                    del held[:2 * BLOCK_IDS]
                    block += 1
        if held:
            yield block_row(bytes(held))
    return of_batches


def write_flat_files(docs: DataFrame, path: str | None = None,
                     end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Encode all texts into flat files: (file, block, ids) and (file, ordinal, doc_id).

    A file is what one task encodes; its stream of 16-bit ids, with a separator after each
    document, is cut into blocks of one size wherever that falls. Nothing in it says where a
    document starts. The second table names the documents of a file in their order. Missing
    texts have no ids before their separator.
    """
    path = path or public_tokenizers.path(RANKS)
    given = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    flat = stage(given.mapInArrow(_flat(path, end_id), FLAT), "flat-tokens")
    return (flat.where("ids is not null").select("file", "block", "ids"),
            flat.where("ordinal is not null").select("file", "ordinal", "doc_id"))


def _scan(end_id: int):
    """Per block one row with the places of its separators, all found in one comparison."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(2)]
            places = [np.flatnonzero(x == end_id) for x in ids]
            cuts = np.cumsum([0, *map(len, places)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([len(x) for x in places], pa.int64()),
                pa.array([int(x[-1]) if len(x) else None for x in places], pa.int64()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()),
                                         pa.array(np.concatenate(places).astype(np.int32)))],
                ["file", "block", "n_ids", "n_ends", "last_end", "ends"])
    return of_batches


def count_tokens(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) for every document of flat files.

    Blocks are scanned alone. A prefix scan over the blocks of a file then carries the number
    of separators and the place of the last one, so a document may span any number of blocks.
    Ids after the last separator of a file are a document that has not ended; an empty stretch
    there is none. Two separators in a row enclose an empty document.
    """
    scanned = blocks.select("file", "block", "ids").mapInArrow(
        _scan(end_id), "file int, block int, n_ids long, n_ends long, last_end long, "
                       "ends array<int>")
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (scanned
              .withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
              .withColumn("ordinal", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
              .withColumn("last", F.col("first") + F.col("last_end"))
              .withColumn("from", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
              .withColumn("final", F.lead("block").over(in_order).isNull()))
    ended = (placed.select("file", "ordinal", "first", "from", "ends",
                           F.posexplode("ends").alias("k", "end"))
             .select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"),
                     F.when(F.col("k") == 0, F.col("from")).otherwise(
                         F.col("first") + F.element_at("ends", F.greatest("k", F.lit(1))) + 1
                     ).alias("start"),
                     (F.col("first") + F.col("end")).alias("stop"), F.lit(True).alias("ended")))
    start = F.coalesce(F.col("last") + 1, F.col("from"))
    open_end = (placed.where("final").select(
        "file", (F.col("ordinal") + F.col("n_ends")).alias("ordinal"), start.alias("start"),
        (F.col("first") + F.col("n_ids")).alias("stop"), F.lit(False).alias("ended"))
        .where("stop > start"))
    return ended.union(open_end).select(
        "file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def op9_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) for all documents, counted in their flat files."""
    blocks, names = write_flat_files(read_documents(spark, sf_dir))
    return names.join(count_tokens(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
