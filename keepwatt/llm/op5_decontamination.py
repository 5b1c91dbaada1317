"""Benchmark items inside documents: size-partitioned MinHash, then exact containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.llm.common import (
    LOWER, MIX, SHINGLE, UPPER, WordHashes, read_documents, shingle_hashes, whole_text,
    word_lists,
)
from keepwatt.session import stage

CONTAINED = 0.8
PERMUTATIONS = 40
FILTER_BITS = 24, 28    # logarithm of the filter's bits: at least, and at most (32 MB)
_numbers = np.random.default_rng(7)
FACTORS = _numbers.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
HALF = np.uint64(32)


def permuted(hashes: np.ndarray) -> np.ndarray:
    """One row per permutation: multiplied hashes, their higher half."""
    return (hashes[None, :] * FACTORS[:, None] >> HALF).astype(np.uint32)


def size_class(shingles: int) -> int:
    """Items of 2**c to 2**(c + 1) - 1 shingles are of class c."""
    return max(shingles, 1).bit_length() - 1


def key_of(classes, permutation, values):
    """What has to be equal: class, permutation and smallest value in one number."""
    return (np.asarray(classes, np.int64) << 40 | np.asarray(permutation, np.int64) << 32
            | np.asarray(values, np.int64))


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of_word = WordHashes()
    for batch in batches:
        ids, keys = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = np.array([of_word[w] for some in word_lists(text.as_py()) for w in some],
                             np.uint64)
            if len(words):
                hashes = shingle_hashes(words)
                keys.append(key_of(size_class(len(hashes)), np.arange(PERMUTATIONS),
                                   permuted(hashes).min(axis=1)))
                ids += [item] * PERMUTATIONS
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()),
             pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], ["item", "key"])


def filter_bits(keys: int) -> int:
    """The logarithm of the filter's size: sixteen bits a key, so that one in sixteen others
    passes; where that is more than the bound, more pass, and the join drops them."""
    return min(max(FILTER_BITS[0], (16 * max(keys, 1) - 1).bit_length()), FILTER_BITS[1])


def _filter_places(keys: np.ndarray, log_bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - log_bits)).astype(np.int64)


def _window_keys(classes: list[int], bits: np.ndarray):
    """Keys of a text's windows that pass the filter, each with the text's row.

    The windows of class c are 2**(c + 2) shingles long and begin every 2**(c + 1), so a
    passage of that size is whole in one of them. Minima of short stretches are taken once and
    joined two by two for the longer classes.
    """
    least, log_bits = min(classes), len(bits).bit_length() - 1

    def of_text(words: np.ndarray) -> np.ndarray:
        hashes = shingle_hashes(words)
        step = 1 << (least + 1)
        starts = np.arange(0, len(hashes), step)
        minima = np.concatenate([
            np.minimum.reduceat(permuted(hashes[at * step:(at + 4096) * step]), np.arange(
                0, min(4096 * step, len(hashes) - at * step), step), axis=1)
            for at in range(0, len(starts), 4096)], axis=1)
        found = []
        for c in range(least, max(classes) + 1):
            windows = np.minimum(minima[:, :-1], minima[:, 1:]) if minima.shape[1] > 1 else minima
            if c in classes:
                keys = key_of(c, np.arange(PERMUTATIONS)[:, None], windows).ravel()
                found.append(np.unique(keys[bits[_filter_places(keys, log_bits)]]))
            if minima.shape[1] % 2 and minima.shape[1] > 1:
                minima = np.concatenate([minima, minima[:, -1:]], axis=1)
            if minima.shape[1] > 1:
                minima = np.minimum(minima[:, ::2], minima[:, 1::2])
        return np.concatenate(found)

    return of_text


def words_of(text: Column) -> Column:
    """Words between white space, A-Z lowered; the same words as ``word_lists``."""
    trimmed = F.regexp_replace(F.translate(text, UPPER, LOWER),
                               r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+"))


def contaminations(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, containment) of items whose shingles are in a document.

    An item's class is its size. Its MinHash values meet those of document windows of its
    class; a shared value makes a candidate, and of a passage that holds 0.8 of an item's
    shingles at least one of the 40 values is shared with a chance of 0.9998 or more. A filter
    of 2 to 32 MB, made of the items' values, travels to the tasks; only what passes it is
    shuffled. Candidates are verified on whole texts: the share of the item's distinct shingles
    that the document has. Items or texts without words have no match; an item of fewer than
    five words is one shingle. Missing texts are empty. Rows that share a doc_id are taken
    together, as are repeated items; rows without an id take part under a missing id.
    """
    return _contaminations(docs.withColumn("doc_id", F.col("doc_id").cast("long")), items,
                           contained)


def _contaminations(docs: DataFrame, items: DataFrame, contained: float) -> DataFrame:
    """The same for doc_ids of any type."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    item_texts = items.select(F.col("item_id").cast("long").alias("item_id"),
                              whole_text().cast("binary").alias("text"))
    item_keys = stage(item_texts.mapInArrow(_item_keys, "item long, key long"), "leak-items")
    classes = sorted(r[0] for r in item_keys.select(
        F.shiftright("key", 40)).distinct().collect())  # at most 32
    if not classes:
        return spark.createDataFrame([], f"doc_id {kind}, item_id long, containment double")
    log_bits = filter_bits(item_keys.count())
    places = item_keys.mapInArrow(_places(log_bits), "place int").groupBy(
        F.shiftright("place", 6).alias("word")).agg(F.expr(
            "bit_or(shiftleft(1L, place & 63))").alias("bits"))  # one row for 64 bits
    bits = np.zeros((1 << log_bits) // 64, np.uint64)
    for row in places.toLocalIterator():
        bits[row["word"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    shared = spark.sparkContext.broadcast(bits)

    def of_batches(batches):
        flags = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        of_word, of_text = WordHashes(), _window_keys(classes, flags)
        for batch in batches:
            rows, keys = [], []
            for k, text in enumerate(batch.column(1)):
                words = np.array([of_word[w] for some in word_lists(text.as_py()) for w in some],
                                 np.uint64)
                if len(words) and len(found := of_text(words)):
                    rows.append(np.full(len(found), k))
                    keys.append(found)
            if rows:
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(keys))],
                    ["doc", "key"])

    met = texts.mapInArrow(of_batches, f"doc {kind}, key long").join(item_keys, "key")
    pairs = stage(met.select("doc", "item").distinct(), "leak-candidates")
    return verified(texts, item_texts, pairs, contained)


def _places(log_bits: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(_filter_places(keys, log_bits).astype(np.int32))], ["place"])
    return of_batches


def shingle_rows(texts: DataFrame, key: str, among: DataFrame | None = None) -> DataFrame:
    """(key, shingle): the distinct shingles of texts, exact; only those in ``among``, if given."""
    words = words_of(F.col("text").cast("string"))
    runs = F.when(F.size("words") <= SHINGLE, F.array(F.array_join("words", " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("words") - SHINGLE + 1),
                    lambda k: F.array_join(F.slice("words", k, SHINGLE), " ")))
    rows = texts.select(key, words.alias("words")).where("words is not null").select(
        key, F.explode(runs).alias("shingle"))
    if among is not None:
        rows = rows.join(among, "shingle", "left_semi")
    return rows.select(key, "shingle").distinct()


def verified(texts: DataFrame, item_texts: DataFrame, pairs: DataFrame,
             contained: float) -> DataFrame:
    """Candidates whose containment, counted on exact shingles, is high enough.

    Each candidate pair asks for its item's shingles, and these meet the document's shingles by
    document and shingle. So a phrase of many items and many documents makes rows for candidate
    pairs only, and neither a frequent item nor a large document is gathered.
    """
    wanted = pairs.select(F.col("doc").alias("doc_id")).distinct()
    same_doc = texts["doc_id"].eqNullSafe(wanted["doc_id"])
    item_shingles = stage(shingle_rows(item_texts, "item_id"), "leak-shingles")
    doc_shingles = shingle_rows(texts.join(wanted, same_doc, "left_semi"), "doc_id",
                                item_shingles.select("shingle"))
    sizes = item_shingles.groupBy("item_id").agg(F.count("*").alias("size"))
    asked = pairs.join(item_shingles, pairs["item"].eqNullSafe(item_shingles["item_id"])).select(
        "doc", "item", F.col("shingle").alias("asked"))
    shared = (asked.join(doc_shingles, F.col("doc").eqNullSafe(F.col("doc_id"))
                         & (F.col("asked") == F.col("shingle")))
              .groupBy("doc", "item").agg(F.count("*").alias("shared")))
    return shared.join(sizes, F.col("item").eqNullSafe(F.col("item_id"))).select(
        F.col("doc").alias("doc_id"), "item_id",
        (F.col("shared") / F.col("size")).alias("containment")).where(
        F.col("containment") >= contained)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no item; 96 bits tell texts
    apart."""
    text = whole_text()
    key = F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("m"))
    leaks = _contaminations(docs.select(key.alias("doc_id"), "text"), items, CONTAINED)
    found = stage(leaks.select("doc_id").distinct(), "leak-texts")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                        key.alias("doc_id"))
    return keyed.join(found, "doc_id", "left_anti").select(
        *[F.col(f"row.`{c}`").alias(c) for c in names])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read_documents(spark, sf_dir),
                          read_documents(spark, sf_dir, "benchmark"))


ORACLE_SQL = """
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'),
    lambda w: w <> '') AS w FROM benchmark),
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'),
    lambda w: w <> '') AS w FROM documents),
item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k
        FROM item_words WHERE len(w) > 0)),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k
        FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id)
SELECT doc_id, i.item_id, count(*) / any_value(n) AS containment
FROM doc_shingles d JOIN item_shingles i USING (s) JOIN sizes z ON z.item_id = i.item_id
GROUP BY doc_id, i.item_id HAVING count(*) / any_value(n) >= 0.8
"""
