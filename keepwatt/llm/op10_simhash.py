"""SimHash near-duplicates, linked by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwatt.llm.common import HASH_SEED, components, read_documents, whole_text, word_lists
from keepwatt.session import stage

BITS = 64
RADIUS = 2


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2**(radius + 1) - 1 bit masks; any ``radius`` bit positions are all outside some mask.

    Position i gets a nonzero vector over GF(2) of radius + 1 dimensions; mask v holds the
    positions whose vector has an odd product with v. The vectors of at most ``radius``
    positions leave one dimension free, so a nonzero v is orthogonal to all of them.
    """
    count = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % count) & v).bit_count() % 2)
            for v in range(1, count + 1)]


def fingerprint(text: bytes, shingle: int) -> bytes:
    """Eight bytes; a bit is set if more than half of the shingle hashes have it."""
    ones, total, tail = np.zeros(BITS, np.int64), 0, []
    for words in word_lists(text):
        words = tail + words
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        hashes = np.array([xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles], ">u8")
        if len(hashes):
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(
                axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(shingle - 1):] if shingle > 1 else []
    if not total:
        whole = b" ".join(tail)
        return xxhash.xxh64_digest(whole, HASH_SEED) if whole else bytes(8)
    return np.packbits(2 * ones > total).tobytes()


def _fingerprinted(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with the fingerprint fp in place of their last column, text as bytes."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            fps = b"".join(fingerprint(t.as_py(), shingle) for t in texts)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.frombuffer(fps, ">i8").astype(np.int64))],
                [*batch.schema.names[:-1], "fp"])

    *kept, _ = (f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(of_batches, ", ".join([*kept, "fp long"]))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; a missing text counts as empty."""
    return _fingerprinted(docs.select(
        F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text")), shingle)


def links(fps: DataFrame, name: str = "simhash") -> DataFrame:
    """(a, b): links between the nodes of fingerprints (view, fp, node) that connect all those
    of a view at 2 or fewer differing bits. Nodes that several views link are linked once.

    Distinct fingerprints meet in seven tables by their bits under a covering mask. Where a
    bucket holds several, each one gives itself and its copies with one bit outside the mask
    turned over: two of them differ in at most two bits if and only if they share such a
    variant. A variant has at most one member per bit, so it is a small group whatever the
    size of the bucket, and it is linked as a star; no pairs of a bucket are made.
    """
    masks = covering_masks()
    distinct = stage(fps.select("view", "fp", "node").distinct(), f"{name}-distinct")
    keys = F.array(*[F.struct(F.lit(t).alias("at"), F.col("fp").bitwiseAND(
        F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    buckets = distinct.select("view", "fp", "node", F.explode(keys).alias("k")).select(
        "view", "fp", "node", "k.at", "k.key")
    bucket = ["view", "at", "key"]
    crowded = stage(buckets.groupBy(*bucket).agg(F.min("fp").alias("low"),
                                                 F.max("fp").alias("high"))
                    .where("low <> high").select(*bucket), f"{name}-buckets")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[
        F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    variants = buckets.join(crowded, bucket).select("view", "at", "node", F.explode(
        F.transform(F.element_at(flips, F.col("at") + 1),
                    lambda bit: F.col("fp").bitwiseXOR(bit))).alias("variant"))
    stars = variants.groupBy("view", "at", "variant").agg(F.collect_set("node").alias("members"))
    return (stars.where(F.size("members") > 1)
            .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
            .where("a <> b").distinct())


def classes(fps: DataFrame) -> DataFrame:
    """(fp, root): for each different fingerprint of ``fps`` one that stands for all that links
    lead to."""
    distinct = fps.select("fp").distinct()
    roots = components(links(distinct.select(
        F.lit(0).alias("view"), "fp", F.col("fp").alias("node"))), "simhash")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest doc_id reachable).

    Missing and empty texts have the fingerprint zero and are linked like others. Repeated rows
    stay; a missing doc_id gets the smallest doc_id of its component, if any. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    fps = stage(fingerprints(docs, shingle), "simhash-fps")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = stage(first.join(classes(fps), "fp").select("fp", "first", "root"),
                   "simhash-classes")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = stage(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-members")
    return fps.join(members, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each component of near duplicates, the one with the smallest doc_id, with all
    columns. Rows with missing doc_ids come after others, ties are broken by hashes of the text;
    repeated rows become one. Missing texts are empty texts, which are equal."""
    names = docs.columns
    text = whole_text()
    # 96 bits stand for a text, since rows are dropped by them
    key = {"id": F.col("doc_id").cast("long"), "x": F.xxhash64(text), "m": F.hash(text)}
    own = [c.alias(k) for k, c in key.items()]
    fps = stage(_fingerprinted(docs.select(*own, text.cast("binary").alias("text")), shingle),
                "simhash-fps")
    order = F.struct(F.col("id").isNull().alias("missing"), *key)
    # folded by fingerprint before it is a key to join by: copies may be a third of all rows
    first = fps.groupBy("fp").agg(F.min(order).alias("first"))
    best = stage(first.join(classes(fps), "fp").groupBy("root").agg(
        F.min("first").alias("first")).select(F.col("first.id").alias("best_id"), "first.x",
                                              "first.m"), "simhash-first")
    times = fps.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    best = stage(best.join(times.hint("merge"), ["x", "m"]).where(
        F.col("id").eqNullSafe(F.col("best_id"))).drop("id"), "simhash-best")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *own)
    # tables that grow with the corpus are never broadcast
    kept = keyed.join(best.hint("merge"), ["x", "m"]).where(
        F.col("id").eqNullSafe(F.col("best_id")))
    single = kept.where("n = 1").select("row")
    repeated = kept.where("n > 1").dropDuplicates([*key]).select("row")
    return single.union(repeated).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op10_simhash(spark, sf_dir):
    found = near_duplicates(read_documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
