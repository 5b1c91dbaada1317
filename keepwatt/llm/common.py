"""What several operators share: input columns, words, hashes, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.session import stage

HASH_SEED = 42  # the seed of Spark's xxhash64()
SHINGLE = 5  # words
MIX = np.uint64(0xFF51AFD7ED558CCD)
HALF = np.uint64(32)
SPACE = re.compile(rb"[\x20\x09-\x0d]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


class WordHashes(dict):
    """XXH64 of words; remembers at most ``limit`` of them, so its size is bounded."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, HASH_SEED)
        return value


def word_lists(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words between white space, with A-Z lowered, in lists from pieces of about ``size``
    bytes. The pieces keep the memory bounded for very long texts; no word is cut."""
    start = 0
    while start < len(text):
        end = len(text)
        if start + size < end and (gap := SPACE.search(text, start + size)):
            end = gap.start()
        yield text[start:end].lower().split()
        start = end


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, given the hashes of the words; fewer words are one run."""
    n = max(len(words) - SHINGLE + 1, 1 if len(words) else 0)
    hashes = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        hashes = (hashes ^ words[k:k + n]) * MIX
        hashes ^= hashes >> HALF
    return hashes


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) one node that stands for all it can reach.

    Each round points every node to the smallest of itself and its neighbours, moves the links
    to where their ends point, and goes on with those that still link two nodes. The first two
    rounds compare the nodes themselves, which ends stars around their smallest node; later ones
    compare hashes that change every two rounds, so that no order of nodes makes long paths
    slow. Links are held once, in one direction, and rounds get smaller and smaller. Every round
    is a written table. Repeated links and an empty table are fine; a node that is only linked
    to itself is not returned.
    """
    def links_of(some: DataFrame) -> DataFrame:
        once = some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return stage(once.where("a <> b").distinct(), f"{name}-links")

    def moves_of(left: DataFrame, step: int) -> DataFrame:
        def rank(node: str):
            return F.col(node) if step < 2 else F.xxhash64(F.lit(step // 2), node)

        sides = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            left.select("b", "a"))
        lowest = sides.groupBy("node").agg(F.min_by("other", rank("other")).alias("other"))
        stays = rank("node") <= rank("other")
        return stage(lowest.select("node", F.when(stays, F.col("node")).otherwise(
            F.col("other")).alias("root")), f"{name}-moves")

    left, moves = links_of(edges), []
    while left.limit(1).count():
        moves.append(moves_of(left, len(moves)))
        of_a, of_b = moves[-1].toDF("a", "to_a"), moves[-1].toDF("b", "to_b")
        left = links_of(left.join(of_a, "a").join(of_b, "b").select(
            F.col("to_a").alias("a"), F.col("to_b").alias("b")))
    roots = moves.pop() if moves else left.toDF("node", "root")
    for move in reversed(moves):
        on = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))
        roots = stage(move.join(on, "root", "left").select(
            "node", F.coalesce("last", "root").alias("root")), f"{name}-roots")
    return roots
