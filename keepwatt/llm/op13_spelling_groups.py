"""Spelling variants: words one letter apart, found in a bit-sliced index by position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwatt.llm.common import ascii_lower, read_documents, whole_text
from keepwatt.session import stage

RUN_OF_LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_COUNT = 5, 3
FACTOR = 2                  # how much more frequent a form is than its variant
INDEX_WORDS = 4096          # of one index, which is 64 machine words wide
INDEX_LETTERS = 1 << 22     # of one index: fewer words where they are very long
STATE_WORDS = 1 << 18       # machine words of one state, for a block of queries
NEAR = "word string, near string, near_n long"


def vocabulary(docs: DataFrame, word: Column | None = None, min_letters: int = MIN_LETTERS,
               min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters of whole texts with A-Z lowered, counted over all of them.

    ``word`` may turn the column ``run`` into another word; ``doc_id`` is at hand as well.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(
        ascii_lower(whole_text()), F.lit(RUN_OF_LETTERS), F.lit(0))).alias("run"))
    words = runs.select((F.col("run") if word is None else word).alias("word"))
    return (words.where(F.length("word") >= min_letters).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def members(words: DataFrame) -> DataFrame:
    """(m, key, word, n): places where words one letter apart meet.

    A word of m letters meets others of m letters and of m + 1. They have the first half of the
    m letters in common, if the changed letter comes after it, or else the last half. So each
    word has two keys as the shorter one of a pair and two as the longer one.
    """
    def keys(m: Column) -> Column:
        half = F.floor(m / 2).cast("int")
        return F.array(*[F.struct(m.alias("m"), F.concat(F.lit(f"{end}:"), part).alias("key"))
                         for end, part in (("first", F.substring("word", F.lit(1), half)),
                                           ("last", F.right("word", m - half)))])

    length = F.length("word")
    return words.select("word", "n", F.explode(F.concat(keys(length), keys(length - 1)))
                        .alias("at")).select("at.m", "at.key", "word", "n")


def index_blocks(words: DataFrame) -> DataFrame:
    """(block, m, word, n, indexed): the members dealt out to blocks that fit one index.

    Members of one length and several keys share a block. A key with more members than an index
    holds is dealt into parts by a hash: each of its words is indexed in one part and looked up
    in all of them, so no block grows with the key.
    """
    placed = members(words)
    counts = placed.groupBy("m", "key").agg(F.count(F.lit(1)).alias("size"))
    fits = F.greatest(F.lit(64), F.least(F.lit(INDEX_WORDS), F.lit(INDEX_LETTERS)
                                         / F.greatest("m", F.lit(1)))).cast("long")
    sized = counts.withColumn("fits", fits).withColumn("parts", F.expr("ceil(size / fits)"))
    lengths = sized.where("parts = 1").groupBy("m").agg(
        F.expr("ceil(sum(size) / max(fits))").alias("blocks"))
    # a key of one member meets nothing
    keys = stage(sized.where("size > 1").join(lengths, "m", "left").select(
        "m", "key", "parts", F.when(F.col("parts") == 1, F.pmod(
            F.xxhash64("key"), "blocks")).alias("slot")), "spelling-keys")
    own = F.pmod(F.xxhash64("word"), "parts")
    dealt = placed.join(keys, ["m", "key"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    block = F.when(F.col("parts") == 1, F.concat_ws(":", "m", "slot")).otherwise(
        F.concat_ws(":", "m", "part", "key"))
    return dealt.select(block.alias("block"), "m", "word", "n",
                        (F.col("part") == own).alias("indexed")).dropDuplicates(["block", "word"])


class PositionIndex:
    """One bit per word in a bitset for each letter at each position."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, letters: int):
        self.letters, self.width = letters, -(-len(lengths) // 64)
        word, position = np.nonzero(np.arange(codes.shape[1]) < lengths[:, None])
        cell = position * letters + codes[word, position]
        self.cells, row = np.unique(cell, return_inverse=True)
        # a last row without bits stands for letters that no word has at a position
        self.bits = np.zeros((len(self.cells) + 1, self.width), np.uint64)
        np.bitwise_or.at(self.bits, (row, word // 64),
                         np.uint64(1) << (word % 64).astype(np.uint64))

    def of(self, position: int, letter: np.ndarray) -> np.ndarray:
        """The bitsets of one letter per query at a position."""
        cell = position * self.letters + letter
        row = np.searchsorted(self.cells, cell)
        known = np.append(self.cells, -1)[row] == cell
        return self.bits[np.where(known, row, len(self.cells))]


def _bit_places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the bits set."""
    row, at = np.nonzero(bits)
    spread = np.unpackbits(bits[row, at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                           bitorder="little")
    hit, bit = np.nonzero(spread)
    return row[hit], at[hit] * 64 + bit


def near_in_index(queries: np.ndarray, codes: np.ndarray, lengths: np.ndarray, letters: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for the words of the index that are one replaced letter or one more letter
    away from a query; all ``queries`` have the same number of letters.

    Three sets go through the letters of the queries, for all words of the index at once: those
    without an error so far, those with at most one letter replaced, and those with one letter
    more, whose positions are shifted by one.
    """
    m = queries.shape[1]
    index = PositionIndex(codes, lengths, letters)
    of_length = [np.packbits(np.pad(lengths == n, (0, index.width * 64 - len(lengths))),
                             bitorder="little").view("<u8").astype(np.uint64)
                 for n in (m, m + 1)]
    rows, found = max(STATE_WORDS // max(index.width, 1), 1), []
    for first in range(0, len(queries), rows):
        some = queries[first:first + rows]
        exact = np.full((len(some), index.width), ~np.uint64(0))
        replaced, more = np.zeros_like(exact), exact.copy()
        for k in range(m):
            here = index.of(k, some[:, k])
            replaced &= here
            replaced |= exact
            exact &= here
            more &= index.of(k + 1, some[:, k])
            more |= exact
        near = (replaced & ~exact & of_length[0]) | (more & of_length[1])
        row, word = _bit_places(near)
        found.append((row + first, word))
    return (np.concatenate([np.zeros(0, int), *[f[0] for f in found]]),
            np.concatenate([np.zeros(0, int), *[f[1] for f in found]]))


def _near_of_block(block: pa.Table) -> pa.Table:
    """The near words of one block's words, each pair under both of its words."""
    m = block["m"][0].as_py()
    words = block["word"].to_pylist()
    n = block["n"].to_numpy()
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    alphabet, flat = np.unique(points, return_inverse=True)
    codes = np.zeros((len(words), m + 1), np.int64)
    codes[np.arange(m + 1) < lengths[:, None]] = flat
    indexed = np.flatnonzero(block["indexed"].to_numpy(zero_copy_only=False))
    asked = np.flatnonzero(lengths == m)
    query, word = near_in_index(codes[asked, :m], codes[indexed], lengths[indexed],
                                len(alphabet))
    query, word = asked[query], indexed[word]
    longer = lengths[word] > m
    one, other = (np.concatenate([query, word[longer]]), np.concatenate([word, query[longer]]))
    texts = np.array(words, object)
    return pa.table({"word": pa.array(texts[one], pa.string()),
                     "near": pa.array(texts[other], pa.string()),
                     "near_n": pa.array(n[other], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all words of the vocabulary (word, n) that differ from a word by
    exactly one inserted, deleted or replaced letter; each pair under both words, once."""
    blocks = index_blocks(words)
    return blocks.groupBy("block").applyInArrow(_near_of_block, NEAR).dropDuplicates(
        ["word", "near"])


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: the form that has none, by doubling the steps. Forms
    are ever more frequent, so there are no rings, and few rounds."""
    at = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("last"))
        further = stage(at.join(on, "root", "left").select(
            "word", F.coalesce("last", "root").alias("root"),
            F.col("last").isNotNull().alias("moved")), "spelling-roots")
        at = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return at


def spelling_groups(words: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary of different words (word, n).

    The form of a word is its most frequent near word (of equal ones the first in code-point
    order), if it is at least ``factor`` times as frequent; the root is where forms lead to, the
    word itself if it has none. A word without near words has ``n_near`` 0. Other columns are
    not read; an empty vocabulary gives an empty result.
    """
    words = stage(words.select("word", "n"), "spelling-words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min_by(
            F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best"))
    is_form = F.col("best.near_n") >= factor * F.col("n")
    grouped = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, F.col("best.near_n")).alias("form_n")), "spelling-forms")
    roots = last_forms(grouped.where("form IS NOT NULL"))
    return grouped.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_planted_slip() -> Column:
    """The run, without one of its letters where the checksum of doc_id and run says so."""
    run = F.col("run")
    checksum = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), run).cast("binary"))
    gap = (checksum % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), gap), F.substring(run, gap + 2, F.length(run)))
    return F.when(checksum % 97 == 0, cut).otherwise(run)


def op13_spelling_groups(spark, sf_dir):
    """Groups of spelling variants among the words of all documents, after slips were planted."""
    return spelling_groups(vocabulary(read_documents(spark, sf_dir), with_planted_slip()))
