"""Cross-entropy difference of two matched bigram models, without a text's own counts.

Blocks of texts hold a dictionary of their distinct words and word pairs with counts in both
models. The dictionaries are cut into ranges of hashes; equal ranges of all blocks meet, are
added up, and the sums go back to the blocks, where each text is scored in place. So a word or
pair is moved once per block, and the models are never in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.llm.common import HALF, MIX, WordHashes, read_documents, whole_text, word_lists
from keepwatt.session import stage

MODELS = ("background", "target")
PRIOR = 2.0                  # weight of the single words in what follows a word, in words
BLOCK_BYTES = 16_000_000     # of texts that share a dictionary
RANGE_BYTES = 32_000_000     # of texts for each range of hashes
START, END = np.uint64(0x1E3779B97F4A7C15), np.uint64(0x3C6EF372FE94F82B)
NOT_LEARNED = -1

# kind 0 and 1 are ranges of a block's words and pairs: sorted keys and their counts in both
# models, on the way back the counts alone; kind 2 is a block of texts: keys are x and m of each
# text, one and two its role and length, words its words by their place among hashes; kind 3 are
# sums over a range of words.
NAMES = ("keys", "one", "two", "words", "hashes")
ROWS = "block long, kind int, part int, " + ", ".join(f"{name} binary" for name in NAMES)
SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()),
                    *((name, pa.binary()) for name in NAMES)])


def _packed(values: np.ndarray) -> bytes:
    """The bytes of numbers, all lowest bytes first, compressed."""
    if not len(values):
        return zstandard.compress(b"")
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.compress(planes.tobytes(), 3)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _row(block: int, kind: int, part: int, *data: bytes | None) -> pa.RecordBatch:
    values = [block, kind, part, *data, *[None] * (len(NAMES) - len(data))]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip(values, SCHEMA, strict=True)], schema=SCHEMA)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of pairs from the hashes of their words."""
    keys = (before * MIX) ^ words
    keys ^= keys >> HALF
    keys *= MIX
    return keys ^ (keys >> HALF)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of 64-bit hashes ends in sorted keys."""
    edges = [(1 << 64) * k // parts for k in range(1, parts)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


def _block_row(block: int, texts: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
    """A block's texts, their words numbered by frequency. The end of a text counts as a word
    that follows its last one, so every word has as many successors as places."""
    found, at, counts = np.unique(np.concatenate([np.append(h, END) for h in hashes]),
                                  return_inverse=True, return_counts=True)
    by_rank = np.argsort(-counts, kind="stable")
    rank = np.empty(len(found), "<u4")
    rank[by_rank] = np.arange(len(found))
    keys = np.array([t[:2] for t in texts], "<i8")
    return _row(block, 2, 0, _packed(keys.ravel()), _packed(np.array([t[2] for t in texts], "<i4")),
                _packed(np.array([len(h) for h in hashes], "<u4")), _packed(rank[at]),
                _packed(found[by_rank]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of_word, size = WordHashes(), 0
    block, texts, hashes = TaskContext.get().partitionId() << 32, [], []
    for batch in batches:
        for x, m, role, text in zip(*batch.columns, strict=True):
            text = text.as_py()
            texts.append((x.as_py(), m.as_py(), role.as_py()))
            hashes.append(np.concatenate([np.zeros(0, np.uint64), *[
                np.array([of_word[w] for w in words], np.uint64)
                for words in word_lists(text)]]))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield _block_row(block, texts, hashes)
                block, texts, hashes, size = block + 1, [], [], 0
    if texts:
        yield _block_row(block, texts, hashes)


class _Texts:
    """A block of texts: role and span of each, and all words after the ones before them."""

    def __init__(self, row: dict):
        self.keys = _unpacked(row["keys"], "<i8").reshape(-1, 2)
        self.roles = _unpacked(row["one"], "<i4")
        self.lengths = _unpacked(row["two"], "<u4").astype(np.int64)
        self.at, self.hashes = _unpacked(row["words"], "<u4"), _unpacked(row["hashes"], "<u8")
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.words = self.hashes[self.at]
        self.before = np.concatenate([[START], self.words[:-1]])
        self.before[self.starts] = START
        self.pairs = pair_keys(self.before, self.words)


def _dictionaries(kind: int, parts: int):
    """Ranges of the distinct words (kind 0) or pairs (kind 1) of blocks, with how often learned
    texts of each role have them."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = _Texts(row)
                roles = np.repeat(texts.roles, texts.lengths + 1)
                found, at = np.unique(texts.pairs if kind else texts.words, return_inverse=True)
                counts = [np.bincount(at[roles == role], minlength=len(found)).astype("<u4")
                          for role in range(len(MODELS))]
                low = 0
                for part, high in enumerate(_cuts(found, parts).tolist()):
                    if low < high:
                        yield _row(row["block"], kind, part, _packed(found[low:high]),
                                   *(_packed(c[low:high]) for c in counts))
                    low = high
    return of_batches


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one kind, sorted by part: one range of all blocks is added up at a time. A block
    gets the sums of its keys in their order, and has the keys itself."""
    def sums_of(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys = [_unpacked(r["keys"], "<u8") for r in rows]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.bincount(at, np.concatenate([_unpacked(r[c], "<u4") for r in rows]),
                              len(found)).astype("<u4") for c in ("one", "two")]
        ends = np.cumsum([len(k) for k in keys])
        kind, part = rows[0]["kind"], rows[0]["part"]
        for row, own, end in zip(rows, keys, ends.tolist(), strict=True):
            mine = at[end - len(own):end]
            yield _row(row["block"], kind, part, None, *(_packed(t[mine]) for t in totals))
        if kind == 0:
            learned = totals[0] + totals[1] > 0
            yield _row(-1, 3, part, np.array(
                [learned.sum(), *(t.sum(dtype=np.int64) for t in totals)], "<i8").tobytes())

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["part"] != row["part"]:
                yield from sums_of(held)
                held = []
            held.append(row)
    if held:
        yield from sums_of(held)


class _Counts:
    """The counts of a block's words or pairs in both models, from its ranges in order."""

    def __init__(self, values: np.ndarray, rows: list[dict]):
        self.keys, self.at = np.unique(values, return_inverse=True)
        self.counts = [np.concatenate([_unpacked(r[c], "<u4") for r in rows]).astype(float)
                       for c in ("one", "two")]

    def of_places(self, model: int) -> np.ndarray:
        return self.counts[model][self.at]


def _own(values: np.ndarray) -> np.ndarray:
    """How often each value stands among the values."""
    _, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[at]


def text_loss(word: np.ndarray, pair: np.ndarray, before: np.ndarray, own: list[np.ndarray],
              total: int, vocabulary: int, scale: float) -> np.ndarray:
    """Losses of words given the counts of each word, its pair and the word before it, in a
    model of ``total`` words, and how often the text itself has them (``own``, else zeros)."""
    single = np.maximum(word - own[0], 0) * scale + 1
    single /= max(total - own[3], 0) * scale + vocabulary
    follows = np.maximum(pair - own[1], 0) * scale + PRIOR * single
    return -np.log(follows / (np.maximum(before - own[2], 0) * scale + PRIOR))


def _scored(totals: list[int], vocabulary: int):
    """Per block first its summed dictionaries, then its texts, scored one by one."""
    # both models count as many words as the smaller one
    scales = [min(totals) / total if total else 1.0 for total in totals]

    def scores_of(texts: _Texts, words: _Counts, pairs: _Counts) -> pa.RecordBatch:
        counts = []
        for k in range(len(MODELS)):
            of_word = words.of_places(k)
            before = np.concatenate([[0], of_word[:-1]])
            # as many texts start as end
            before[texts.starts] = words.counts[k][np.searchsorted(words.keys, END)]
            counts.append((of_word, pairs.of_places(k), before))
        found = np.zeros(len(texts.lengths))
        for t, (role, start, n) in enumerate(zip(
                texts.roles.tolist(), texts.starts.tolist(), texts.lengths.tolist(), strict=True)):
            if not n:
                continue
            span, whole = slice(start, start + n), slice(start, start + n + 1)
            none = [0, 0, 0, 0]
            if role != NOT_LEARNED:
                of_word = _own(texts.at[whole])
                own = [of_word[:-1], _own(texts.pairs[whole])[:-1],
                       np.concatenate([[1], of_word[:-2]]), n + 1]
            loss = [text_loss(*(c[span] for c in counts[k]), own if role == k else none, totals[k],
                              vocabulary, scales[k]) for k in range(len(MODELS))]
            found[t] = (loss[1] - loss[0]).mean()
        return pa.RecordBatch.from_arrays(
            [pa.array(texts.keys[:, 0]), pa.array(texts.keys[:, 1].astype(np.int32)),
             pa.array(texts.lengths), pa.array(found)], ["x", "m", "n_tokens", "score"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, parts = row["block"], {0: [], 1: []}
                if row["kind"] < 2:
                    parts[row["kind"]].append(row)
                else:
                    texts = _Texts(row)
                    yield scores_of(texts, _Counts(texts.words, parts[0]),
                                    _Counts(texts.pairs, parts[1]))
    return of_batches


def distinct_texts(docs: DataFrame, labels: DataFrame, learn: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, x, m) of all rows, and (x, m, role, text) of all different texts. A text is
    target if one of its copies has quality 1, and learned from if ``learn`` holds for one."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("x"),
                       F.hash(text).alias("m"), F.coalesce(F.expr(learn), F.lit(False)).alias("learn"),
                       text.cast("binary").alias("text"))
    good = labels.where("quality = 1").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("good")).distinct()
    targets = rows.select("doc_id", "x", "m").join(good, "doc_id").select("x", "m", "good").distinct()
    texts = rows.groupBy("x", "m").agg(F.max("learn").alias("learn"),
                                       F.any_value("text").alias("text"))
    # both sides grow with the corpus
    marked = texts.join(targets.hint("merge"), ["x", "m"], "left")
    role = F.when(F.col("learn"), F.coalesce("good", F.lit(0))).otherwise(NOT_LEARNED)
    return rows.select("doc_id", "x", "m"), marked.select("x", "m", role.alias("role"), "text")


def score(docs: DataFrame, labels: DataFrame, learn: str = "true") -> DataFrame:
    """(doc_id, n_tokens, score): the mean over a text's words of the loss under the target
    model less that under the background model; lower is closer to the target.

    The target model learns from the texts that ``labels`` (doc_id, quality) gives quality 1, the
    background model from all others, each different text once. ``learn`` is a condition on
    ``docs``; other texts are scored only. The models share one vocabulary of words, told apart
    by 64 bits, and are matched: the counts of the larger one are scaled to the number of words
    of the smaller one. A word's loss comes from the pair with the word before it, smoothed by
    the single word. A text that was learned from is scored without its own counts, so its score
    says nothing of its own label.

    A text without words has the score 0. Missing texts are empty ones, copies have equal scores,
    repeated rows and missing doc_ids stay, other columns are not read. Without any learned text
    all scores are 0.
    """
    spark = docs.sparkSession
    keys, texts = distinct_texts(docs, labels, learn)
    sizes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes // RANGE_BYTES))
    blocks = stage(texts.mapInArrow(_blocks, ROWS), "language-blocks")

    def sums_of(kind: int) -> DataFrame:
        ranges = blocks.mapInArrow(_dictionaries(kind, parts), ROWS)
        return ranges.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
            _added_up, ROWS)

    # the sums of words are needed twice, those of pairs go to their blocks at once
    words = stage(sums_of(0), "language-words")
    totals = np.zeros(1 + len(MODELS), np.int64)
    # one small row per range
    for row in words.where("kind = 3").select("keys").toLocalIterator():
        totals += np.frombuffer(row["keys"], "<i8")
    vocabulary, *of_models = (int(v) for v in totals)
    scores = (words.where("kind = 0").union(sums_of(1)).union(blocks).repartition("block")
              .sortWithinPartitions("block", "kind", "part")
              .mapInArrow(_scored(of_models, vocabulary + 1),
                          "x long, m int, n_tokens long, score double"))
    of_texts = stage(scores, "language-scores")
    return keys.join(of_texts.hint("merge"), ["x", "m"]).select("doc_id", "n_tokens", "score")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))
