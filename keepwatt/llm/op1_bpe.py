"""Byte-level BPE: every distinct word of the corpus is encoded once."""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwatt.llm.common import read_documents, whole_text
from keepwatt.session import stage

RANKS = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 32_000_000   # texts of a block share one dictionary of words
LONG_TEXT = 4_000_000      # longer texts are split word by word, without a list of all words
GROUP_WORDS = 300_000      # words of the texts in one row

# kind 0 is a part of a block's dictionary: a codes, b words or ids, c their lengths;
# kind 1 is a group of its texts: a codes by place, b words of each text.
ROWS = "block long, kind int, part int, a binary, b binary, c binary, doc_ids array<long>"
SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()),
                    ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()),
                    ("doc_ids", pa.list_(pa.int64()))])


@lru_cache(2)
def token_bytes(path: str) -> dict[int, bytes]:
    """The table of token ids and their bytes."""
    with open(path, "rb") as lines:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={b: i for i, b in token_bytes(path).items()})


class _Codes(dict):
    """Words numbered by their first place in the block."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _pack(values: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all lowest bytes first, compressed."""
    planes = np.asarray(values).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 6)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip(values, SCHEMA, strict=True)], schema=SCHEMA)


def _block_rows(block: int, buckets: int, codes: dict[str, int], doc_ids: list, texts: list):
    """A block's dictionary, dealt into buckets by hash, and its texts as codes. Codes are
    changed to ranks by frequency, which take fewer bytes."""
    places = np.concatenate([np.frombuffer(t, np.uint32) for t in texts])
    by_rank = np.argsort(-np.bincount(places, minlength=len(codes)), kind="stable")
    rank = np.empty(len(codes), np.uint32)
    rank[by_rank] = np.arange(len(codes))
    places = rank[places]
    words = np.array([w.encode() for w in codes], object)[by_rank]
    bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
    order = np.argsort(bucket, kind="stable")
    filled, cuts = np.unique(bucket[order], return_index=True)  # none without words
    for k, low, high in zip(filled.tolist(), cuts, np.append(cuts, len(order))[1:], strict=True):
        mine = order[low:high]
        yield _row(block, 0, k, _pack(np.diff(mine, prepend=0)),
                   zstandard.compress(b"".join(words[mine]), 6),
                   _pack([len(w) for w in words[mine]]), None)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    groups = (ends - lengths) // GROUP_WORDS
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    for k, (low, high) in enumerate(zip(starts, [*starts[1:], len(texts)], strict=True)):
        yield _row(block, 1, k, _pack(places[ends[low] - lengths[low]:ends[high - 1]]),
                   _pack(lengths[low:high]), None, doc_ids[low:high])


def _split(buckets: int):
    """Texts to words: per block the distinct words, per text the codes of its words by place."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(public_tokenizers.PATTERN)
        block, codes, chars = TaskContext.get().partitionId() << 32, _Codes(), 0
        doc_ids, texts = [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if len(text) > LONG_TEXT:
                    words = (m.group() for m in find.finditer(text))
                else:
                    words = find.findall(text)
                texts.append(array("I", map(codes.__getitem__, words)))
                doc_ids.append(doc_id.as_py())
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield from _block_rows(block, buckets, codes, doc_ids, texts)
                    block, codes, chars, doc_ids, texts = block + 1, _Codes(), 0, [], []
        if texts:
            yield from _block_rows(block, buckets, codes, doc_ids, texts)
    return of_batches


def _encode_words(path: str):
    """Dictionary parts, sorted by bucket: a word of a bucket is encoded once for all blocks."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word, bucket, known = encoding(path).encode_ordinary, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != bucket:
                    bucket, known = row["part"], {}
                ends = np.cumsum(_unpack(row["c"])).tolist()
                blob, ids = zstandard.decompress(row["b"]), []
                for low, high in zip([0, *ends], ends, strict=False):
                    word = blob[low:high]
                    if word not in known:
                        known[word] = encode_word(word.decode())
                    ids.append(known[word])
                flat = np.array([i for word in ids for i in word], np.uint32)
                yield _row(row["block"], 0, bucket, row["a"], _pack(flat),
                           _pack([len(w) for w in ids]), None)
    return of_batches


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start : start + length] for all starts, one after the other."""
    if not len(lengths):
        return pool[:0]
    before = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block first its words' ids, then its texts, whose ids are put together by place."""
    at, parts, pool, starts, lengths = None, [], None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != at:
                at, parts, pool = row["block"], [], None
            if row["kind"] == 0:
                parts.append((np.cumsum(_unpack(row["a"])), _unpack(row["b"]),
                              _unpack(row["c"])))
                continue
            if pool is None:
                pool = np.concatenate([np.zeros(0, np.uint32), *[p[1] for p in parts]]).astype(
                    np.int32)
                own = np.concatenate([np.zeros(0, np.uint32), *[p[2] for p in parts]]).astype(
                    np.int64)
                codes = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
                lengths, starts = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                codes = codes.astype(np.int64)
                lengths[codes], starts[codes] = own, np.cumsum(own) - own
                parts = []
            places, words = _unpack(row["a"]), _unpack(row["b"]).astype(np.int64)
            sizes = lengths[places]
            ids = _gather(pool, starts[places], sizes)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(words)])]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                ["doc_id", "ids"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): one row per row of ``docs``; a missing text has no ids.

    The texts are split once. The distinct words of each block of texts are shuffled by hash,
    so that equal words of all blocks meet and are encoded once, and the ids go back to the
    blocks, where the texts are put together by place. A frequent word goes once per block.
    Rows hold many words or texts, compressed, so the shuffles are smaller than the texts.
    The split is a written table, so a lost task sees the same blocks again. Repeated rows and
    missing doc_ids stay as they are; other columns are not read.
    """
    path = path or public_tokenizers.path(RANKS)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    split = stage(given.mapInArrow(_split(buckets), ROWS), "bpe-split")
    parts = split.where("kind = 0").repartition(buckets, "part").sortWithinPartitions("part")
    encoded = parts.mapInArrow(_encode_words(path), ROWS)
    return (encoded.union(split.where("kind = 1")).repartition("block")
            .sortWithinPartitions("block", "kind", "part")
            .mapInArrow(_assemble, "doc_id long, ids array<int>"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the column decoded binary. Ids are joined with the table
    of token bytes, which is as large as the vocabulary and is held by each task. Missing ids
    give missing bytes, an id that the table lacks is an error."""
    path = path or public_tokenizers.path(RANKS)

    def of_batches(batches):
        table = token_bytes(path)
        for batch in batches:
            texts = [None if ids is None else b"".join(map(table.__getitem__, ids))
                     for ids in (x.values.to_numpy().tolist() if x.is_valid else None
                                 for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(
        of_batches, "doc_id long, ids array<int>, decoded binary")


def op1_bpe(spark, sf_dir):
    both = decode(encode(read_documents(spark, sf_dir)))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
