"""Token-id files of independently coded blocks, written in document order and read back."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from keepwatt.llm.common import read_documents, whole_text
from keepwatt.llm.range_coder import decode_block, encode_block
from keepwatt.session import stage

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
# ASCII without ' and <, and Latin-1 letters that NFC leaves as they are and that lower to one;
# then marks after a letter or digit
MARKED_WORD = (r"^[\x00-&(-;=-\x7fÀ-ÖØ-öø-ÿ]*[0-9A-Za-zÀ-ÖØ-öø-ÿ]"
               r"[!-&(-/:;=-@\[-`{-~]*$")
LETTERS = "^[a-zà-öø-ÿ]+$"
BETWEEN = "\x01"
BLOCK_IDS = 1 << 20
PIECE_BYTES = 1 << 20
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
BLOCKS = "part int, block int, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"


class Grown:
    """An array that is appended to; it holds up to half more than it needs."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.empty(3 * (self.n + len(values)) // 2, self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:self.n + len(values)] = values
        self.n += len(values)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse, modulo 2**64."""
    return tuple(np.cumprod(np.array([1] + [x] * n, np.uint64))
                 for x in (BASE, pow(BASE, -1, 1 << 64)))


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of some ranges of bytes, by differences of running sums."""
    power, inverse = _powers(1 << max(len(raw), PIECE_BYTES).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * power[:len(raw)], out=sums[1:])
    values = (sums.take(ends) - sums.take(starts)) * inverse.take(starts)
    values += (ends - starts).astype(np.uint64)
    return (values ^ values >> np.uint64(32)) * MIX


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    places = np.repeat(starts - (ends - sizes), sizes)
    places += np.arange(len(places))
    return places


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, one after the other, and where each begins and the last ends."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return raw, (bounds - bounds[0]).astype(np.int64)


class ChunkIds:
    """Ids of texts by the tokenizer, remembered for chunks between blanks and line breaks.

    The tokenizer drops white space and none of its pieces crosses it, so chunks are encoded
    alone. It lowers letters, and marks after a letter or digit are a piece of their own, so
    chunks of ASCII and Latin-1 letters that differ by those share what is learned. Words of
    such letters only are one piece, which the tokenizer's model can take as it is.

    Chunks are looked up by hash for many texts at once and compared byte by byte with what is
    remembered; one that only shares its hash is encoded apart. With more than ``limit`` chunks
    all are forgotten.
    """

    def __init__(self, path: str, limit: int = 3_000_000):
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.vocab = self.tokenizer.get_vocab_size()
        (self.between,) = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(c)[0][0]
                        for c in map(chr, range(0xE0, 0x100))}
        self.ends_word = np.zeros(self.vocab, bool)
        if suffix := self.tokenizer.model.end_of_word_suffix:
            self.ends_word[[i for token, i in self.tokenizer.get_vocab().items()
                            if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(1 << 16, -1, np.int32)
        self.hash, self.raw, self.ids = Grown(np.uint64), Grown(np.uint8), Grown(np.uint32)
        self.raw_from, self.raw_size = Grown(np.int64), Grown(np.int32)
        self.ids_from, self.n_ids = Grown(np.int64), Grown(np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entries with these hashes, -1 where there is none."""
        slot, left = self._slot(hashes), np.arange(len(hashes))
        found = self.slots.take(slot)
        while len(left):
            entry = found.take(left)
            other = (entry >= 0) & (self.hash.room.take(entry, mode="clip") != hashes.take(left))
            left = left[other]
            slot[left] = slot[left] + 1 & len(self.slots) - 1
            found[left] = self.slots.take(slot[left])
        return found

    def _add(self, raw: np.ndarray, raw_sizes: np.ndarray, ids: np.ndarray, n_ids: np.ndarray,
             hashes: np.ndarray, findable: bool = True) -> np.ndarray:
        """New entries: their bytes, ids and different hashes."""
        entries = np.arange(self.hash.n, self.hash.n + len(hashes))
        self.raw_from.append(self.raw.n + np.cumsum(raw_sizes) - raw_sizes)
        self.ids_from.append(self.ids.n + np.cumsum(n_ids) - n_ids)
        for kept, values in ((self.raw, raw), (self.raw_size, raw_sizes), (self.ids, ids),
                             (self.n_ids, n_ids), (self.hash, hashes)):
            kept.append(values)
        if findable:
            left = entries
            if 2 * self.hash.n > len(self.slots):
                old = self.slots[self.slots >= 0]
                size = 1 << (4 * self.hash.n).bit_length()
                self.slots, left = np.full(size, -1, np.int32), np.concatenate([old, entries])
            slot = self._slot(self.hash.room.take(left))
            while len(left):
                free = self.slots.take(slot) < 0
                self.slots[slot[free]] = left[free]
                lost = self.slots.take(slot) != left
                left, slot = left[lost], slot[lost] + 1 & len(self.slots) - 1
        return entries

    def _entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 ids_of) -> np.ndarray:
        """The entry of each range of bytes; ``ids_of`` gives the ids of unknown ones."""
        def added(some: np.ndarray, findable: bool) -> np.ndarray:
            sizes = ends[some] - starts[some]
            own = raw.take(_within(starts[some], sizes))
            ids, n_ids = ids_of(pa.LargeStringArray.from_buffers(
                len(some), pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(own)))
            still = self._find(hashes[some]) < 0 if findable else np.ones(len(some), bool)
            return self._add(own[np.repeat(still, sizes)], sizes[still],
                             ids[np.repeat(still, n_ids)], n_ids[still],
                             hashes[some[still]], findable)

        hashes = _hashes(raw, starts, ends)
        found = self._find(hashes)
        if len(unknown := np.flatnonzero(found < 0)):
            added(unknown[np.unique(hashes[unknown], return_index=True)[1]], True)
            found[unknown] = self._find(hashes[unknown])
        sizes = ends - starts
        same = self.raw_size.room.take(found) == sizes
        checked = np.flatnonzero(same & (sizes > 0))
        sizes = sizes[checked]
        if len(checked):
            equal = (raw.take(_within(starts[checked], sizes)) == self.raw.room.take(
                _within(self.raw_from.room.take(found[checked]), sizes)))
            if not equal.all():
                same[checked] = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
        if len(others := np.flatnonzero(~same)):
            found[others] = added(others, False)
        return found

    def _ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_ids = self.n_ids.room.take(entries)
        return self.ids.room.take(_within(self.ids_from.room.take(entries), n_ids)), n_ids

    def _by_parts(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks: those of their lowered words, then those of the marks at their ends."""
        apart = pc.match_substring_regex(chunks, MARKED_WORD)
        words = pc.if_else(apart, pc.ascii_rtrim(pc.utf8_lower(chunks), MARKS), chunks)
        raw, bounds = _bytes_of(chunks)
        sizes = pc.binary_length(words).to_numpy()
        marks_from = bounds[:-1] + sizes
        word_raw, word_bounds = _bytes_of(words)
        starts = np.stack([word_bounds[:-1], len(word_raw) + marks_from], 1).ravel()
        ends = np.stack([word_bounds[1:], len(word_raw) + bounds[1:]], 1).ravel()
        ids, n_ids = self._ids(self._entries(
            np.concatenate([word_raw, raw]), starts, ends, self._by_library))
        return ids, n_ids[::2] + n_ids[1::2]

    def _by_library(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lettered = pc.match_substring_regex(words, LETTERS)
        plain, others = words.filter(lettered), words.filter(pc.invert(lettered)).to_pylist()
        ids, n_ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for start in range(0, len(plain), 20_000):
            some = plain.slice(start, 20_000).cast(pa.string())
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            for letter, its_bytes in self.letters.items():  # quicker than str.translate
                joined = joined.replace(letter, its_bytes)
            (coded,) = self.of_words.encode_batch_fast([joined], add_special_tokens=False)
            ids.append(np.frombuffer(array("I", coded.ids), np.uint32))
            n_ids.append(np.diff(np.flatnonzero(self.ends_word[ids[-1]]), prepend=-1))
            if len(n_ids[-1]) != len(some):
                raise ValueError("the tokenizer does not end every word with a token of its own")
        for start in range(0, len(others), 2000):
            some = others[start:start + 2000]
            if any(BETWEEN in part for part in some):
                coded = [np.array(c.ids, np.uint32) for c in self.tokenizer.encode_batch_fast(
                    some, add_special_tokens=False)]
                ids += coded
                n_ids.append(np.array([len(c) for c in coded]))
            else:  # one call for all of them, cut at an id that none of them has
                coded = np.array(self.tokenizer.encode(
                    f" {BETWEEN} ".join(some), add_special_tokens=False).ids, np.uint32)
                cuts = np.flatnonzero(coded == self.between)
                ids.append(coded[coded != self.between])
                n_ids.append(np.diff(cuts, prepend=-1, append=len(coded)) - 1)
        order = np.argsort(~lettered.to_numpy(zero_copy_only=False), kind="stable")
        ids, n_ids, place = np.concatenate(ids), np.concatenate(n_ids), np.empty_like(order)
        place[order] = np.arange(len(order))
        starts = np.cumsum(n_ids) - n_ids
        return ids.take(_within(starts[place], n_ids[place])), n_ids[place]

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id after each, and how many each text has."""
        if self.hash.n > self.limit:
            self._forget()
        raw, bounds = _bytes_of(texts)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        starts = np.insert(gaps + 1, gaps.searchsorted(bounds[:-1]), bounds[:-1])
        last = gaps.searchsorted(bounds[1:])  # gaps up to the end of each text
        ends = np.insert(gaps, last, bounds[1:])
        entries = self._entries(raw, starts, ends, self._by_parts)
        end = self._add(raw[:0], np.zeros(1, int), np.array([end_id]), np.ones(1, int),
                        np.zeros(1, np.uint64), False)
        n_texts = np.arange(len(texts))
        ids, n_ids = self._ids(np.insert(entries, last + n_texts + 1, end))
        return ids, np.diff(np.cumsum(n_ids).take(last + 2 * n_texts + 1), prepend=0)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about PIECE_BYTES, or one text that is longer."""
    before = pc.binary_length(texts).to_numpy().astype(np.int64).cumsum() // PIECE_BYTES
    cuts = (np.flatnonzero(np.diff(before)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(texts)], strict=True)


@lru_cache(1)
def chunk_ids(path: str) -> ChunkIds:
    """One per worker process, so that what one task learned helps the next."""
    return ChunkIds(path)


def _blocks(path: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
                        ("payload", pa.binary())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = chunk_ids(path), TaskContext.get().partitionId()
        block, doc_ids, lengths, parts, held = 0, [], [], [], 0

        def written():
            ids = np.concatenate(parts)
            row = [part, block, len(ids), doc_ids, lengths, encode_block(ids, ids_of.vocab)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for low, high in _pieces(batch.column(1)):
                ids, n_ids = ids_of(batch.column(1).slice(low, high - low), end_id)
                ends, start, first = n_ids.cumsum(), 0, 0
                while start < len(ends):
                    stop = min(int(ends.searchsorted(first + BLOCK_IDS - held)) + 1, len(ends))
                    last = int(ends[stop - 1])
                    doc_ids += batch.column(0).slice(low + start, stop - start).to_pylist()
                    lengths += n_ids[start:stop].tolist()
                    parts.append(ids[first:last])
                    held, start, first = held + last - first, stop, last
                    if held >= BLOCK_IDS:
                        yield written()
                        block, doc_ids, lengths, parts, held = block + 1, [], [], [], 0
        if parts:
            yield written()
    return of_batches


def write_token_blocks(docs: DataFrame, path: str | None = None,
                       end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write their ids, an end id after each, in ascending doc_id order.

    Parts are ranges of doc_id; rows that share a doc_id are ordered and dealt by their text's
    hash, missing doc_ids come first, missing texts are empty. A block closes after
    BLOCK_IDS ids at the end of a document. Blocks are rows of a written table, so they are
    stored and committed as any table in the shared folder.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    given = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    coded = given.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stage(coded.mapInArrow(_blocks(path, end_id), BLOCKS), "token-blocks")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_block(row["payload"])
            lengths = np.array(row["lengths"], np.int64)
            starts = np.cumsum(lengths) - lengths
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, row["part"], np.int32)),
                pa.array(np.full(n, row["block"], np.int32)),
                pa.array(row["doc_ids"], pa.int64()), pa.array(starts),
                pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()),
                                         pa.array(ids.astype(np.int64), pa.int64()))],
                ["part", "block", "doc_id", "within", "ids"])


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like ``_read``, with the CRC-32 of a document's ids in their place."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_block(row["payload"])
            lengths = np.array(row["lengths"], np.int64)
            starts = np.cumsum(lengths) - lengths
            n, raw = len(lengths), memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * s:4 * (s + k)]) for s, k in zip(
                starts.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, row["part"], np.int32)),
                pa.array(np.full(n, row["block"], np.int32)),
                pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths),
                pa.array(crcs, pa.int64())],
                ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"])


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, first): ids before each block. Sums run over the blocks of a part, then
    over the parts, of which there are as many as shuffle partitions."""
    size = blocks.select("part", "block", "n_ids")
    parts = size.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(
        F.sum("in_part").over(before_part), F.lit(0)).alias("before"))
    before = (Window.partitionBy("part").orderBy("block")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (size.withColumn("in_blocks", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
            .join(parts, "part")
            .select("part", "block", (F.col("before") + F.col("in_blocks")).alias("first")))


def read_token_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<long>) of all documents in written blocks."""
    read = blocks.mapInArrow(
        _read, "part int, block int, doc_id long, within long, ids array<long>")
    return read.join(block_starts(blocks), ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "ids")


def read_token_digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in written blocks."""
    read = blocks.mapInArrow(_read_digests, "part int, block int, doc_id long, within long, "
                                            "n_tokens long, ids_crc32 long")
    return read.join(block_starts(blocks), ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_digests(write_token_blocks(read_documents(spark, sf_dir)))
