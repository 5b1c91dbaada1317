"""Periodic runs of words: recursive splitting at rare words, then a scan by lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwatt.llm.common import HALF, MIX, read_documents, whole_text

MIN_LENGTH = 12            # words of a run; two periods are the other least length
SHORT_LAGS = 8             # lags below it are compared in full
BATCH_BYTES = 8_000_000    # of texts whose words are numbered and split together
HIT_ROWS = 1 << 21         # places compared at once in a scan

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
        "collapsed string")


def frequent_segments(codes: np.ndarray, cuts: np.ndarray,
                      least: int) -> list[tuple[int, int]]:
    """The stretches (start, end) that may hold runs, for texts that start at ``cuts``.

    Every word of a run stands in it twice or more, so a word that is alone in its segment
    belongs to no run and splits it. Pieces shorter than ``least`` go. The others are counted
    anew, until no segment holds a word that is alone. All segments split in one pass per round;
    those that are stable leave.
    """
    place = np.arange(len(codes))
    segment = np.searchsorted(cuts, place, side="right")
    words, done = int(codes.max(initial=0)) + 1, []
    while len(place):
        _, group, counts = np.unique(segment * words + codes[place], return_inverse=True,
                                     return_counts=True)
        alone = counts[group] < 2
        split = np.zeros(int(segment.max()) + 1, bool)
        split[segment[alone]] = True
        stable = ~split[segment]
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        ends = np.append(starts[1:], len(segment))
        done += [(int(place[s]), int(place[e - 1]) + 1)
                 for s, e in zip(starts, ends, strict=True) if stable[s] and e - s >= least]
        stay = ~alone & ~stable
        place, segment = place[stay], segment[stay]
        if not len(place):
            break
        breaks = (np.diff(place, prepend=-2) != 1) | (np.diff(segment, prepend=-1) != 0)
        segment = np.cumsum(breaks) - 1
        long = np.bincount(segment)[segment] >= least
        place, segment = place[long], segment[long]
        segment = np.cumsum(np.diff(segment, prepend=-1) != 0) - 1
    return sorted(done)


def _matches(codes: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places in a row from ``at``, going by ``step``, equal the one ``lag`` later."""
    total, size = 0, 64
    while True:
        if step > 0:
            low, high = at + total, min(at + total + size, len(codes) - lag)
        else:
            low, high = max(at - total - size + 1, 0), at - total + 1
        if low >= high:
            return total
        differ = codes[low:high] != codes[low + lag:high + lag]
        if step < 0:
            differ = differ[::-1]
        if differ.any():
            return total + int(differ.argmax())
        total += high - low
        size *= 2


def _hits(hashes: np.ndarray, window: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of equal windows for all lags from 2 to 4 windows, at every window-th place.

    A run of such a lag repeats at least two windows, so one whole window of it starts there.
    """
    low, width = 2 * window, 2 * window
    padded = np.concatenate([hashes, np.zeros(low + width, np.uint64)])
    later = np.lib.stride_tricks.sliding_window_view(padded, width)[low::window]
    anchors = hashes[::window]
    anchors = anchors[:max((n - low - window) // window + 1, 0)]
    rows = max(HIT_ROWS // width, 1)
    for first in range(0, len(anchors), rows):
        some = anchors[first:first + rows]
        place, lag = np.nonzero(later[first:first + len(some)] == some[:, None])
        place, lag = (place + first) * window, lag + low
        inside = place + lag + window <= n
        yield place[inside], lag[inside]


def scan_by_lag(codes: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """{(start, end): period} of all runs in one segment.

    Short lags compare all words. Longer ones are taken by doubling ranges: a hash of a window
    at every window-th place is compared with those at all lags of the range, and what is equal
    is followed word by word to both sides. So the work is the length times its logarithm. A
    stretch of the same bounds has one smallest period, which comes first.
    """
    n, found = len(codes), {}
    for lag in range(1, min(SHORT_LAGS, n // 2 + 1)):
        same = np.concatenate([[0], codes[lag:] == codes[:-lag], [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        starts, ends = edges[::2], edges[1::2]
        for k in np.flatnonzero(ends - starts >= max(least - lag, lag)):
            found.setdefault((int(starts[k]), int(ends[k]) + lag), lag)
    window, hashes = 1, codes.astype(np.uint64) + np.uint64(1)
    while 4 * window <= n:
        if 2 * window >= SHORT_LAGS:
            known = sorted((s, e, p) for (s, e), p in found.items())
            for place, lag in _hits(hashes, window, n):
                if known and len(place):
                    starts, ends, periods = np.array(known).T
                    furthest = np.maximum.accumulate(ends)
                    of = np.maximum.accumulate(np.where(ends == furthest, np.arange(len(ends)), 0))
                    k = np.searchsorted(starts, place, side="right") - 1
                    inside = (k >= 0) & (furthest[k] >= place + lag + window)
                    new = ~(inside & (lag % periods[of[k]] == 0))
                    place, lag = place[new], lag[new]
                order = np.lexsort((place, lag))
                at, upto = 0, -1
                for x, q in zip(place[order].tolist(), lag[order].tolist(), strict=True):
                    if q == at and x < upto:
                        continue
                    right = _matches(codes, x, q, 1)
                    at, upto = q, x + right
                    start = x - (_matches(codes, x - 1, q, -1) if x else 0)
                    if upto + q - start >= max(least, 2 * q):
                        found.setdefault((start, upto + q), q)
        hashes = (hashes[:-window] * MIX) ^ hashes[window:]
        hashes ^= hashes >> HALF
        hashes *= MIX
        window *= 2
    return found


def runs_of(codes: np.ndarray, cuts: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, end, period) by start and period; ``cuts`` are the ends of the texts."""
    found = [(first + s, first + e, p) for first, last in frequent_segments(codes, cuts, least)
             for (s, e), p in scan_by_lag(codes[first:last], least).items()]
    runs = np.array(found, np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batch(doc_ids: list, texts: list[bytes], least: int) -> pa.RecordBatch:
    words = [t.split() for t in texts]
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for some in words for w in some],
                     np.int64)
    ends = np.cumsum([len(some) for some in words])
    starts = np.concatenate([[0], ends[:-1]])
    runs = runs_of(codes, ends, least)
    dropped = np.zeros(len(codes) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    of_text = np.searchsorted(runs[:, 0], np.append(starts, len(codes)))
    own_start = runs[:, 0] - starts[np.searchsorted(ends, runs[:, 0], side="right")]
    collapsed = [
        b" ".join(w for w, k in zip(some, kept[s:e].tolist(), strict=True) if k)
        if low < high else b" ".join(some)
        for some, s, e, low, high in zip(
            words, starts, ends, of_text[:-1], of_text[1:], strict=True)]
    structs = pa.StructArray.from_arrays(
        [pa.array(own_start), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
        fields=list(RUN))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array([len(some) for some in words], pa.int64()),
         pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), structs),
         pa.array(collapsed, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row per row of ``docs``.

    A run is a stretch of consecutive words with a smallest period, of at least ``min_length``
    words and two periods, that no neighbouring word extends; runs are structs (start, length,
    period), numbered in words, by start and then period. ``collapsed`` are the words that no
    run holds after its first period, with single blanks between them.

    A missing text has no words, no runs and an empty ``collapsed``, like an empty one. Runs of
    one stretch are one run with its smallest period; runs of different stretches may overlap.
    Repeated rows and missing doc_ids stay as they are, other columns are not read. Each text is
    handled as a whole by the task that reads it, in time close to linear; there is no shuffle.
    """
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield _batch(doc_ids, texts, min_length)
                    doc_ids, texts, size = [], [], 0
            if texts:
                yield _batch(doc_ids, texts, min_length)

    given = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"))
    return given.mapInArrow(of_batches, RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of every tenth checksum of doc_id repeat a stretch of their words
    from some word on to the end."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(whole_text(), r"[\x20\x09-\x0D]+"), "")
    chosen = docs.select(
        F.col("doc_id").cast("long"), "text",
        F.floor(checksum / 10).alias("g"),
        F.when(checksum % 10 == 0, words).otherwise(F.array().cast("array<string>")).alias("w"))
    placed = chosen.withColumn("n", F.size("w")).withColumn(
        "a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(0).cast("int")).withColumn(
        "p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    stretch = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")),
                             F.ceil(left / F.col("p")).cast("int"))
    repeated = F.concat(F.slice("w", F.lit(1), F.col("a")),
                        F.slice(F.flatten(stretch), F.lit(1), left))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " "))
                         .otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    """Runs of the documents' words after stretches were planted in a tenth of them."""
    found = periodic_runs(with_planted_runs(read_documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    exponent = F.expr("1000 * best.length div -best.period")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), exponent.alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
