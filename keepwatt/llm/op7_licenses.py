"""License notices in whole texts: exact phrases, and short notices with a few edits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.llm.common import read_documents, whole_text

# Phrases, as sequences of words, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Short notices in the same form, searched with edits.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version 2 0": "mpl-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0 international": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "eclipse public license": "epl",
    "boost software license version 1 0": "bsl-1",
    "the artistic license 2 0": "artistic-2",
    "european union public licence": "eupl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this software is provided as is without any express or implied warranty": "zlib",
    "common development and distribution license": "cddl",
    "sil open font license version 1 1": "ofl",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero universal public domain dedication": "cc0",
    "open data commons open database license": "odbl",
    "community data license agreement permissive": "cdla",
}
LETTERS_PER_EDIT = 10  # one edit is allowed for each ten letters of a notice
# Everything that is not part of a word becomes a blank; A-Z become a-z.
WORDS_ONLY = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
                   else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
STEP = 1 << 20  # bytes of a long text that are searched at a time


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    edits: int

    @property
    def pattern(self) -> regex.Pattern:
        """Numbers have to stand as they are: a version is not one edit away from another."""
        parts = [p + b"(?![0-9])" if p.isdigit() else b"(?:%b){e<=%d}" % (
            regex.escape(p), self.edits) for p in regex.findall(rb"[0-9]+|[^0-9]+", self.text)]
        return regex.compile(b"(?b)" + b"".join(parts))

    def seeds(self) -> list[tuple[int, bytes]]:
        """The notice in edits + 1 pieces: one of them is untouched by so many edits."""
        cuts = [len(self.text) * k // (self.edits + 1) for k in range(self.edits + 2)]
        return [(low, self.text[low:high]) for low, high in zip(cuts, cuts[1:], strict=False)]


@lru_cache(1)
def notices(given: tuple[tuple[str, str], ...]):
    """The notices with their patterns, and an automaton of all seeds."""
    made = [Notice(t.encode(), label, len(t.replace(" ", "")) // LETTERS_PER_EDIT)
            for t, label in given]
    places: dict[bytes, list[tuple[int, int]]] = {}
    for k, notice in enumerate(made):
        for offset, seed in notice.seeds():
            places.setdefault(seed, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for seed, at in places.items():
        automaton.add_word(seed.decode("latin-1"), (len(seed), at))
    automaton.make_automaton()
    return [(n, n.pattern) for n in made], automaton


def phrase_places(words: bytes, phrase: bytes) -> list[int]:
    """Word positions where the phrase stands in blank-separated words, blanks at both ends."""
    found, at, counted, word = [], words.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += words.count(b" ", counted, at)
        counted = at
        found.append(word)
        at = words.find(b" " + phrase + b" ", at + 1)
    return found


def fuzzy_spans(words: bytes, given: tuple[tuple[str, str], ...]):
    """(label, from, to, edits, letters) of notices within their number of edits; places are
    bytes of ``words``. Seeds give the places; the pattern is tried around them only."""
    patterns, automaton = notices(given)
    spans: dict[tuple[int, int, int], int] = {}
    tried: dict[int, int] = {}
    for start in range(0, len(words), STEP):
        # the automaton takes text; one character per byte keeps the places
        part = words[start:start + STEP + 256].decode("latin-1")
        for end, (length, at) in automaton.iter(part):
            for k, offset in at:
                notice, pattern = patterns[k]
                begin = start + end - length + 1 - offset
                if begin <= tried.get(k, -1):
                    continue
                low = max(0, begin - notice.edits)
                high = begin + len(notice.text) + 2 * notice.edits
                match = pattern.search(words, low, high)
                if match and sum(match.fuzzy_counts) <= notice.edits:
                    spans[k, match.start(), match.end()] = sum(match.fuzzy_counts)
                    tried[k] = match.start()
    return [(patterns[k][0].label, low, high, edits, len(patterns[k][0].text))
            for (k, low, high), edits in sorted(spans.items(), key=lambda s: s[0][1:])]


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, "
          "spans array<struct<label:string,first_word:long,last_word:long,edits:int>>")


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None,
                  short_notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` with words, exact phrases, labels, score and fuzzy spans.

    Spans of fuzzy notices count words. A notice that stands somewhere within its number of
    edits is always found; of its finds that overlap, the best around the first seed is one
    span, and equally good ones are taken from the left. Spans of different notices may overlap.
    The score is 1 with an exact phrase, else the best share of a notice's letters that is not
    edited, 0 without any find. Missing texts count as empty; repeated rows and missing doc_ids
    stay; other columns are not read.
    """
    phrases = {k.encode(): v for k, v in (phrases or PHRASES).items()}
    given = tuple((short_notices or NOTICES).items())

    def of_text(text: bytes):
        words = text.translate(WORDS_ONLY).split()
        n_words = len(words)
        joined = b" %b " % b" ".join(words)
        del words
        places, base, labels, score, spans = [], set(), set(), 0.0, []
        for phrase, label in phrases.items():
            if found := phrase_places(joined, phrase):
                places += found
                base.add(label)
                score = 1.0
        for label, low, high, edits, letters in fuzzy_spans(joined, given):
            labels.add(label)
            score = max(score, 1 - edits / letters)
            first = joined.count(b" ", 0, low + 1) - 1
            last = first + joined[low:high].strip().count(b" ")
            spans.append({"label": label, "first_word": max(first, 0), "last_word": last,
                          "edits": edits})
        return (n_words, len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | labels)), score, spans)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
        ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
        ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                                      ("last_word", pa.int64()), ("edits", pa.int32())])))])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of_text(t.as_py()) for t in batch.column(1)]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, f.type) for c, f in zip(
                    columns, list(schema)[1:], strict=True)]], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"))
    return texts.mapInArrow(of_batches, RESULT)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir)).drop("spans")
