"""Operators against brute force on small tables with nulls, ties, repeats and odd texts."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keepwatt.llm import (
    common, op1_bpe, op2_personal_data, op3_token_files, op4_language_model, op5_decontamination,
    op6_line_quality, op7_licenses, op8_hilbert, op9_separators, op10_simhash, range_coder,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, fp string"
PROSE = " ".join(f"word{k * 7919 % 1000} thing{k}" for k in range(60))
LONG = "\n".join(f"Line {k}, of 'many'.  It's a+b@c.de " * 3 for k in range(400))
TEXTS = [
    PROSE, PROSE, PROSE.replace("thing7 ", "other "), "", None, " \n\t ", "a", "A b", "a b c a b c a b",
    LONG, "é́ ß x y \x1f\x0b z <|endoftext|> 's'S ''' 12345 \n\n  end ",
    "Mail Bob.X@mail.example.com, x@y.z%q@r.s or +1 (743) 555-3824; ip 1.2.3.4.5.6.7.8 999.1.1.1 "
    "card 4539 1488 0343 6467, 4539-1488-0343-6468, 12 34",
    "Released under the MIT License. Licensed under the Apache Lisence, Version 2.0. CC BY-NC",
    "This work is licensed under the GNU General Public License, version 3.",
    "l1\nl1\n \n \nl2 $$ ##", "日本語 テキスト 😀😀 مرحبا",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), 1, "x") for k, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, "no id", None, None, None, None, None),
             (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bpe_equals_library_and_round_trips(docs, nothing):
    path = public_tokenizers.path(op1_bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
    got = op1_bpe.decode(op1_bpe.encode(docs)).collect()
    want = sorted(((i, library.encode_ordinary(t), t.encode()) for i, t in pairs(docs)), key=repr)
    assert sorted(((r[0], list(r[1]), bytes(r[2])) for r in got), key=repr) == want
    assert op1_bpe.encode(nothing).count() == 0


def test_bpe_of_texts_without_words(spark):
    rows = [(1, ""), (2, None)] + [(k, "") for k in range(3, 40)]
    for empty in (rows[:2], rows):
        docs = spark.createDataFrame(empty, "doc_id long, text string").repartition(3)
        got = op1_bpe.decode(op1_bpe.encode(docs)).collect()
        assert sorted((r[0], list(r[1]), bytes(r[2])) for r in got) == [
            (k, [], b"") for k, _ in empty]


def test_bpe_of_long_texts_and_many_blocks(docs):
    whole = listed(op1_bpe.encode(docs))
    again = docs.select("doc_id", F.concat("text", F.lit("")).alias("text")).repartition(7)
    assert listed(op1_bpe.encode(again)) == whole


def test_personal_data_equals_plain_search(docs, nothing):
    digits = lambda h: re.sub("[^0-9]", "", h)

    def luhn(number):
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(x) < 256 for x in h.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda h: 13 <= len(digits(h)) <= 19 and luhn(digits(h))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= len(digits(h)) <= 15)]
    want = sorted(((i, [(k, m.start(), m.end()) for k, (p, ok) in enumerate(rules)
                        for m in re.finditer(p, t) if ok(m.group())])
                   for i, t in pairs(docs)), key=repr)
    got = op2_personal_data.personal_data(docs).collect()
    assert sorted(((r["doc_id"], [tuple(s) for s in r["base"]]) for r in got), key=repr) == want
    assert all([s for s in r["spans"]][:len(r["base"])] == list(r["base"]) for r in got)
    assert op2_personal_data.personal_data(nothing).count() == 0


def test_contexts_of_known_data_find_more(spark):
    known = [f"text {k} account: user{k}@mail{k}.org ok" for k in range(40)]
    rows = [(k, t) for k, t in enumerate([*known, "see account: zx-778-k9 and room 1234567"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in op2_personal_data.personal_data(docs).collect()}
    spans = [rows[40][1][s["start"]:s["end"]] for s in got[40]["spans"]]
    assert spans == ["zx-778-k9"]


def spans_found(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    return {(r["doc_id"], texts[r["doc_id"]][s["start"]:s["end"]])
            for r in op2_personal_data.personal_data(docs).collect()
            for s in r["spans"] if s["kind"] == 4}


def test_contexts_are_scored_by_all_their_places(spark):
    """Planted contexts are learned, the stop words around them are not, however many known
    things they stand before; chains of patterns go on until nothing changes."""
    draw = np.random.default_rng(9)
    filler = "the of and water light house tree".split()

    def prose(n):
        return " ".join(draw.choice(filler, n))

    texts = [f"{prose(9)} write to the member no: m{k}@mail.org today {prose(9)}" for k in range(30)]
    texts += [f"{prose(5)} of the u{k}@mail.org {prose(5)} and the +1 743 555 38{k}0 {prose(5)}"
              for k in range(10, 25)]
    texts += [f"{prose(8)} the {71234560 + k} {prose(3)} of {8000000 + k}, {prose(4)}" for k in range(40)]
    texts += [f"{prose(4)} Member No: ZX-{7000 + k}. {prose(4)} staff badge ZX-{7000 + k} " for k in range(4)]
    texts += [f"{prose(3)} staff badge QQ{9000 + k}-A {prose(6)}" for k in (0, 1)]
    texts += ["ZX-7001 stands at the start, 55 QQ9001-A after a number", "QQ9000-A", prose(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {(k, m) for k, t in enumerate(texts) for m in re.findall(r"ZX-700\d|QQ900\d-A", t)}
    assert len(want) == 9 and spans_found(docs) == want
    # the last link of the chain is only reached through the one before
    assert {w for k, w in want if w.startswith("QQ")} == {"QQ9000-A", "QQ9001-A"}


def test_long_identifiers_and_words_before_them(spark):
    long_id, long_word = "k9" * 400, "w" * 3000
    texts = [f"{long_word}\n\n-- :: {k}a@b.org" for k in range(5)]
    texts += [f"x {long_word} {long_id} y", f"{long_id}", "1" + "-" * 5000 + "é", "7." * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert spans_found(docs) == {(5, long_id), (6, long_id)}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "hi a@b.cd and +1 (743) 555-3824!", 30), (2, "clean", 5),
                                  (3, None, 0)], "doc_id long, text string, n_chars int")
    assert listed(op2_personal_data.redacted(docs)) == [
        (1, "hi [EMAIL] and [PHONE]!", 23), (2, "clean", 5), (3, None, 0)]


def test_token_files_equal_library(docs, nothing):
    library = Tokenizer.from_file(public_tokenizers.path(op3_token_files.TOKENIZER))
    blocks = op3_token_files.write_token_blocks(docs)
    got = sorted(op3_token_files.read_token_blocks(blocks).collect(), key=lambda r: r["start"])
    ids = {t: library.encode(t, add_special_tokens=False).ids + [1] for _, t in pairs(docs)}
    assert [r["doc_id"] for r in got] == sorted(
        (i for i, _ in pairs(docs)), key=lambda i: (i is not None, i))
    assert sorted((repr((r["doc_id"], list(r["ids"]))) for r in got)) == sorted(
        repr((i, ids[t])) for i, t in pairs(docs))
    assert [r["start"] for r in got] == list(np.cumsum([0, *[len(r["ids"]) for r in got]])[:-1])
    digests = op3_token_files.read_token_digests(blocks).collect()
    crc = {r["start"]: zlib.crc32(np.array(r["ids"], "<u4")) for r in got}
    assert {r["start"]: r["ids_crc32"] for r in digests} == crc
    assert op3_token_files.write_token_blocks(nothing).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4096, 4097, 9000])
def test_range_coder_round_trip(n):
    numbers = np.random.default_rng(n)
    for ids in (numbers.integers(0, 50_000, n), np.zeros(n, int), numbers.zipf(1.3, n) % 5000):
        data = range_coder.encode_block(ids, 50_000)
        assert (range_coder.decode_block(data) == ids).all()


def test_range_coder_sees_damage():
    data = bytearray(range_coder.encode_block(np.arange(5000) % 300, 400))
    data[-9] ^= 4
    with pytest.raises((ValueError, IndexError)):
        range_coder.decode_block(bytes(data))


ODD = ["É été. ÉTÉ, Été!! ÿ Ÿ ß ẞ ª µ ×÷ ²", "H\u0331 h\u0331 I\u0307 e\u0301, E\u0301. a\u0308.", "",
       "<|endoftext|>. x<|endoftext|>, <|ENDOFTEXT|> endoftext|>. l'été, l'S, 's. 'S '", "   \n\n ",
       "a\x00b, a\x00b \x01 x\x01y, \x1f, a\tb. a\tB, İSTANBUL, ǅ ﬁ. 日本, 12, a1. 1a!? ...a. .,",
       "\u0301 \u0301, \u200d, \xa0a,\xa0b a_b_ (c) [d]~ {e|f} g|h> i>. j`", "été" * 3000 + ". z"]


def token_ids(texts, **settings):
    encoder = op3_token_files.ChunkIds(
        public_tokenizers.path(op3_token_files.TOKENIZER), **settings)
    given = pa.array(["not this one", *texts, "nor this"]).slice(1, len(texts))
    for _ in range(2):  # unknown, then remembered
        ids, n_ids = encoder(given, 1)
    return [part.tolist() for part in np.split(ids, n_ids.cumsum()[:-1])]


@pytest.mark.parametrize("hashes", ["real", "all the same"])
def test_token_ids_of_chunks_equal_the_library(hashes, monkeypatch):
    if hashes != "real":  # chunks with one hash are told apart by their bytes
        monkeypatch.setattr(op3_token_files, "_hashes",
                            lambda raw, starts, ends: np.full(len(starts), 7, np.uint64))
    library = Tokenizer.from_file(public_tokenizers.path(op3_token_files.TOKENIZER))
    texts = [*ODD, *(t or "" for t in TEXTS)]
    assert token_ids(texts) == [
        library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert token_ids(texts, limit=0) == token_ids(texts)


def test_words_with_other_capitals_and_marks_are_encoded_once():
    encoder = op3_token_files.ChunkIds(public_tokenizers.path(op3_token_files.TOKENIZER))
    asked, by_library = [], encoder._by_library
    encoder._by_library = lambda words: asked.extend(words.to_pylist()) or by_library(words)
    encoder(pa.array(["élan Élan élan, ÉLAN!! (élan", "Élan. the The the, élan"]), 1)
    assert sorted(asked) == sorted(["", "élan", "the", ",", ".", "!!", "(élan"])


LABELLED = "doc_id long, text string, quality int, learn boolean"


def plain_scores(rows):
    """Mean loss differences by counting real words, each text without its own counts."""
    texts = {}
    for i, text, quality, learn in rows:
        old = texts.get(text or "", (0, False))
        texts[text or ""] = (max(old[0], quality or 0), old[1] or bool(learn))
    split = {t: t.lower().split() for t in texts}

    def counts_of(some):
        pairs, words, texts_ = Counter(), Counter(), 0
        for t in some:
            pairs.update(zip([0, *split[t]], [*split[t], 1]))
            words.update([*split[t], 1])
            texts_ += 1
        words[0] = texts_
        return pairs, words

    models = [counts_of(t for t, (good, learn) in texts.items() if learn and good == k)
              for k in (0, 1)]
    totals = [words.total() - words[0] for _, words in models]
    vocabulary = len({w for _, c in models for w, n in c.items() if w != 0 and n}) + 1

    def loss(t, k):
        pairs, words = models[k]
        own = counts_of([t]) if texts[t][1] and texts[t][0] == k else (Counter(), Counter())
        scale = min(totals) / totals[k] if totals[k] else 1.0
        total = totals[k] - (own[1].total() - own[1][0])
        for p, w in zip([0, *split[t]], split[t]):
            single = ((words[w] - own[1][w]) * scale + 1) / (total * scale + vocabulary)
            yield -np.log(((pairs[p, w] - own[0][p, w]) * scale + 2 * single)
                          / ((words[p] - own[1][p]) * scale + 2))

    for i, text, _, _ in rows:
        t = text or ""
        n = len(split[t])
        yield i, n, np.mean(list(loss(t, 1))) - np.mean(list(loss(t, 0))) if n else 0.0


def labelled_rows(seed, n=60):
    numbers = np.random.default_rng(seed)
    rows = [(k, " ".join(f"w{j}" for j in numbers.zipf(1.4, numbers.integers(1, 200)) % 400),
             int(k % 4 == 0), bool(k % 7)) for k in range(n)]
    rows += [(n, rows[0][1], 0, False), (n + 1, rows[1][1], 1, True), (n + 2, "", 1, True),
             (n + 3, None, None, None), (n + 4, "W1 w1\tw2  W1", 0, True), (n + 5, " \n", 0, True)]
    return [*rows, rows[3], rows[3]]


@pytest.mark.parametrize("parts,block", [(4, 16_000_000), (4, 3000), (40, 500)])
def test_language_model_equals_counts_without_own_ones(spark, monkeypatch, parts, block):
    monkeypatch.setattr(op4_language_model, "RANGE_BYTES", 20_000 // parts)
    rows = labelled_rows(parts)
    table = spark.createDataFrame(rows, LABELLED).repartition(3)
    if block < 1_000_000:
        monkeypatch.setattr(op4_language_model, "_blocks", blocks_of(op4_language_model._blocks, block))
    got = op4_language_model.score(table, table.select("doc_id", "quality"), "learn").collect()
    want = sorted(plain_scores(rows))
    got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in got)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)


def blocks_of(split, size):
    """The split with smaller blocks; workers do not see what a test has replaced."""
    def of_batches(batches):
        op4_language_model.BLOCK_BYTES = size
        yield from split(batches)
    return of_batches


def test_language_model_of_odd_tables(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1), (9, 1), (None, 1)], "doc_id long, quality int")
    odd = op4_language_model.score(docs, labels).collect()
    assert len(odd) == docs.count() and all(r["score"] == 0 for r in odd if not r["n_tokens"])
    assert op4_language_model.score(nothing, labels).count() == 0
    for some, learn in ((labels.limit(0), "true"), (labels, "false")):
        scores = op4_language_model.score(docs, some, learn).collect()
        assert len(scores) == len(odd) and all(abs(r["score"]) < 1e-9 for r in scores)


def area_under_curve(scores):
    """Chance that a good text has a lower score than another one."""
    ranked = sorted(scores)
    places = {True: [], False: []}
    for k, (_, good) in enumerate(ranked):
        places[good].append(k)
    good, bad = len(places[True]), len(places[False])
    return 1 - (sum(places[True]) - good * (good - 1) / 2) / (good * bad)


def test_language_model_scores_as_if_it_had_not_seen_a_text(spark, medium):
    """Quality 1 against 0 as registered is as hard as on texts that are not learned from."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    labels = spark.read.parquet(f"{medium}/labels.parquet")

    def area(scores, where="true"):
        rows = scores.join(labels, "doc_id").where(where).select("score", "quality").collect()
        return area_under_curve([(r[0], r[1] == 1) for r in rows])

    everything = area(op4_language_model.score(docs, labels))
    held = area(op4_language_model.score(docs, labels, "doc_id % 5 <> 0"), "doc_id % 5 = 0")
    assert 0.6 < everything < 0.99 and abs(everything - held) < 0.15


def five(text):
    words = text.encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def test_decontamination_equals_brute_force(spark, docs, nothing):
    words = [f"w{k}" for k in range(2000)]
    items = [(1, " ".join(words[100:120])), (2, " ".join(words[500:560])), (3, "a b"), (4, ""),
             (5, None), (6, " ".join(words[900:908])), (None, "no id"), (1, " ".join(words[100:120]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    edited = words.copy()
    edited[118] = "X"
    more = spark.createDataFrame([(200, " ".join(edited)), (201, " ".join(words[:300]).upper()),
                                  (202, " ".join(words[905:1500]))], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(more)
    got = {tuple(r) for r in op5_decontamination.contaminations(table, benchmark).collect()}
    by_doc, by_item = {}, {}
    for i, t in pairs(table):
        by_doc.setdefault(i, set()).update(five(t))
    for i, t in items:
        by_item.setdefault(i, set()).update(five(t or ""))
    want = {(d, i, len(s & q) / len(q)) for d, s in by_doc.items() for i, q in by_item.items()
            if q and len(s & q) >= 0.8 * len(q)}
    assert got == want and len(want) > 4
    assert op5_decontamination.contaminations(nothing, benchmark).count() == 0
    assert op5_decontamination.contaminations(table, benchmark.limit(0)).count() == 0


def test_texts_without_items_stay_whole(spark, docs):
    leak = " ".join(f"leak{j}" for j in range(30))
    rows = [(k, f"{leak if k % 3 else 'fine'} tail {k}", "en", 1, "w", 5) for k in range(12)]
    table = docs.select("doc_id", "text", "lang", "block", F.lit("w").alias("word"), F.lit(5).cast(
        "long").alias("n")).union(spark.createDataFrame(rows, "doc_id long, text string, lang string,"
                                                        "block int, word string, n long"))
    items = spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string")
    kept = op5_decontamination.decontaminated(table, items)
    assert kept.columns == table.columns
    assert listed(kept) == listed(table.where(~F.contains(F.coalesce("text", F.lit("")), F.lit(leak))))
    assert op5_decontamination.decontaminated(table.limit(0), items).count() == 0


def test_filter_grows_with_the_keys():
    assert [op5_decontamination.filter_bits(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 1 << 23, 1 << 40)
            ] == [24, 24, 24, 25, 27, 28]


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for k in range(len(words) - 2) if seen[tuple(words[k:k + 3])] > 1
               for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed)


def test_quality_figures(docs, nothing):
    verdict, _ = op6_line_quality.judged(docs)
    got = verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed")
    assert listed(got) == sorted(((i, *figures(t)) for i, t in pairs(docs)), key=repr)
    assert op6_line_quality.judged(nothing)[0].count() == 0


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    def body(k):
        return "\n".join(" ".join(f"u{k}x{j}y{i}" for i in range(20)) for j in range(4))
    shared = " ".join(f"menu{i}" for i in range(60))
    rows = [(k, f"{body(k)}\n{shared}", "h", 0) for k in range(30)]
    rows += [(100, f"{shared}\n{shared} \nmine", "h", 0), (101, body(101), "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    kept = {r["doc_id"]: r for r in op6_line_quality.cleaned(docs).collect()}
    assert set(kept) == {*range(30), 101}
    assert kept[3]["text"] == body(3) and kept[3]["n_chars"] == len(body(3))


def test_frequent_lines_do_not_depend_on_the_size_of_the_host(spark):
    letters = str.maketrans("0123456789", "abcdefghij")

    def body(k):
        return "\n".join(" ".join(f"u{k}x{j}y{i}" for i in range(20)) for j in range(4)).translate(letters)
    rows = [(k, body(k) + "\nBig banner" * (k < 25) + "\nseen often enough to stay" * (k < 20), "big", 0)
            for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    kept = {r["doc_id"]: r["text"] for r in op6_line_quality.cleaned(docs).collect()}
    assert kept == {i: t.replace("\nBig banner", "") for i, t, _, _ in rows}


def plain_kept(rows):
    """Verdicts by counting lines of different texts of a host."""
    texts, lines_of = {}, {}
    for _, t, source in rows:
        texts.setdefault(source or "", set()).add(t or "")
    plain = lambda x: re.sub("[1-9]", "0", x.strip(" \t\n\x0b\f\r").translate(
        str.maketrans(common.UPPER, common.LOWER)))
    letters = lambda x: len(re.sub("[ \t\n\x0b\f\r]", "", x))
    for host, some in texts.items():
        counts = Counter(x for t in some for x in {plain(x) for x in t.split("\n")})
        lines_of[host] = {x for x, n in counts.items() if letters(x) and (
            n > 20 or len(some) <= 20 and n >= 10 and 2 * n > len(some))}
    for i, t, source in rows:
        t = t or ""
        lost = sum(letters(x) for x in t.split("\n") if plain(x) in lines_of[source or ""])
        yield i, not figures(t)[-1] and 100 * lost <= 80 * letters(t)


def test_verdicts_equal_plain_counts(spark, small):
    draw = np.random.default_rng(12)
    word = lambda: "".join(draw.choice(list("abcdefgh"), 5))
    pool = [" ".join(word() for _ in range(draw.integers(2, 60))) + f" {k % 3}" for k in range(30)]
    rows = []
    for k in range(400):
        own = "\n".join(" ".join(word() for _ in range(draw.integers(1, 25)))
                        for _ in range(draw.integers(1, 6)))
        shared = "\n".join(draw.choice(pool, draw.integers(0, 9)))
        rows.append((k, f"{own}\n{shared}", ["big", "mid", "s1", "s2", "s3", None][
            0 if k % 2 else 1 if k % 3 else 2 + k % 4]))
    rows += [(1000 + k, rows[7][1], "big") for k in range(40)] + [(2000, None, None), (2001, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict, _ = op6_line_quality.judged(docs)
    got = sorted(map(tuple, verdict.select("doc_id", "kept").collect()))
    want = sorted(plain_kept(rows))
    assert got == want and 20 < sum(k for _, k in want) < len(want) - 20
    registered = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    want = sorted(plain_kept([tuple(r) for r in registered.collect()]))
    verdict, _ = op6_line_quality.judged(registered)
    assert sorted(map(tuple, verdict.select("doc_id", "kept").collect())) == want


def test_small_hosts_lose_lines_that_most_of_their_texts_have(spark):
    letters = str.maketrans("0123456789", "abcdefghij")

    def body(k):
        return "\n".join(" ".join(f"u{k}x{j}y{i}" for i in range(20)) for j in range(4)).translate(letters)
    rows = [(100 * h + k, body(100 * h + k) + "\nMenu of the site" * (k < share), f"h{h}", 0)
            for h, (size, share) in enumerate([(12, 10), (20, 10), (9, 9)]) for k in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    kept = {r["doc_id"]: r["text"] for r in op6_line_quality.cleaned(docs).collect()}
    assert len(kept) == len(rows)
    assert {i for i, t in kept.items() if "Menu" in t} == {*range(100, 110), *range(200, 209)}


def test_licenses(docs, nothing):
    got = {r["doc_id"]: r for r in op7_licenses.scan_licenses(docs).collect()}
    row = got[12]
    assert (row["base_labels"], row["labels"]) == ("cc-by-nc,mit", "apache-2,cc-by-nc,mit")
    assert (row["n_base"], row["first_word"], row["last_word"]) == (2, 1, 13)
    assert {s["label"] for s in row["spans"]} >= {"mit", "apache-2"}
    assert got[13]["labels"] == "gpl-3"
    for i, t in pairs(docs):
        if i is not None:
            lowered = re.sub("[A-Z]", lambda m: m.group().lower(), t)
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
            assert got[i]["n_words"] == len(words)
    assert op7_licenses.scan_licenses(nothing).count() == 0


def edited(draw, text, edits):
    """The text with so many letters changed, dropped or added, numbers left as they are."""
    letters = list(text)
    for _ in range(edits):
        at = int(draw.choice([k for k, c in enumerate(letters) if len(c) == 1 and c.isalpha()]))
        letters[at] = draw.choice(["", "q", letters[at] + "x"])
    return "".join(letters)


def test_all_fuzzy_finds_and_base_places(spark):
    """Labels are those of searching every notice in the whole text, without seeds; places are
    those of comparing words."""
    draw = np.random.default_rng(21)
    given = list(op7_licenses.NOTICES.items())
    filler = "this work is under the public license of and mit cc by nc version software free".split()
    texts = []
    for k in range(150):
        notice, _ = given[k % len(given)]
        allowed = len(notice.replace(" ", "")) // op7_licenses.LETTERS_PER_EDIT
        parts = [" ".join(draw.choice(filler, draw.integers(0, 12))),
                 edited(draw, notice, int(draw.integers(0, allowed + 3))),
                 " ".join(draw.choice(filler, draw.integers(0, 12)))]
        if k % 3 == 0:
            parts.append(edited(draw, given[int(draw.integers(len(given)))][0], 1))
        texts.append(draw.choice([" ", ", ", "-\n"]).join(parts).title() if k % 2 else " ".join(parts))
    texts += ["under the mit license " * 5 + "Apache License, Version 2.0", "cc-by-nc under the MIT license",
              ("x " * 600_000) + "released under teh mit license " + "y" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op7_licenses.scan_licenses(docs).collect()}
    notices, _ = op7_licenses.notices(tuple(given))
    for i, text in enumerate(texts):
        words = text.encode().translate(op7_licenses.WORDS_ONLY).split()
        joined = b" %b " % b" ".join(words)
        places, base = [], set()
        for phrase, label in op7_licenses.PHRASES.items():
            p = phrase.encode().split()
            at = [k for k in range(len(words)) if words[k:k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        row = got[i]
        assert (row["n_base"], row["first_word"], row["last_word"]) == (
            len(places), min(places, default=None), max(places, default=None))
        assert row["base_labels"] == ",".join(sorted(base))
        if len(text) < 10_000:
            found = {n.label for n, pattern in notices
                     if (m := pattern.search(joined)) and sum(m.fuzzy_counts) <= n.edits}
            assert row["labels"] == ",".join(sorted(base | found)), (i, text)
    assert got[152]["labels"] == "mit" and got[152]["spans"][0]["first_word"] == 600_000
    assert sum(bool(r["labels"]) for r in got.values()) > 100


def test_hilbert_neighbours_and_even_shards(docs, nothing):
    points = np.array(list(itertools.product(range(8), repeat=3)))
    index = op8_hilbert.hilbert_index(points, 3)
    assert sorted(index) == list(range(512))
    steps = np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1)
    assert set(steps) == {1}
    got = op8_hilbert.hilbert_shards(docs, 6).collect()
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(
        repr((i, len(t.encode()) + 16, zlib.crc32(t.encode()))) for i, t in pairs(docs))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(6))
    assert op8_hilbert.hilbert_shards(nothing).count() == 0


def test_shards_follow_the_curve(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(op8_hilbert.hilbert_shards(docs, 7).collect(), key=lambda r: (r["shard"], r["slot"]))
    cells = [r["cell"] for r in got]
    assert cells == sorted(cells) and len(set(cells)) > 100
    by_id = {r["doc_id"]: r for r in docs.collect()}
    low, high = min(by_id), max(by_id)
    places = {r["doc_id"]: r for r in docs.select(
        "doc_id", op8_hilbert.place_of(F.col("source")).alias("s"),
        op8_hilbert.place_of(F.col("lang")).alias("l")).collect()}
    raw = {r["doc_id"]: [places[r["doc_id"]]["s"], places[r["doc_id"]]["l"],
                         min(255, int(16 * (np.log2(r["size"]) - 4))),
                         min(255, (r["doc_id"] - low) * 256 // (high - low + 1))] for r in got}
    axes = np.array([raw[r["doc_id"]] for r in got])
    stretched = np.array([[int(((a < v).sum() + (a == v).sum() / 2) * 256 / len(a)) for v in a]
                          for a in axes.T]).T
    assert op8_hilbert.hilbert_index(stretched).tolist() == cells


def test_written_shards_are_pruned(spark, medium, docs, tmp_path):
    table = spark.read.parquet(f"{medium}/documents.parquet")
    path = str(tmp_path / "shards")
    op8_hilbert.write_shards(table, path)
    rows = spark.read.parquet(f"{path}/rows")
    assert listed(rows.select(table.columns)) == listed(table)
    places = {(r["doc_id"], r["shard"], r["slot"])
              for r in op8_hilbert.hilbert_shards(table).collect()}
    assert {tuple(r) for r in rows.select("doc_id", "shard", "slot").collect()} == places
    ranges = spark.read.parquet(f"{path}/ranges")
    assert ranges.agg(F.sum("rows")).first()[0] == table.count() and ranges.count() == 40
    source = table.first()["source"]
    filters = {"source": (source, F.col("source") == source), "lang": ("de", F.col("lang") == "de"),
               "size": ((2000, 2300), (F.octet_length("text") + 16).between(2000, 2300)),
               "doc_id": ((100, 160), F.col("doc_id").between(100, 160))}
    for name, (value, condition) in filters.items():
        read = op8_hilbert.shards_to_read(ranges, **{name: value})
        holding = {r[0] for r in rows.where(condition).select("shard").distinct().collect()}
        assert holding <= set(read) and len(read) <= 24, name
    both = op8_hilbert.shards_to_read(ranges, lang="de", doc_id=(100, 160))
    assert len(both) < 20
    odd = str(tmp_path / "odd")
    op8_hilbert.write_shards(docs, odd, 4)
    assert listed(spark.read.parquet(f"{odd}/rows").select(docs.columns)) == listed(docs)


def test_separators_across_blocks(spark, docs, nothing):
    def block(k, *ids):
        return (0, k, bytes(np.array(ids, "<u2")))
    blocks = spark.createDataFrame([block(0, 5, 9, 5), block(1, 5, 5), block(2, 5, 9, 9, 5, 9),
                                    block(3, 7)], "file int, block int, ids binary")
    got = listed(op9_separators.count_tokens(blocks, 9))
    assert got == [(0, 0, 0, 1, True), (0, 1, 2, 4, True), (0, 2, 7, 0, True), (0, 3, 8, 1, True),
                   (0, 4, 10, 1, False)]
    library = op1_bpe.encoding(public_tokenizers.path(op1_bpe.RANKS))
    files, names = op9_separators.write_flat_files(docs)
    counts = names.join(op9_separators.count_tokens(files), ["file", "ordinal"])
    assert listed(counts.select("doc_id", "n_tokens")) == sorted(
        ((i, len(library.encode_ordinary(t))) for i, t in pairs(docs)), key=repr)
    files, _ = op9_separators.write_flat_files(nothing)
    assert op9_separators.count_tokens(files).count() == 0


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[k:k + 3]) for k in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(docs, nothing):
    got = op10_simhash.near_duplicates(docs).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in pairs(docs)]
    root = list(range(len(prints)))
    for _ in root:
        for a, b in itertools.combinations(range(len(root)), 2):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    smallest = {}
    for r, (i, _) in zip(root, prints, strict=True):
        smallest[r] = min(x for x in (smallest.get(r), i, 1 << 60) if x is not None)
    want = [(i, p, smallest[r] if smallest[r] < 1 << 60 else None)
            for r, (i, p) in zip(root, prints, strict=True)]
    assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got), key=repr) == sorted(want, key=repr)
    assert op10_simhash.near_duplicates(nothing).count() == 0


def test_components_of_paths_stars_and_random_links(spark):
    numbers = np.random.default_rng(5)
    shuffled = numbers.permutation(300).tolist()
    links = [(k, k + 1) for k in range(1000, 1300)]  # a path in the order of its nodes
    links += [(2000 + a, 2000 + b) for a, b in itertools.pairwise(shuffled)]
    links += [(3150, 3000 + k) for k in range(300)] + [(4000, 4001), (4001, 4000), (4000, 4001)]
    links += [(5000 + a, 5000 + b) for a, b in numbers.integers(0, 400, (250, 2)).tolist()]
    root = {n: n for link in links for n in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(common.components(spark.createDataFrame(links, "a long, b long"), "test").collect())
    assert set(got) == {n for a, b in links if a != b for n in (a, b)}
    # one root for each brute-force class and one class for each root
    classes = {(r, root[n]) for n, r in got.items()}
    assert len(classes) == len({r for r, _ in classes}) == len({r for _, r in classes})
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_covering_masks_and_links(spark):
    masks = op10_simhash.covering_masks()
    for pair in itertools.combinations(range(64), 2):
        assert any(not any(m >> i & 1 for i in pair) for m in masks)
    numbers = np.random.default_rng(3)
    base = numbers.integers(0, 1 << 63, 5, dtype=np.uint64).tolist()
    prints = {b ^ sum(1 << int(i) for i in numbers.choice(64, k, replace=False))
              for b in base for k in (0, 1, 2, 3, 4) for _ in range(12)}
    signed = [(0, op10_simhash._signed(p)) for p in prints]
    found = op10_simhash.links(spark.createDataFrame(
        [(*s, s[1]) for s in signed], "view int, fp long, node long")).collect()
    root = {p: p for _, p in signed}

    def merge(links):
        roots = dict(root)
        for _ in roots:
            for a, b in links:
                roots[a] = roots[b] = min(roots[a], roots[b])
        return roots

    near = [(a, b) for a, b in itertools.combinations(root, 2)
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert merge([(r["a"], r["b"]) for r in found]) == merge(near)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in found)


def test_deduplication_keeps_one_of_each_component(docs, nothing):
    body = [f"{' '.join(f'own{k}w{j}' for j in range(90))}" for k in range(5)]
    more = [(500 + k, body[k % 5], "en", "s", 0, 1, "x") for k in range(15)]
    more += [(None, body[0], "en", "s", 0, 1, "x"), (None, "alone text", "en", "s", 0, 1, "x"),
             (None, "alone text", "en", "s", 0, 1, "x")]
    table = docs.union(docs.sparkSession.createDataFrame(more, SCHEMA)).repartition(5)
    kept = op10_simhash.deduplicated(table)
    assert kept.columns == table.columns
    components = {(r["doc_id"], r["fp"]): r["component_id"]
                  for r in op10_simhash.near_duplicates(table).collect()}
    want = sorted({c for c in components.values() if c is not None})
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == want
    assert sorted(r["text"] for r in rows if r["doc_id"] is None) == ["alone text", "no id"]
    assert {500, 501, 502, 503, 504} <= set(want) and not set(range(505, 515)) & set(want)
    assert op10_simhash.deduplicated(nothing).count() == 0


def test_one_of_each_component_of_registered_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = op10_simhash.near_duplicates(docs).select("component_id").distinct().collect()
    kept = op10_simhash.deduplicated(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in found)
    assert kept.exceptAll(docs).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    folder = str(tmp_path)
    body = [" ".join(f"q{k}z{j}" for j in range(80)) for k in range(4)]
    leak = " ".join(f"leak{j}" for j in range(30))
    rows = [(300 + k, b, "en", "s", 0, 1, "x") for k, b in enumerate(body)]
    rows += [(310, body[0], "en", "s", 0, 1, "x"), (311, f"{body[1]} {leak}", "en", "s", 0, 1, "x"),
             (312, f"{body[2]} mail me@you.org now", "en", "s", 0, 1, "x"),
             (313, body[3].upper() + "\n", "en", "s", 0, 1, "x")]
    docs.union(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {300, 301, 303} <= set(got) and not {310, 311, 313} & set(got)
    two = [int.from_bytes(op10_simhash.fingerprint(r[1].encode(), 3)) for r in (rows[2], rows[6])]
    far = (two[0] ^ two[1]).bit_count() > 2
    assert 302 in got and (312 in got) == far and 3 not in got and 0 in got
    text = op1_bpe.encoding(public_tokenizers.path(op1_bpe.RANKS)).decode(got[300]["ids"])
    assert text == body[0]
    assert hashlib.sha256(text.encode()).hexdigest()
