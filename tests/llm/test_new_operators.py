"""Languages, periodic runs and spelling variants against brute force on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwatt.llm import op11_language, op12_periodic_runs, op13_spelling_groups

SCHEMA = "doc_id long, text string, lang string, block int, word string, n long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(5)
    texts = ["", None, " \n\t ", "a", "x " * 40, "one two three " * 30, "123 .. 456",
             "é́ ß x y \x1f\x0b z \xa0 日本語 😀", " ".join("abc"[k % 3] for k in range(500))]
    for k in range(60):
        words = [draw.choice("the of and house water light tree".split())
                 for _ in range(draw.randrange(3, 90))]
        at = draw.randrange(len(words))
        texts.append(" ".join(words[:at] + words[at:at + 4] * draw.randrange(1, 9) + words[at:]))
    rows = [(k, t, "en" if k % 2 else "de", 1, "w", 5) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id " * 9, None, None, None, None),
             (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_runs(words, least=12):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at < len(words) - period:
            start = at
            while at < len(words) - period and words[at] == words[at + period]:
                at += 1
            if at > start and at + period - start >= max(least, 2 * period):
                found.setdefault((start, at + period), period)
            at += at == start
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORDS.findall(text or "")
    if doc_id is not None and words:
        checksum, n = zlib.crc32(str(doc_id).encode()), len(words)
        if checksum % 10 == 0:
            a = checksum // 10 % n
            p = 1 + (n - a) // (3 + checksum // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = max(((length, -s, -p) for s, length, p in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(
        (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else [None] * 4),
        sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)),
        sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def listed(rows):
    return sorted(map(tuple, rows), key=repr)


def test_runs_equal_plain_search(docs, monkeypatch):
    monkeypatch.setattr(op12_periodic_runs, "read_documents", lambda spark, sf_dir: docs)
    got = op12_periodic_runs.op12_periodic_runs(docs.sparkSession, "")
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert any(w[1] for w in want) and listed(got.collect()) == listed(want)


def test_runs_of_registered_query(spark, small):
    got = op12_periodic_runs.op12_periodic_runs(spark, small).collect()
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    few = {d for d, t in texts if len(t or "") < 6000}
    assert len(got) == len(texts)
    assert listed(r for r in got if r["doc_id"] in few) == listed(
        plain_row(d, t) for d, t in texts if d in few)


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_runs_of_random_words(letters):
    draw = random.Random(letters)
    for _ in range(300):
        least, texts = draw.choice([2, 4, 12]), []
        for _ in range(draw.randrange(1, 4)):
            n = draw.randrange(100)
            words = [draw.randrange(letters) for _ in range(n)]
            at, period = draw.randrange(n + 1), draw.randrange(1, n + 2)
            texts.append([w if k < at else words[at + (k - at) % min(period, n - at)]
                          for k, w in enumerate(words)])
        ends = np.cumsum([len(t) for t in texts])
        got = op12_periodic_runs.runs_of(np.array(sum(texts, []), np.int64), ends, least)
        want = [(s + end - len(t), s + length + end - len(t), p)
                for t, end in zip(texts, ends) for s, length, p in plain_runs(t, least)]
        assert got.tolist() == [list(w) for w in want]


def test_runs_of_long_and_self_similar_words():
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 1200:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for words in (fibonacci[1][:1200], [0] * 1200, [k % 333 for k in range(1200)],
                  [k % 7 for k in range(700)] + [k % 5 for k in range(500)]):
        got = op12_periodic_runs.runs_of(np.array(words), np.array([len(words)]), 12)
        assert [(s, e - s, p) for s, e, p in got.tolist()] == plain_runs(words)
    million = op12_periodic_runs.runs_of(np.zeros(1_000_000, np.int64), np.array([1_000_000]))
    assert million.tolist() == [[0, 1_000_000, 1]]


def plain_vocabulary(rows):
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_groups(counts):
    meet, near, form = defaultdict(set), defaultdict(set), {}
    for w in counts:
        for k in range(len(w)):
            meet[w[:k], w[k + 1:]].add(w)
            if (shorter := w[:k] + w[k + 1:]) in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for some in meet.values():
        for w in some:
            near[w] |= some - {w}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))


def test_spelling_groups_of_documents_equal_plain_search(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = listed(plain_groups(plain_vocabulary(docs)))
    got = listed(op13_spelling_groups.op13_spelling_groups(spark, small).collect())
    assert got == want and any(w[2] != w[1] for w in want if w[1])


@pytest.mark.parametrize("index_words", [64, 4096])
def test_spelling_groups_of_crowded_keys(spark, monkeypatch, index_words):
    monkeypatch.setattr(op13_spelling_groups, "INDEX_WORDS", index_words)
    draw = random.Random(3)
    counts = {"prefix" + "".join(draw.choice("abé") for _ in range(draw.randrange(4, 8))):
              draw.randrange(1, 40) for _ in range(900)}
    counts |= {"a" * 300: 4, "a" * 301: 8, "a" * 150 + "b" + "a" * 150: 16, "x": 2, "y": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn(
        "near", F.lit("other"))
    got = op13_spelling_groups.spelling_groups(words)
    assert listed(got.collect()) == listed(plain_groups(counts))


def test_vocabulary_of_odd_texts(docs):
    got = op13_spelling_groups.vocabulary(docs, op13_spelling_groups.with_planted_slip())
    assert dict(got.collect()) == plain_vocabulary(
        (r["doc_id"], r["text"]) for r in docs.collect())


def test_empty_tables(docs):
    nothing = docs.limit(0)
    assert op12_periodic_runs.periodic_runs(nothing).count() == 0
    assert op13_spelling_groups.spelling_groups(
        op13_spelling_groups.vocabulary(nothing)).count() == 0
    assert op11_language.fit(nothing) is None
    assert op11_language.identify(nothing, None).count() == 0
    unknown = op11_language.identify(docs, None).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
    assert len(unknown) == docs.count()


def test_languages_of_held_out_documents(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = op11_language.op11_language(spark, medium).join(docs.select("doc_id", "lang"), "doc_id")
    kept = [r for r in got.collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in kept)
    assert len(kept) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in kept) >= 0.97 * len(kept)


def test_language_of_odd_texts(docs):
    network = op11_language.fit(docs.where("doc_id IS NOT NULL"), sample_texts=40)
    rows = op11_language.identify(docs, network).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (0, 1, 2, 6))
    assert {r["lang_pred"] for r in rows} <= {"und", "de", "en"}
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_network_gradients_and_batches():
    draw = np.random.default_rng(2)
    network = op11_language.ByteNetwork.start(["a", "b", "c"])
    rows = draw.integers(0, op11_language.SYMBOLS, (5, op11_language.WINDOW)).astype(np.uint8)
    labels = np.array([0, 1, 2, 1, 0])

    def loss():
        return -np.log(network.probabilities(rows)[np.arange(5), labels]).mean()

    slopes = network.gradients(rows, labels)
    for value, slope in zip(network.parameters(), slopes):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        before = value[at]
        value[at] = before + 1e-2
        high = loss()
        value[at] = before - 1e-2
        low = loss()
        value[at] = before
        assert abs((high - low) / 2e-2 - slope[at]) < 0.2 * abs(slope[at]) + 1e-3
    text = ("Der " * 2000).encode()
    assert op11_language.windows_of(text).shape == (63, op11_language.WINDOW)
    whole = network.probabilities(op11_language.windows_of(text))
    one = np.concatenate([network.probabilities(r[None]) for r in op11_language.windows_of(text)])
    assert np.allclose(whole, one, atol=1e-5)
