"""Language identification: a byte convolutional network over fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwatt.llm.common import read_documents, whole_text

WINDOW = 128               # bytes
WIDTHS = (2, 3, 4)         # bytes that a filter sees
FILTERS = 24               # of each width
SAMPLE_TEXTS = 8000        # labelled texts to learn from, over all languages: the bound of the fit
SAMPLE_WINDOWS = 6         # of a text, spread over all of it
EPOCHS, BATCH, RATE, DECAY = 4, 128, 0.01, 1e-4
CHUNK = 128                # windows whose convolutions are held at once
BATCH_BYTES = 4_000_000    # of texts whose windows are scored together
UNKNOWN = "und"
HAS_LETTER = r"\p{L}"

# Bytes as symbols: 0 fills windows up, 1 is any ASCII byte but a letter, case is ignored,
# bytes of other characters stand for themselves.
SYMBOLS = 2 + 26 + 128
SYMBOL = np.ones(256, np.uint8)
SYMBOL[ord("a"):ord("z") + 1] = SYMBOL[ord("A"):ord("Z") + 1] = np.arange(2, 28)
SYMBOL[128:] = np.arange(28, SYMBOLS)


def windows_of(text: bytes) -> np.ndarray:
    """All bytes of a text as symbols, in rows of one window; the last row is filled up."""
    rows = np.zeros(max(-(-len(text) // WINDOW), 1) * WINDOW, np.uint8)
    rows[:len(text)] = SYMBOL[np.frombuffer(text, np.uint8)]
    return rows.reshape(-1, WINDOW)


@dataclass
class ByteNetwork:
    """Filters over one-hot symbols, the largest response of each over a window, softmax.

    ``filters[w]`` has the shape (width, symbols, filters); the response to a symbol at an offset
    is a row of it, so a convolution is a sum of looked-up rows.
    """

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, languages: list[str], seed: int = 11) -> ByteNetwork:
        draw = np.random.default_rng(seed)
        return cls(languages,
                   [draw.normal(0, width ** -0.5, (width, SYMBOLS, FILTERS)).astype(np.float32)
                    for width in WIDTHS],
                   np.zeros(len(WIDTHS) * FILTERS, np.float32),
                   draw.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
                   np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.weights, self.offset]

    def responses(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Per width (positions, windows, filters) for windows given as rows."""
        symbols = np.ascontiguousarray(rows.T)
        for table in self.filters:
            places = WINDOW - len(table) + 1
            total = table[0].take(symbols[:places], axis=0)
            for k in range(1, len(table)):
                total += table[k].take(symbols[k:k + places], axis=0)
            yield total

    def largest(self, rows: np.ndarray) -> np.ndarray:
        """The pooled responses, before the bias."""
        return np.concatenate([r.max(axis=0) for r in self.responses(rows)], axis=1)

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        scores = np.maximum(pooled + self.bias, 0) @ self.weights + self.offset
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((0, len(self.languages)), np.float32), *[
            self.softmax(self.largest(rows[k:k + CHUNK])) for k in range(0, len(rows), CHUNK)]])

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy. Only the place of the largest response passes it on."""
        places, pooled = [], []
        for response in self.responses(rows):
            at = response.argmax(axis=0)
            places.append(at)
            pooled.append(np.take_along_axis(response, at[None], axis=0)[0])
        pooled = np.concatenate(pooled, axis=1)
        wrong = self.softmax(pooled)
        wrong[np.arange(len(rows)), labels] -= 1
        wrong /= len(rows)
        active = np.maximum(pooled + self.bias, 0)
        back = (wrong @ self.weights.T) * (active > 0)
        symbols, filters = rows.T, np.arange(FILTERS)
        of_filters = []
        for w, at in enumerate(places):
            own = back[:, w * FILTERS:(w + 1) * FILTERS].ravel()
            of_filters.append(np.stack([
                np.bincount((symbols[at + k, np.arange(len(rows))[:, None]].astype(np.int64)
                             * FILTERS + filters).ravel(), own, SYMBOLS * FILTERS)
                .reshape(SYMBOLS, FILTERS) for k in range(WIDTHS[w])]).astype(np.float32))
        return [*of_filters, back.sum(axis=0), active.T @ wrong, wrong.sum(axis=0)]


def trained(rows: np.ndarray, labels: np.ndarray, languages: list[str],
            seed: int = 11) -> ByteNetwork:
    """A network fitted by Adam on windows and the numbers of their languages. Languages count
    equally, however many windows they have: each batch draws as many of each."""
    network, draw = ByteNetwork.start(languages, seed), np.random.default_rng(seed)
    own = [np.flatnonzero(labels == k) for k in range(len(languages))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in network.parameters()]
    steps = EPOCHS * max(len(rows) // BATCH, 20)
    for step in range(1, steps + 1):
        language = draw.integers(len(languages), size=BATCH)
        picked = np.array([own[k][draw.integers(len(own[k]))] for k in language])
        rate = RATE * (1 - (step - 1) / steps)
        for value, slope, moment in zip(network.parameters(),
                                        network.gradients(rows[picked], labels[picked]), moments,
                                        strict=True):
            slope = slope + DECAY * value
            moment[0] += 0.1 * (slope - moment[0])
            moment[1] += 0.001 * (slope * slope - moment[1])
            value -= rate * (moment[0] / (1 - 0.9 ** step)) / (
                np.sqrt(moment[1] / (1 - 0.999 ** step)) + 1e-8)
    return network


def labelled_windows(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, label: str = "lang",
                     ) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample of labelled texts with letters, their labels' numbers, and
    the labels. Each language has the same share of about ``sample_texts``, drawn by a hash of
    the text, or all its texts if they are fewer. At most ``sample_texts`` different labels and
    twice that many texts ever leave Spark."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").rlike(HAS_LETTER)).select(
        F.col(label).cast("string").alias("label"), "text")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).orderBy("label").limit(sample_texts).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = sample_texts / len(counts)
    rates = F.create_map(*[F.lit(x) for label, n in counts.items()
                           for x in (label, min(1.0, share / n))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(drawn < F.element_at(rates, F.col("label")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, windows = [], []
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                rows = windows_of(text.as_py())
                rows = rows[(rows > 1).any(axis=1)]
                at = np.unique(np.linspace(0, len(rows) - 1, SAMPLE_WINDOWS).astype(int))
                windows += [row.tobytes() for row in rows[at]]
                labels += [name.as_py()] * len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.string()), pa.array(windows, pa.binary())],
                ["label", "window"])

    found = sample.select("label", F.col("text").cast("binary")).mapInArrow(
        spread, "label string, window binary").limit(
            2 * sample_texts * SAMPLE_WINDOWS).orderBy("label", "window").collect()
    languages = sorted({r["label"] for r in found})
    number = {name: k for k, name in enumerate(languages)}
    rows = np.frombuffer(b"".join(bytes(r["window"]) for r in found), np.uint8)
    return (rows.reshape(-1, WINDOW), np.array([number[r["label"]] for r in found], np.int64),
            languages)


def fit(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, label: str = "lang",
        seed: int = 11) -> ByteNetwork | None:
    """A network for the labels of ``docs`` (text and the label), None without labelled text."""
    rows, labels, languages = labelled_windows(docs, sample_texts, label)
    return trained(rows, labels, languages, seed) if languages else None


def identify(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of ``docs``, from the text alone.

    All windows of a text are scored; the score of a language is the mean of its probabilities
    over the windows, weighted by their letters, and the first of equal ones is taken. A missing
    text and one without a letter are ``und`` with score 0, as is everything without a network.
    Repeated rows and missing doc_ids stay; other columns are not read.
    """
    def scored(texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The names and scores of texts with letters."""
        rows = [windows_of(text) for text in texts]
        cuts = np.cumsum([0, *map(len, rows)])[:-1]
        rows = np.concatenate(rows)
        weight = (rows > 1).sum(axis=1)
        sums = np.add.reduceat(network.probabilities(rows) * weight[:, None], cuts, axis=0)
        means = sums / np.add.reduceat(weight, cuts)[:, None]
        return ([network.languages[k] for k in means.argmax(axis=1)],
                np.minimum(means.max(axis=1), 1.0).tolist())

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            places, texts, size = [], [], 0
            letters = batch.column(2).to_pylist() if network else []
            last = max((k for k, has in enumerate(letters) if has), default=-1)
            for k, has in enumerate(letters):
                if has:
                    places.append(k)
                    texts.append(batch.column(1)[k].as_py())
                    size += len(texts[-1])
                if texts and (size >= BATCH_BYTES or k == last):
                    for place, name, score in zip(places, *scored(texts), strict=True):
                        names[place], scores[place] = name, score
                    places, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"),
                        whole_text().rlike(HAS_LETTER).alias("letters"))
    return given.mapInArrow(of_batches, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: its checksum leaves 2 when divided by 4.
    A missing doc_id is not held out, and gives nothing to learn either."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op11_language(spark, sf_dir):
    """Languages of all documents by a network that has not seen those held out."""
    docs = read_documents(spark, sf_dir)
    network = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, network).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred", "score")
