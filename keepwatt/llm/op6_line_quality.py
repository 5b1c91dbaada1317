"""Quality of documents from rules on each text and from lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.llm.common import LOWER, UPPER, read_documents, whole_text
from keepwatt.session import stage

SPACES = " \t\n\x0b\f\r"
RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEATED_PERCENT = 50
LINE_TEXTS = 20         # a line in more of a host's distinct texts is removed, however many it has
LINE_PERCENT = 50       # and, in a host of no more texts than that, in more than this share
SMALL_TEXTS = 10        # and in so many at least
DEPLETED_PERCENT = 80   # a document that loses more than this share of its letters is rejected


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def normalised_lines(text: Column) -> Column:
    """Lines without blanks at their ends, A-Z lowered, every digit a zero."""
    return F.split(F.translate(text, UPPER + "123456789", LOWER + 9 * "0"), "\n")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def text_key() -> Column:
    """What stands for a text: two hashes of different kind, 96 bits together."""
    return F.struct(F.xxhash64("text").alias("x"), F.hash("text").alias("m"))


def _repeated_words(docs: DataFrame) -> DataFrame:
    """n_repeat_words: words covered by runs of three words that occur twice or more.

    Each run is the 64-bit hash of its words and its place. Sorted, equal runs are neighbours,
    and their places tell which words they cover.
    """
    n = F.size("words")
    ends = F.arrays_zip("words", F.slice("words", 2, F.greatest(n, F.lit(1))).alias("second"),
                        F.slice("words", 3, F.greatest(n, F.lit(1))).alias("third"))
    runs = docs.select("*", F.when(n >= 3, F.slice(ends, 1, n - 2)).otherwise(
        F.slice(ends, 1, 0)).alias("runs"))
    numbered = runs.select("*", F.sort_array(F.transform("runs", lambda r, k: F.struct(
        F.xxhash64(r["words"], r["second"], r["third"]).alias("run"), k.alias("at")))
    ).alias("sorted")).drop("runs")
    beside = F.arrays_zip("sorted", F.slice("sorted", 2, F.greatest(
        F.size("sorted"), F.lit(1))).alias("next"))
    equal = numbered.select("*", F.filter(beside, lambda z: F.coalesce(
        z["sorted"]["run"] == z["next"]["run"], F.lit(False))).alias("equal")).drop("sorted")
    at = equal.select("*", F.array_union(F.transform("equal", lambda z: z["sorted"]["at"]),
                                         F.transform("equal", lambda z: z["next"]["at"])).alias("at"))
    covered = F.array_union(F.array_union("at", F.transform("at", lambda p: p + 1)),
                            F.transform("at", lambda p: p + 2))
    return at.withColumn("n_repeat_words", F.size(covered).cast("long")).drop(
        "equal", "at", "words")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, text key, the figures of the rules, and the lines' hashes and letters."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
                        whole_text().alias("text"))
    trimmed = given.withColumn("trimmed", F.btrim("text", F.lit(SPACES)))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(
        F.split("trimmed", RUN))
    with_words = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    split = trimmed.select("*", words.alias("words"), with_words.alias("full")).drop("trimmed")
    figures = split.select(
        "doc_id", "host", text_key().alias("key"), "words", F.size("words").cast("long")
        .alias("n_words"),
        F.length(without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long")
        .alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.filter(F.transform(normalised_lines(F.col("text")), lambda x: F.struct(
            line_hash(x).alias("line"), F.length(without(x, SPACES)).alias("letters"))),
            lambda x: x["letters"] > 0).alias("lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return _repeated_words(figures).withColumn("base_failed", failed)


def judged(docs: DataFrame, texts: int = LINE_TEXTS,
           depleted_percent: int = DEPLETED_PERCENT) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs`` with figures and verdict, and the frequent lines of texts.

    Hosts are sources. A line is frequent on a host if more than ``texts`` different texts have
    it, however large the host; if the host itself has no more texts than that, more than half of
    them, ten at least. Exact copies count once, otherwise a document would lose all its lines to its own copies. A document is rejected
    by the rules, or if its frequent lines hold more than ``depleted_percent`` of its letters.
    Missing texts are empty, missing sources one host; repeated rows stay and share a verdict. The second table is (host, key, frequent): the
    hashes of the frequent lines of each text that has some.
    """
    rows = stage(measured(docs), "quality-figures")
    distinct = stage(rows.select("host", "key", "lines").dropDuplicates(["host", "key"]),
                     "quality-texts")
    counts = (distinct.select("host", F.explode(F.array_distinct(F.col("lines.line")))
                              .alias("line"))
              .groupBy("host", "line").agg(F.count("*").alias("n"))
              .where(F.col("n") >= min(SMALL_TEXTS, texts)))
    hosts = distinct.groupBy("host").agg(F.count("*").alias("of_host"))
    often = (F.col("n") > texts) | ((F.col("n") >= SMALL_TEXTS) & (F.col("of_host") <= texts) & (
        100 * F.col("n") > LINE_PERCENT * F.col("of_host")))
    frequent = stage(counts.join(hosts, "host").where(often).select("host", "line"),
                     "quality-lines")
    lost = (distinct.select("host", "key", F.explode("lines").alias("l"))
            .select("host", "key", "l.line", "l.letters")
            .join(frequent, ["host", "line"]).groupBy("host", "key")
            .agg(F.sum("letters").alias("lost"), F.collect_set("line").alias("frequent")))
    lost = stage(lost, "quality-lost")
    enough = 100 * F.coalesce("lost", F.lit(0)) <= depleted_percent * F.col("word_chars")
    verdict = rows.drop("lines").join(lost.drop("frequent"), ["host", "key"], "left").withColumn(
        "kept", ~F.col("base_failed") & enough)
    return verdict, lost.select("host", "key", "frequent")


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; frequent lines leave their texts."""
    verdict, frequent = judged(docs)
    changes = verdict.groupBy("host", "key").agg(F.bool_and("kept").alias("kept")).join(
        frequent, ["host", "key"], "left").where("not kept or frequent is not null")
    changes = stage(changes, "quality-changes")
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        whole_text().alias("text")).select("row", "host", text_key().alias("key"))
    # the changes grow with the corpus, so they are never broadcast
    kept = keyed.join(changes.hint("merge"), ["host", "key"], "left").where(
        F.coalesce("kept", F.lit(True)))
    text = F.col("row.text")
    lines = F.arrays_zip(F.split(text, "\n").alias("raw"),
                         normalised_lines(text).alias("plain"))
    rest = F.array_join(F.transform(
        F.filter(lines, lambda z: ~F.array_contains("frequent", line_hash(z["plain"]))),
        lambda z: z["raw"]), "\n")
    new_text = F.when(F.col("frequent").isNull(), text).otherwise(rest)
    out = {c: F.col(f"row.`{c}`") for c in names} | {"text": new_text}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("frequent").isNull(), F.col("row.n_chars")).otherwise(
            F.length(new_text)).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[out[c].alias(c) for c in names])


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict, _ = judged(read_documents(spark, sf_dir))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                          "n_repeat_words", "base_failed", "kept")
