"""Personal data: fixed shapes, and identifiers found by the contexts those shapes stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.llm.common import read_documents, whole_text
from keepwatt.session import stage

KINDS = ("email", "ip", "card", "phone", "id")  # id: found by context
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
         r"(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# Runs of digits with single blanks or hyphens between them, those of 13 to 19 digits only.
CARD = (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}"
        r"(?![\x20-]?[0-9])")
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Letters, digits and inner marks with a digit among them, not part of anything longer.
SHAPE = (r"(?<![\p{L}0-9._@+-])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]{5,}[A-Za-z0-9]"
         r"(?![._@+-]*+[\p{L}0-9])")
WORD = r"(?<![\p{L}_])[\p{L}_]++"
JOINT = r"[^\p{L}0-9_]"
# Patterns: the last word, the last two words and the next word, with only marks between.
LEFT = rf"({WORD}){JOINT}*+$"
LEFT_TWO = rf"({WORD}{JOINT}++[\p{{L}}_]++){JOINT}*+$"
RIGHT = rf"^{JOINT}*+([\p{{L}}_]++)"
CONFIDENT = 0.8  # share of a pattern's places in the corpus that known identifiers stand at
SUPPORT = 3      # different known identifiers that a pattern has to have
SPAN = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"


def found(text: Column, pattern: str, wanted) -> Column:
    """Spans (start, end in code points, hit, and the text from the match before to the match
    after it) of the matches for which ``wanted(hit)`` holds.

    The text is cut at the matches; the lengths of the pieces up to one give its place.
    """
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(gaps.alias("gap"),
                          F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"),
                          F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))
    empty = F.array().cast(SPAN)
    begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("hit"),
                        piece["gap"].alias("left"), piece["after"].alias("right"))
        keep = piece["hit"].isNotNull() & wanted(piece["hit"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(pieces, begin, step, lambda acc: acc["spans"])
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(empty)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each fixed kind; a cheap test spares most texts the search."""
    empty = F.array().cast(SPAN)
    rules = {
        "email": (F.contains(text, F.lit("@")), EMAIL, lambda h: F.lit(True)),
        "ip": (F.contains(text, F.lit(".")), IP,
               lambda h: F.regexp_like(h, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))),
        "card": (F.lit(True), CARD, lambda h: F.call_function("luhn_check", digits_of(h))),
        "phone": (F.contains(text, F.lit("+")), PHONE,
                  lambda h: F.length(digits_of(h)).between(9, 15)),
    }
    return {kind: F.when(test, found(text, pattern, wanted)).otherwise(empty)
            for kind, (test, pattern, wanted) in rules.items()}


def patterns_around(span: Column) -> Column:
    """The patterns that a span stands in: 'l word', 'l word word' and 'r word'."""
    left, right = F.lower(span["left"]), F.lower(span["right"])
    two = F.regexp_replace(F.regexp_extract(left, LEFT_TWO, 1), rf"{JOINT}+", " ")
    sides = [("l ", F.regexp_extract(left, LEFT, 1)), ("l ", two),
             ("r ", F.regexp_extract(right, RIGHT, 1))]
    return F.filter(F.array(*[F.when(word != "", F.concat(F.lit(side), word))
                              for side, word in sides]), lambda p: p.isNotNull())


def text_key() -> Column:
    """What stands for a text: two hashes of different kind, 96 bits together."""
    return F.struct(F.xxhash64("text").alias("x"), F.hash("text").alias("m"))


def _of_kind(number: int, spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _count(number: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text key, base spans, and seen: everything of an identifier's shape with the
    patterns it stands in; known tells those that are base spans."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        whole_text().alias("text"))
    text = F.col("text")
    kinds = given.select("doc_id", "text", *[s.alias(k) for k, s in base_spans(text).items()],
                         found(text, SHAPE, lambda h: F.lit(True)).alias("shaped"))
    based = kinds.withColumn("base", F.concat(*[
        _of_kind(n, kind) for n, kind in enumerate(KINDS[:-1])]))

    def seen(spans: str, known: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.xxhash64(F.lower(s["hit"])).alias("what"), patterns_around(s).alias("patterns"),
            F.lit(known).alias("known")))

    apart = F.filter("shaped", lambda s: ~F.exists("base", lambda b: (
        s["start"] < b["end"]) & (b["start"] < s["end"])))
    both = based.withColumn("apart", apart)
    return both.select("doc_id", text_key().alias("key"), "base", F.concat(
        *[seen(k, True) for k in KINDS[:-1]], seen("apart", False)).alias("seen"))


def _word_key(words: Column) -> Column:
    """What stands for a word, or for two words in a row, where places are counted."""
    hashes = F.transform(F.split(words, " "), lambda w: F.xxhash64(w))
    return F.when(F.size(hashes) == 1, F.element_at(hashes, 1)).otherwise(
        F.xxhash64(F.element_at(hashes, 1), F.element_at(hashes, 2)))


def places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, places): how often the words of each of ``patterns`` stand in all texts."""
    asked = patterns.select("pattern", _word_key(F.substring("pattern", F.lit(3), F.length(
        "pattern"))).alias("word"))
    words = F.transform(F.regexp_extract_all(F.lower(whole_text()), F.lit(r"[\p{L}_]+"), 0),
                        lambda w: F.xxhash64(w))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))),
                       F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.xxhash64(a, b))
    every = docs.select(words.alias("w")).select(F.explode(F.concat("w", pairs)).alias("word"))
    counts = every.join(asked.select("word").distinct(), "word").groupBy("word").agg(
        F.count(F.lit(1)).alias("places"))
    return asked.join(counts, "word").select("pattern", "places")


def scored_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, places, taken, support): for patterns with enough different known identifiers,
    the places that these take of all."""
    return edges.join(known, "what").groupBy("pattern", "places").agg(
        F.sum("n").alias("taken"), F.count(F.lit(1)).alias("support")).where(
        F.col("support") >= SUPPORT)


def discovered(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, more): spans of identifiers that confident patterns reach, by text.

    Patterns and what they surround are a graph. Base spans are the first known identifiers. A
    pattern's score is the share of known identifiers in all places of its words in the corpus,
    so a frequent word in front of a few of them says nothing. Something of an identifier's
    shape that stands in a pattern becomes known if the pattern is confident without that
    thing's own places. What is new makes other patterns confident; this goes on until nothing
    changes. All places of a found identifier count, those without a pattern, too.
    """
    at = rows.select("key", F.explode("seen").alias("s")).select("key", "s.*")
    stands = at.select("what", "known", F.explode("patterns").alias("pattern")).groupBy(
        "pattern", "what").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"))
    stands = stage(stands, "pii-stands")
    useful = stage(stands.groupBy("pattern").agg(F.count(F.lit(1)).alias("things")).where(
        F.col("things") >= SUPPORT).select("pattern"), "pii-useful")
    edges = stage(stands.join(places(docs, useful), "pattern"), "pii-edges")
    known = stage(edges.where("known").select("what").distinct(), "pii-known")
    sure = known.limit(0)
    while True:
        others = edges.join(known, "what", "left_anti")
        score = F.try_divide(F.col("taken"), F.col("places") - F.col("n"))
        new = others.join(scored_patterns(edges, known).drop("places"), "pattern").where(
            score >= CONFIDENT).select("what").distinct()
        new = stage(new, "pii-new")
        if not new.limit(1).count():
            break
        known, sure = stage(known.union(new), "pii-known"), sure.union(new)
    found_ones = at.where("not known").join(sure, "what").select("key", F.struct(
        F.lit(len(KINDS) - 1).alias("kind"), "start", "end").alias("span"))
    return found_ones.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of the text), base and spans, which are arrays
    of (kind, start, end) in the order of KINDS, then by start; spans has the discovered ones,
    too. Missing texts are empty; repeated rows and missing doc_ids stay; equal texts have
    equal spans. Other columns are not read."""
    rows = stage(scanned(docs), "pii-rows")
    more = stage(discovered(docs, rows), "pii-more")
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select("doc_id", "key", "base").join(more, "key", "left").select(
        "doc_id", "key", "base", F.concat("base", F.coalesce("more", nothing)).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns; each span of a text is replaced by its kind in brackets.
    Where spans overlap, the first one's kind stands for all of them."""
    spans = stage(personal_data(docs).where(F.size("spans") > 0).select("key", "spans")
                  .dropDuplicates(["key"]), "pii-redacted")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                        whole_text().alias("text")).select("row", text_key().alias("key"))
    text = F.col("row.text")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        more = F.concat(acc["out"], F.array(between, F.element_at(labels, s["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(
            s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    new_text = F.aggregate(in_order, begin, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    new_text = F.when(F.col("spans").isNull(), text).otherwise(new_text)
    # the spans grow with the corpus, so they are never broadcast
    joined = keyed.join(spans.hint("merge"), "key", "left").select("row", "spans", new_text.alias("new"))
    out = {c: F.col(f"row.`{c}`") for c in names} | {"text": F.col("new")}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(
            F.length("new")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out[c].alias(c) for c in names])


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_ones = personal_data(read_documents(spark, sf_dir))
    counts = [_count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS[:-1])]
    return found_ones.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256)
                             .alias("base_sha256"), _listed("spans").alias("spans"))
