"""CSV input with explicit types, CSV output, preview and schema report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwatt.functions import cast_int
from keepwatt.session import stage

# Texts that count as missing in a CSV field.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

BROADCAST_RANGES = 50_000  # rows of the table of byte ranges, some 10 MB
ROWS_PER_GZIP = 500_000  # rows of one gzipped file, which a single task reads


def _odd_quotes(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line, odd): the lines of text files as tasks read them. ``block`` is
    the first byte of the range that a line was read in, ``at`` grows within a block, ``odd``
    tells whether the line has an odd number of quotes."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
            .withColumn("odd", _odd_quotes(F.col("line"))))


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, first_at, plain, open, end_open, carry, torn): one row per block, from a
    prefix scan of the parity of quotes over the blocks of a file.

    ``open`` and ``end_open`` say whether the block starts and ends inside quotes, ``carry`` is
    the block that the record began in that is open at its start, ``plain`` blocks have one
    record in each line, and files whose quotes do not match are ``torn``.
    """
    sums = lines.groupBy("file", "block").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.count_if("odd").alias("odds"), F.min(F.when(F.col("odd"), F.col("at"))).alias("first_odd"))
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    opened = sums.withColumn("open", F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2 == 1)
    # in a block that starts inside quotes, a record begins after the line that ends them
    begins = ~F.col("open") | F.coalesce(F.col("first_odd") < F.col("last_at"), F.lit(False))
    return opened.select(
        "file", "block", "first_at", "open",
        (~F.col("open") & (F.col("odds") == 0)).alias("plain"),
        (F.col("open") != (F.col("odds") % 2 == 1)).alias("end_open"),
        F.last(F.when(begins, F.col("block")), True).over(before).alias("carry"),
        (F.sum("odds").over(Window.partitionBy("file")) % 2 == 1).alias("torn"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, header): every record of CSV files as text, whatever the size of a file; quoted
    line breaks are part of their record.

    Files are read in byte ranges by many tasks. A first pass, made now, counts the quotes of
    each range. Lines of ranges without open quotes are records and go through without a
    shuffle; the others are put in order within their range, which has a fixed size, and only
    the lines of records with line breaks are grouped.
    """
    lines = file_lines(spark, path)
    # one row for each 128 MB; written and counted, so that its size is known
    states = stage(block_states(lines), "csv-ranges")
    ranges, plain_ones = states.agg(F.count(F.lit(1)), F.count_if("plain")).first()
    if ranges <= BROADCAST_RANGES:
        states = F.broadcast(states)
    torn = F.raise_error(F.concat(F.lit("quotes do not match in "), F.col("file"))).cast("boolean")
    placed = lines.join(states, ["file", "block"]).where(
        F.when(F.col("torn"), torn).otherwise(F.lit(True)))
    at_top = F.col("block") == 0
    plain = placed.where("plain").select(
        F.col("line").alias("record"), (at_top & (F.col("at") == F.col("first_at"))).alias("header"))
    if ranges == plain_ones:
        return plain
    in_block = Window.partitionBy("file", "block").orderBy("at")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    odds = F.coalesce(F.sum(F.col("odd").cast("long")).over(before), F.lit(0))
    ordered = placed.where("NOT plain").withColumn(
        "starts", (odds + F.col("open").cast("long")) % 2 == 0).withColumn(
        "number", F.sum(F.col("starts").cast("long")).over(in_block)).withColumn(
        "numbers", F.max("number").over(Window.partitionBy("file", "block")))
    header = at_top & (F.col("number") == 1)
    single = ordered.where("starts AND NOT odd").select(
        F.col("line").alias("record"), header.alias("header"))
    # the record that is open at the end of its block has the number -1 in this and later blocks
    last = F.col("end_open") & (F.col("number") == F.col("numbers"))
    several = ordered.where("NOT (starts AND NOT odd)").select(
        "file", F.when(F.col("number") == 0, F.col("carry")).otherwise(F.col("block")).alias("of"),
        F.when((F.col("number") == 0) | last, -1).otherwise(F.col("number")).alias("number"),
        F.struct("block", "at", "line").alias("part"), (header & F.col("starts")).alias("header"))
    joined = several.groupBy("file", "of", "number").agg(
        F.array_sort(F.collect_list("part")).alias("parts"), F.max("header").alias("header"))
    return plain.unionByName(single).unionByName(joined.select(
        F.array_join(F.col("parts.line"), "\n").alias("record"), "header"))


def _parsed_records(spark: SparkSession, path: str, names: Sequence[str], mode: str) -> DataFrame:
    """The records of CSV files as text columns. The header of each file has to be ``names``."""
    kind = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"escape": '"', "multiLine": "true", "mode": mode}
    header = F.from_csv(F.lower(F.regexp_replace("record", "^\ufeff", "")), kind, options)
    same = F.array(*[header[f"c{i}"] for i in range(len(names))]) == F.array(
        *[F.lit(name.lower()) for name in names])
    other = F.raise_error(F.concat(F.lit(f"the header is not {list(names)}: "), F.col("record")))
    # what ends the lines of some files, and empty lines
    ended = csv_records(spark, path).withColumn("record", F.rtrim("record", F.lit("\r")))
    records = ended.where(F.when(F.col("header"), F.when(
        F.coalesce(same, F.lit(False)), F.lit(False)).otherwise(other.cast("boolean")))
        .otherwise(F.col("record") != ""))
    # a generator, so that all fields are parsed, and once, whatever is selected
    return records.select(F.inline(F.array(F.from_csv("record", kind, options)))).toDF(*names)


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               missing: Sequence[str] = tuple(MISSING_TEXTS), multi_line: bool = True,
               mode: str = "FAILFAST") -> DataFrame:
    """Read CSV files with a header line. Only the header is read up front: all fields come as
    text, missing texts become NULL, and fields named in ``schema`` are cast by name, so bad
    values are errors and the column order of the file does not matter. Fields outside the
    schema stay text. Lines with other numbers of fields than the header, and files whose
    headers differ, are errors.

    Quoted line breaks are part of their field, and large files are split all the same, which
    takes a pass over the files at once, see ``csv_records``; quotes have to match as in
    RFC 4180. Turning ``multi_line`` off saves the passes that find line breaks, for data that
    is known to have none.
    """
    raw = (spark.read.option("header", True).option("escape", '"')
           .option("multiLine", multi_line).option("mode", mode)
           .option("enforceSchema", False).option("columnPruning", False).csv(path))
    if multi_line and raw.columns:
        raw = _parsed_records(spark, path, raw.columns, mode)
    kinds = {f.name: f.dataType for f in schema} if schema else {}
    absent = [name for name in kinds if name not in raw.columns]
    if absent:
        raise ValueError(f"columns not in {path}: {absent}")

    def field(name: str):
        c = F.col(f"`{name}`")
        present = F.when(~c.isin(list(missing)), c)
        kind = kinds.get(name, T.StringType())
        if isinstance(kind, T.IntegralType):
            return cast_int(present, missing_is_error=False).cast(kind).alias(name)
        return present.cast(kind).alias(name)

    return raw.select(*[field(name) for name in raw.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite",
              rows_per_gzip: int | None = None) -> None:
    """Write a directory of CSV part files with headers. Missing values become empty fields,
    blanks around texts stay. With ``rows_per_gzip`` the files are gzipped, which takes numbers
    to less than half, and have at most so many rows each, since they cannot be read in ranges."""
    writer = df.write.mode(mode)
    if rows_per_gzip:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", rows_per_gzip)
    (writer.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def preview(df: DataFrame, rows: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows, in a defined order if ``order_by`` names columns."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def schema_report(df: DataFrame) -> DataFrame:
    """(position, column, type, rows, non_null) of every column, from one aggregate."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"),
                    *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"),
                 F.col("rows").alias("rows"), F.col(f"n{i}").alias("non_null"))
        for i, f in enumerate(df.schema)
    ])))
