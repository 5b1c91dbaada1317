"""CSV that keeps every text, labels and categories in any number, files in shared folders."""

import csv
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from keepwatt.operators.hash_split import stratified_folds
from keepwatt.operators.preparation import dummies, dummy_vectors, prepare_data
from keepwatt.operators.forest import ForestParams, feature_importance, predict, train_random_forest
from keepwatt.session import shared_dir, shared_folder, stage, staging
from keepwatt.sources.csv_tables import block_states, file_lines, load_table, write_csv


def written(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_texts_survive(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "x\ny"), (2, ' lead and trail '), (3, 'a "quoted", text'), (4, None)],
        "n int, t string")
    write_csv(df, f"{tmp_path}/out")
    back = load_table(spark, f"{tmp_path}/out", df.schema)
    assert rows(back, "n") == rows(df, "n")


def test_too_many_fields_are_an_error(spark, tmp_path):
    path = written(tmp_path, one="a,b\n1,x\n2,y,LOST\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        load_table(spark, path).select("a").collect()


def test_differing_headers_are_an_error(spark, tmp_path):
    path = written(tmp_path, one="a,b\n1,2\n", two="b,a\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        load_table(spark, path).collect()


def odd_texts(n):
    draw = random.Random(n)
    parts = ['"', '""', "\n", ",", "a", "b c", "\r\n", " ", "é", "\n\n", "'", ""]
    return [(k, "".join(draw.choice(parts) for _ in range(draw.randrange(12))) or None,
             draw.choice(["x", "y\nz", None])) for k in range(n)]


@pytest.mark.parametrize("size", ["64b", "200b", "1k", "128m"])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, size):
    """Records that span any number of ranges, ranges that begin and end inside quotes."""
    texts = odd_texts(300)
    with open(tmp_path / "one.csv", "w", newline="") as file:
        csv.writer(file, lineterminator="\r\n" if size == "1k" else "\n").writerows(
            [["n", "t", "u"], *texts, [300, "long " * 40 + "\n" + "x\n" * 400 + '"end"', "z"]])
    before = {k: spark.conf.get(k) for k in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in before:
            spark.conf.set(key, size)
        assert size == "128m" or file_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
        got = load_table(spark, str(tmp_path), missing=[""]).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    want = [(str(n), t, u) for n, t, u in texts]
    want.append(("300", "long " * 40 + "\n" + "x\n" * 400 + '"end"', "z"))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_files_without_line_breaks_in_texts_are_not_shuffled_by_line(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "concat('say \"', id, '\"') AS t")
    write_csv(df, f"{tmp_path}/out")
    back = load_table(spark, f"{tmp_path}/out", df.schema)
    assert back.count() == 5000 and rows(back.where("id < 3"), "id") == rows(df.where("id < 3"), "id")
    states = block_states(file_lines(spark, f"{tmp_path}/out"))
    assert {(r["plain"], r["torn"]) for r in states.collect()} == {(True, False)}


def test_quotes_that_do_not_match_are_an_error(spark, tmp_path):
    path = written(tmp_path, one='a,b\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="quotes do not match"):
        load_table(spark, path).collect()


def test_empty_lines_marks_and_headers_alone(spark, tmp_path):
    path = written(tmp_path, one="\ufeffa,b\r\n\r\n1,2\r\n", two="A,b\n3,\"4\"")
    assert rows(load_table(spark, path), "a") == [("1", "2"), ("3", "4")]
    (tmp_path / "sub").mkdir()
    assert load_table(spark, written(tmp_path / "sub", one="a,b\n")).count() == 0


def test_integers_with_a_fraction_in_files(spark, tmp_path):
    path = written(tmp_path, one="n,m\n3.0,\n4,5\n")
    assert rows(load_table(spark, path, spark.createDataFrame([], "n int, m long").schema), "n") == [
        (3, None), (4, 5)]


def test_many_categories_and_dots_in_names(spark):
    df = spark.range(500).selectExpr("id", "concat('v.', id) AS c", "id % 2 AS churn")
    wide = dummies(df, ["c"])
    assert len(wide.columns) == 502
    some = dummies(df.where("id < 40"), ["c"])
    assert prepare_data(some, fill_missing=0.0).data.count() == 40


def test_names_with_dots_train(spark):
    df = spark.range(300).selectExpr("id", "concat('v.', id % 3) AS c", "id % 5 AS x",
                                     "IF(id % 3 = 1, 1, 0) AS churn")
    prepared = prepare_data(dummies(df, ["c"]), fill_missing=0.0)
    model = train_random_forest(prepared, ForestParams(5, 3))
    guessed = predict(model, prepared.data)
    assert guessed.columns == [*prepared.data.columns, "prediction"]
    assert guessed.where("prediction <> churn").count() == 0
    assert dict(rows(feature_importance(spark, model, prepared.features)))["c_v.1"] > 0.1


def test_many_categories_as_sparse_vectors(spark):
    df = spark.range(100_000).selectExpr(
        "id", "CASE WHEN id % 1000 = 7 THEN NULL WHEN id % 1000 = 5 THEN 'hot.one' "
              "ELSE concat('v.', id) END AS c", "id % 7 AS x", "IF(id % 1000 = 5, 1, 0) AS churn")
    wide, names = dummy_vectors(df, ["c"])
    assert names.count() == 99_801 and wide.columns == ["id", "x", "churn", "c"]
    assert rows(names.where("value = 'hot.one'"))[0][1] == 0
    some = wide.where("id % 1000 IN (5, 6, 7)")
    sizes = {(r["id"] % 1000, len(r["c"].indices)) for r in some.collect()}
    assert sizes == {(5, 1), (6, 1), (7, 0)} and some.first()["c"].size == 99_801
    prepared = prepare_data(some, fill_missing=0.0)
    model = train_random_forest(prepared, ForestParams(3, 2))
    assert predict(model, prepared.data).count() == 300
    importance = feature_importance(spark, model, prepared.features, names)
    assert importance.count() == 99_802
    few = wide.where("id < 20").drop("x").select("*", (F.col("id") % 2).alias("x"))
    few = few.withColumn("churn", F.col("x").cast("int"))
    model = train_random_forest(prepare_data(few), ForestParams(40, 2))
    assert feature_importance(spark, model, ["c", "x"], names).where(
        "importance > 0 AND feature NOT LIKE 'c\\_%' AND feature <> 'x'").count() == 0


def test_missing_labels_are_dealt_to_all_folds(spark):
    df = spark.range(300).selectExpr("id", "CAST(NULL AS INT) AS churn")
    sizes = rows(stratified_folds(df, "churn").groupBy("fold").count(), "fold")
    assert sizes == [(k, 60) for k in range(5)]


def test_shared_folder_is_the_named_one_or_in_the_warehouse(spark):
    before = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or before
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    assert shared_dir(spark).startswith((named or warehouse).rstrip("/"))
    assert spark.sparkContext.getCheckpointDir() == before


def test_folder_of_each_machine_is_an_error_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        for warehouse in ("/spark-warehouse", "file:/spark-warehouse", "file:///w"):
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                shared_folder(master, None, warehouse)
        assert shared_folder(master, "hdfs://n/c/", "/w") == "hdfs://n/c"
        assert shared_folder(master, None, "s3a://b/w/") == "s3a://b/w/shared"
    assert shared_folder("local[8]", None, "file:/w") == "file:/w/shared"


def test_staged_tables_are_removed_at_the_end(spark):
    kept = stage(spark.range(3), "kept")
    with staging(spark) as folders:
        table = stage(spark.range(5), "gone")
        assert table.count() == 5 and len(folders) == 1
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folders[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert kept.count() == 3
