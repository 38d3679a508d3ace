import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators import cleaning, matching, validity
from riskloom.sources import files

HEADER = "ID,LIMIT_BAL,SEX,AGE,PAY_1,default payment next month"


@pytest.mark.parametrize("lines", [
    [HEADER, "1,20000,2,24,2,1", "2,120000,2,,-1,0"],
    ["X1,X2,X3,X4,X5,Y", HEADER, "1,20000,2,24,2,1", "2,120000,2,,-1,0"],
])
def test_header_in_first_or_second_line(spark, tmp_path, lines):
    (tmp_path / "clients.csv").write_text("\n".join(lines))
    rows = files.read_client_csv(spark, str(tmp_path / "clients.csv")).orderBy("ID").collect()
    assert [r["ID"] for r in rows] == [1, 2] and rows[1]["AGE"] is None
    assert rows[0]["PAY_0"] == 2 and rows[0][v.TARGET] == 1 and rows[0]["LIMIT_BAL"] == 20000.0


def test_absent_table_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_clients(spark, raw=f"{tmp_path}/no.csv")


def test_first_known_alias_is_the_target(spark):
    df = spark.createDataFrame([(1, 0)], ["target", "default.payment.next.month"])
    assert cleaning.standardize_columns(df).columns == ["target", "default_flag"]
    with pytest.raises(ValueError):
        cleaning.standardize_columns(spark.createDataFrame([(1,)], ["x"]))


def test_required_columns(spark):
    with pytest.raises(ValueError, match="SEX"):
        cleaning.basic_checks(spark.createDataFrame([(1.0,)], ["LIMIT_BAL"]))


def test_fraction_in_a_whole_column(spark):
    df = spark.createDataFrame([("1.5",), ("2",), ("x",)], "AGE string")
    with pytest.raises(PySparkException):
        cleaning.coerce_numbers(df, ["AGE"], ["AGE"]).collect()
    assert [r[0] for r in cleaning.coerce_numbers(df, ["AGE"], ["AGE"], on_fraction="null").collect()] == [None, 2, None]


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (4.0, None), (2.0, "a"), (None, "b")], "x double, c string")
    assert sorted(r["x"] for r in cleaning.impute_median(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 2.0, 4.0]
    assert [r["c"] for r in cleaning.impute_mode(df, ["c"]).collect()].count("a") == 3  # tie goes to the smaller


def test_duplicates_see_nulls_and_signed_zero(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), (1.0, None), (0.0, 2.0), (-0.0, 2.0), (3.0, 3.0)], "a double, b double")
    assert cleaning.duplicate_rows(df).first()[0] == 2


def test_invalid_application(spark):
    good = {c: 0.0 for c in v.RAW_FEATURES} | {"LIMIT_BAL": 1000.0, "SEX": 1.0, "EDUCATION": 1.0, "MARRIAGE": 1.0, "AGE": 30.0}
    bad = good | {"LIMIT_BAL": -1000.0, "SEX": 3.0, "AGE": 15.0}
    gap = good | {"PAY_AMT6": None}
    schema = ", ".join(f"{c} double" for c in good)
    df = spark.createDataFrame([tuple(x.values()) for x in (good, bad, gap)], schema)
    assert validity.accepted(df).count() == 1
    faults = sorted(len(r["faults"]) for r in validity.rejected(df).collect())
    assert faults == [1, 3]


@pytest.mark.parametrize("size,bad,taken", [(1, False, True), (100, False, True), (101, False, False), (3, True, False)])
def test_batch_gate(spark, size, bad, taken):
    base = {c: F.lit(0.0) for c in v.RAW_FEATURES} | {c: F.lit(x) for c, x in (("SEX", 1), ("EDUCATION", 1), ("MARRIAGE", 1), ("AGE", 30))}
    df = spark.range(size).withColumns(base).withColumn("batch_id", F.lit(7))
    if bad:
        df = df.withColumn("AGE", F.when(F.col("id") == 0, 15).otherwise(F.col("AGE")))
    assert validity.gate_batches(df).first()["accepted"] == taken
    assert validity.rows_of_accepted_batches(df).count() == (size if taken else 0)


def test_match_counts(spark):
    left, right = spark.range(5).toDF("ID"), spark.range(3, 9).toDF("ID")
    assert tuple(matching.match_counts(left, right).first()) == (2, 3, 4)


def test_latest_report(spark, tmp_path):
    for day, value in ((2, 0.2), (3, 0.3), (1, 0.1)):
        row = spark.createDataFrame([("x", value)], "feature string, csi double")
        files.append_report(row, f"{tmp_path}/r", F.lit(f"2024-01-0{day}").cast("timestamp"))
    assert files.latest_report(spark.read.parquet(f"{tmp_path}/r"), ["feature"]).first()["csi"] == 0.3


def test_conversion_reports_absent_tables(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<double>").write.parquet(f"{tmp_path}/a")
    rows = files.parquet_to_csv(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}, f"{tmp_path}/csv").collect()
    assert [tuple(r) for r in rows] == [("a", "converted", 2, 2), ("b", "missing", None, None)]
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/a").where("v = '[1.0,2.0]'").count() == 1


def test_client_lines_that_cannot_be_read(spark, tmp_path):
    lines = ["X1,X2,X3,X4,X5,Y", HEADER, "1,NaN,2,24,2,1", ",120000,2,26,-1,0", "3000000000,5000,1,30.7,0,0"]
    (tmp_path / "clients.csv").write_text("\n".join(lines))
    path = str(tmp_path / "clients.csv")
    rows = {r["ID"]: r for r in files.read_client_csv(spark, path, on_fraction="null").collect()}
    assert set(rows) == {1, 3_000_000_000} and rows[1]["LIMIT_BAL"] is None and rows[3_000_000_000]["AGE"] is None
    assert [r["LIMIT_BAL"] for r in files.client_lines_without_key(spark, path).collect()] == ["120000"]
    with pytest.raises(PySparkException, match="AGE holds a fraction"):
        files.read_client_csv(spark, path).collect()


def test_parameters_are_one_row(spark):
    df, two = spark.range(3), spark.createDataFrame([(0.1,), (0.2,)], ["cut"])
    assert matching.with_parameters(df, two.limit(1)).count() == 3
    for wrong in (two, two.where("false")):
        with pytest.raises(PySparkException, match="one row"):
            matching.with_parameters(df, wrong).collect()


def test_predictions_are_computed_once(spark, tmp_path):
    """An accumulator sees each row once, also where a summary and a count follow."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return i / 100.0

    rows = spark.range(60, numPartitions=3).select(F.col("id").alias("ID"), score("id").alias("p"))
    assert files.save_predictions(rows, f"{tmp_path}/p", lambda t: t.agg(F.max("p").alias("top"))) == 60 and seen.value == 60
    assert spark.read.parquet(f"{tmp_path}/p_summary").first()["top"] == 0.59
    assert files.save_predictions(rows.limit(0), f"{tmp_path}/none") == 0


def test_conversion_of_an_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert files.parquet_to_csv(spark, {"none": f"{tmp_path}/none"}, f"{tmp_path}/csv").first()["n_rows"] == 0
