"""Registered queries over tables of a few rows."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from themeloom.catalog import ORACLES, QUERIES  # noqa: E402
from themeloom.functions import text as T  # noqa: E402


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def same_as_sql(spark, name, sf):
    got = QUERIES[name](spark, sf)
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}/*.parquet'")
    want = con.execute(ORACLES[name])
    assert got.columns == [c[0] for c in want.description]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    return rows


def test_encodings_of_records(spark, folder):
    sf = folder(
        part=([("blue steel", "SMALL"), ("grün", "LARGE"), ("名前", "SMALL")], "p_name string, p_type string"),
        conversations=([("user", "two\nlines"), ("assistant", "é, \"ö\"")], "role string, text string"),
    )
    assert same_as_sql(spark, "a2_detect_encoding", sf) == [("utf-16-be", 3), ("utf-8", 2)]


def test_params_of_trials_come_from_the_vectors(spark, folder):
    rows = [(i, [float(i % 10 == j) + 0.01 * (i % 7) for j in range(10)], i % 10) for i in range(60)]
    sf = folder(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    got = same_as_sql(spark, "b13_format_params", sf)
    assert [r[2:] for r in got][:3] == [("KM:k=2", 2), ("KM:k=5", 5), ("KM:k=10", 10)]


def test_params_of_parts(spark, folder):
    rows = [(i, 1 + i % 50, 900.0 + i / 2) for i in range(400)]
    same_as_sql(spark, "b13_part_params", folder(part=(rows, "p_partkey long, p_size int, p_retailprice double")))


def test_decimals_are_those_of_the_exact_value(spark):
    values = [0.9015, 1.0005, 0.0625, 0.125, 2.5, 1234567.8915, 0.05, 0.25, 0.35, 1.45]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(F.create_map(F.lit("resolution"), "v").alias("p"), "v")
    got = df.select("v", T.format_params(F.col("p")), T.compact_params(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(v, f"resolution={v:.3f}", f"res={v:.1f}") for v in values]


def test_params_of_trials_with_null_vectors(spark, folder):
    rows = [(i, None if i % 9 == 4 else [float(i % 10 == j) + 0.01 * (i % 7) for j in range(10)], None if i == 3 else i % 10) for i in range(60)]
    same_as_sql(spark, "b13_format_params", folder(embeddings=(rows, "vec_id long, embedding array<float>, label int")))
