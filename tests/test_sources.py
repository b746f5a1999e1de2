import csv
import io
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from themeloom.runtime import scratch_path
from themeloom.sinks import tables
from themeloom.sources import caches, csv_files, split_csv


@pytest.fixture
def csv_file(tmp_path):
    def write(content, name="data.csv", encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
        return str(path)

    return write


def rows(df):
    return [tuple(r) for r in df.orderBy("row_id").drop("row_id").collect()]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp932", "utf-16"])
def test_encodings(spark, csv_file, encoding):
    got = csv_files.read_csv(spark, csv_file("id,対応内容\n1,配達が遅延した\n2,返品したい商品\n", encoding=encoding))
    assert got.columns == ["row_id", "id", "対応内容"]
    assert rows(got) == [("1", "配達が遅延した"), ("2", "返品したい商品")]


def test_line_ends_and_quotes(spark, csv_file):
    assert rows(csv_files.read_csv(spark, csv_file("col\r\na\nb\rc\n\nd"))) == [("a",), ("b",), ("c",), ("d",)]
    quoted = 'col,other\r\n"line1\nline2\r\nline3",x\r\n"say ""hi""",nan\r\n,null\r\n'
    assert rows(csv_files.read_csv(spark, csv_file(quoted))) == [
        ("line1\nline2\r\nline3", "x"), ('say "hi"', "nan"), ("", "null"),
    ]


def test_long_utf8_is_not_taken_for_another_encoding():
    assert csv_files.guess_encoding(("a" + "あ" * 40000).encode()) == "utf-8"
    assert csv_files.guess_encoding(b"a" * 95_000 + "商品".encode("cp932")) == "cp932"
    assert csv_files.guess_encoding(b"a" * ((1 << 20) - 1) + "商".encode()) == "utf-8"


def test_late_signs_and_swapped_columns(spark, csv_file, tmp_path):
    csv_file("a,b\n" + "x,y\n" * 30_000 + "商品,1\n", "1.csv", "cp932")
    csv_file("b,a\n2,z\n", "2.csv")
    got = csv_files.read_csv(spark, f"{tmp_path}/*.csv").orderBy("row_id")
    assert got.columns == ["row_id", "a", "b"] and [tuple(r)[1:] for r in got.collect()[-2:]] == [("商品", "1"), ("z", "2")]
    csv_file("a,c\n2,z\n", "3.csv")
    with pytest.raises(ValueError, match="different columns"):
        csv_files.read_csv(spark, f"{tmp_path}/*.csv")


def test_columns_without_a_name(spark, csv_file):
    with pytest.warns(UserWarning, match="1 columns without a name"):
        got = csv_files.read_csv(spark, csv_file("a,\n1,2\n"))
    assert got.count() == 1


@pytest.mark.parametrize(
    "content, message",
    [("", "empty"), ("a,b\n", "no data rows"), ("x,x\n1,2\n", "duplicate"), ('a,b,c\n1,"2,3\n', "do not fit"), (" , \n1,2\n", "no header")],
)
def test_broken_files(spark, csv_file, content, message):
    with pytest.raises(ValueError, match=message):
        csv_files.read_csv(spark, csv_file(content))


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        csv_files.read_csv(spark, "/tmp/no-such-file-here.csv")


def test_mismatch_names_records_not_lines(spark, csv_file):
    path = csv_file('a,b\n"x\ny",1\n1\n,,\n2,3,4\n')
    records = csv_files.csv_records(spark, path)
    assert [r.record for r in csv_files.mismatched_records(records).collect()] == [3, 5]


def by_ranges(spark, path, bytes_):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return rows(csv_files.read_splittable_csv(spark, path)), split_csv._lines(spark, path).select("path", "start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp932"])
def test_reading_by_ranges_agrees(spark, csv_file, encoding):
    random.seed(6)
    cells = ["x", "", 'say "hi"', "two\nlines", "crlf\r\nhere", '"', ",", '",\n,"', "配達が遅延", "long " * 60, "\n\n\n", "nan", 'a"b']
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(["id", "本文", "z"])
    for i in range(120):
        writer.writerow([i, random.choice(cells), random.choice(cells)])
        text.write(random.choice(["", "", "", "\n", "\r", 'raw "quote" in the middle,b,c\n', f'{i},"closed"after,c\r\n', f"{i},b,c\r"]))
    path = csv_file(text.getvalue(), encoding=encoding)
    want = rows(csv_files.read_csv(spark, path))
    ids = [r.row_id for r in csv_files.read_csv(spark, path).orderBy("row_id").collect()]
    for size in (300, 1 << 20):
        got, blocks = by_ranges(spark, path, size)
        assert got == want and (blocks > 20 or size > 300)
    assert [r.row_id for r in csv_files.read_splittable_csv(spark, path).orderBy("row_id").collect()] == ids


def test_reading_by_ranges_checks_as_well(spark, csv_file, tmp_path):
    with pytest.raises(ValueError, match="record 3"):
        csv_files.read_splittable_csv(spark, csv_file("a,b\n1,2\n1,2,3\n", "bad.csv"))
    with pytest.raises(ValueError, match="do not fit"):
        csv_files.read_splittable_csv(spark, csv_file('a,b,c\n1,"2,3\n', "open.csv"))
    with pytest.raises(Exception, match="UTF-16"):
        csv_files.read_splittable_csv(spark, csv_file("a,b\n1,2\n", "wide.csv", "utf-16"))
    with pytest.raises(FileNotFoundError):
        csv_files.read_splittable_csv(spark, "/tmp/no-such-file-here.csv")
    csv_file("a,b\n1,2\n", "x1.csv")
    csv_file("b,a\n3,4\n", "x2.csv")
    assert sorted(rows(csv_files.read_splittable_csv(spark, f"{tmp_path}/x*.csv"))) == [("1", "2"), ("4", "3")]
    csv_file("a,c\n3,4\n", "x3.csv")
    with pytest.raises(ValueError, match="different columns"):
        csv_files.read_splittable_csv(spark, f"{tmp_path}/x*.csv")


def test_profile(spark, csv_file):
    got = csv_files.profile_files(spark, csv_file("a,b\n1,2\n\n3,4\n")).first()
    assert (got.encoding, got.column_names, got.n_rows) == ("utf-8", "a, b", 2)


def test_vector_cache(spark):
    path = scratch_path(spark, "cache")
    assert caches.cached_vectors(spark, path, "m").count() == 0
    fresh = spark.createDataFrame([("h1", [1.0, 2.0]), ("h2", [3.0, 4.0])], "text_hash string, embedding array<float>")
    caches.append_vectors(fresh, path, "m")
    caches.append_vectors(fresh, path, "m")  # as a retried task would
    caches.append_vectors(fresh, path, "other")
    assert caches.cached_vectors(spark, path, "m").count() == 2
    wanted = spark.createDataFrame([("h1",), ("h3",)], "text_hash string")
    assert [r[0] for r in caches.cache_misses(wanted, caches.cached_vectors(spark, path, "m"), "text_hash").collect()] == ["h3"]
    wrong = scratch_path(spark, "wrong")
    spark.range(3).withColumn("text_hash", F.lit(1)).write.parquet(wrong)
    assert caches.cached_vectors(spark, wrong, "m").count() == 0


def test_run_folders_differ_and_formulas_are_guarded(spark):
    assert tables.run_folder("/out") != tables.run_folder("/out")
    got = spark.createDataFrame([("=1+1",), ("ok",)], "c string").select(tables.guard_formula(F.col("c"))).collect()
    assert [r[0] for r in got] == ["'=1+1", "ok"]


@pytest.mark.parametrize("mark", [b"", b"\xef\xbb\xbf"])
def test_a_file_is_decoded_as_it_is_read(mark):
    """Records hold no copy of the whole text, and are those of the text decoded at once."""
    content = mark + "a,b\r\n\"x\ny\",é日\rlone,\"q\"\"q\"\n\n".encode() * 60_000
    text = content.decode().removeprefix("\ufeff")
    for got, expected in zip(csv_files._parse(content, "utf-8"), csv.reader(io.StringIO(text, newline="")), strict=True):
        assert got == expected
    tracemalloc.start()
    count = sum(1 for _ in csv_files._parse(content, "utf-8"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 240_000 and peak < len(content) // 4
    assert list(csv_files._parse(mark, "utf-8")) == []
