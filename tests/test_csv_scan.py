"""CSV by byte ranges: quotes on range edges, stray quotes, malformed records."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.sources import csv_scan, files

HEADER = "Id,Age,Income,Home,Emp_length,Intent,Amount,Rate,Status,Percent_income,Default,Cred_length"
SMALL = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("line", T.StringType())])


def as_text(schema):
    return {f.name: (F.col(f.name), F.col(f.name)) for f in schema.fields}


@pytest.fixture
def ranges(spark):
    """Sets the bytes of a range."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def to(n):
        for name in names:
            spark.conf.set(name, n)

    yield to
    for name in names:
        spark.conf.unset(name)


def rows_of(df):
    return sorted(tuple(r)[:3] for r in df.collect())


@pytest.mark.parametrize("size", [64, 333, 5000, 1 << 20])
def test_quoted_line_breaks_on_every_edge(spark, tmp_path, ranges, size):
    rng = random.Random(size)
    pieces = ["x", "two\nlines", 'a "quote"', ',', '\n\n', '"', "long " * 30, "", "tail\n", '",\n"', "\r\n in", "é漢\U0001f600"]
    rows = [(str(i), "".join(rng.choices(pieces, k=rng.randrange(4))), rng.choice(pieces)) for i in range(120 if size < 1000 else 600)]
    for k in range(2):
        text = io.StringIO()
        csv.writer(text, lineterminator="\r\n" if k else "\n").writerows([SMALL.names, *rows[k::2]])
        (tmp_path / f"part{k}.csv").write_bytes(text.getvalue().encode())
    ranges(size)
    table = csv_scan.read_csv(spark, str(tmp_path), SMALL, as_text(SMALL))
    assert rows_of(table.rows.fillna("")) == sorted(rows)  # an empty field is null
    assert table.rejects.isEmpty()
    if size < 1000:
        assert csv_scan._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8


def test_one_record_longer_than_many_ranges(spark, tmp_path, ranges):
    long = "\n".join(f"line {i} of \"\"one\"\" field" for i in range(3000))
    (tmp_path / "a.csv").write_text(f'a,b,line\n1,"{long}",x\n2,y,z\n')
    ranges(1000)
    table = csv_scan.read_csv(spark, str(tmp_path / "a.csv"), SMALL, as_text(SMALL))
    assert rows_of(table.rows) == [("1", long.replace('""', '"'), "x"), ("2", "y", "z")]


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_stray_quotes_are_text(spark, tmp_path, ranges, size):
    (tmp_path / "a.csv").write_text('a,b,line\n1,5" pipe,x\n2,"q\n 7"" w\n",y\n3,6" a "b",z\n4,"k",\'"\'\n5, "sp,q\n')
    ranges(size)
    table = csv_scan.read_csv(spark, str(tmp_path / "a.csv"), SMALL, as_text(SMALL))
    assert rows_of(table.rows) == [("1", '5" pipe', "x"), ("2", 'q\n 7" w\n', "y"), ("3", '6" a "b"', "z"), ("4", "k", "'\"'"), ("5", ' "sp', "q")]


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_malformed_records_are_kept_whole(spark, tmp_path, ranges, size):
    good = "1,22,59000,RENT,123,PERSONAL,35000,16.02,1,0.59,Y,3"
    many = "2,22,1,000,RENT,123,PERSONAL,35000,16.02,1,0.59,Y,3"
    multi = '4,22,59000,"RE\nNT",123,PERSONAL,35000,16.02,1,0.59,Y'
    odd = "5,22.5,59000,RENT,123,PERSONAL,35000,16.02,x,0.59,Y,3"
    open_end = '6,22,59000,"RENT,1\n2'
    path = tmp_path / "a.csv"
    path.write_text("\n".join([HEADER, good, many, "3,22", "", multi, odd, good.replace("1,", "7,", 1), open_end]) + "\n")
    ranges(size)
    table = files.scan_applications_csv(spark, str(path))
    assert sorted(r.app_id for r in table.rows.collect()) == [1, 5, 7]
    got = sorted(((r.line, r.column_name, r.value, r.reason) for r in table.rejects.collect()), key=str)
    assert got == sorted([(3, None, many, "13 fields"), (4, None, "3,22", "2 fields"), (6, None, multi, "11 fields"), (8, "age", "22.5", "type"),
                          (8, "status", "x", "type"), (10, None, open_end, "open quote")], key=str)
    assert {r.file.rsplit("/", 1)[-1] for r in table.rejects.collect()} == {"a.csv"}
    with pytest.raises(ValueError, match="line 3: 13 fields"):
        files.read_applications_csv(spark, str(path))
    assert files.read_applications_csv(spark, str(path), malformed="skip").count() == 3


def test_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "only.csv").write_text("a,b,line\n")
    assert csv_scan.read_csv(spark, str(tmp_path / "only.csv"), SMALL, as_text(SMALL)).rows.isEmpty()
    (tmp_path / "none.csv").write_text("")
    assert csv_scan.read_csv(spark, str(tmp_path / "none.csv"), SMALL, as_text(SMALL)).rows.isEmpty()
    (tmp_path / "other.csv").write_text("a,c,line\n1,2,3\n")
    with pytest.raises(ValueError, match="header"):
        csv_scan.read_csv(spark, str(tmp_path / "other.csv"), SMALL, as_text(SMALL))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    (tmp_path / "a.csv").write_text("a,b,line\n" + "".join(f'{i},"two\nlines {i}",z\n' for i in range(200_000)))
    ranges(512 * 1024)
    lines = csv_scan._lines(spark, str(tmp_path / "a.csv"))
    assert lines.rdd.getNumPartitions() > 8
    table = csv_scan.read_csv(spark, str(tmp_path / "a.csv"), SMALL, as_text(SMALL))
    got = table.rows.agg(F.count("*"), F.countDistinct("a"), F.count_if(F.col("b") == F.concat(F.lit("two\nlines "), F.col("a")))).first()
    assert tuple(got) == (200_000,) * 3 and table.rejects.isEmpty()


def test_numbers_in_any_form_are_read_by_casts_that_do_not_throw(spark):
    kinds = {"a": T.LongType(), "b": T.IntegerType(), "c": T.DoubleType()}
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    forms = ["22", "22.0", " 7 ", "+5", "-3", "1e3", "1E2", "22.5", "bad", "x1", "NA", "", "inf", "-Infinity", "NaN ", "1d", "0x1p3", ".5", "5.", "99999999999", "1e300", "--1", "é"]
    typed = files._typed(schema, ["NA", ""], False)
    df = spark.createDataFrame([(f, f, f) for f in forms], "a string, b string, c string")
    got = df.select(*(text.alias(n) for n, (_, text) in typed.items())).select("*", *(value.alias(f"{n}_value") for n, (value, _) in typed.items())).collect()
    for r in got:
        text = r.a
        number = spark.sql("SELECT try_cast(:t AS double) d, try_cast(:t AS long) a, try_cast(:t AS int) b", args={"t": text}).first() if text is not None else None
        for n in "ab":
            whole = None if number is None else number[n]
            if number is not None and whole is None and number.d is not None and number.d == number.d and abs(number.d) < 2 ** (63 if n == "a" else 31) and number.d == int(number.d):
                whole = int(number.d)
            assert r[f"{n}_value"] == whole, (text, n)
        assert r.c_value == (None if number is None or number.d is None or number.d != number.d else number.d), text
    plan = df.select(*(text.alias(n) for n, (_, text) in typed.items())).select(typed["b"][0].alias("v"))
    assert "rlike" in plan._jdf.queryExecution().optimizedPlan().toString().lower()  # "22.0" and "bad" reach no cast that throws
