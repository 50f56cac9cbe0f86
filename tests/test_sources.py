import csv
import random

import pytest

from tabulens.sources import tables as S


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    path = write(tmp_path, "t.csv", "\n".join(sep.join(row) for row in (["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"])))
    df = S.load_table(spark, path)
    assert df.columns == ["a", "b", "c"] and [tuple(r) for r in df.collect()] == [(1, 2, 3), (4, 5, 6)]


def test_delimiter_falls_back_to_a_comma():
    assert S.detect_delimiter("oneword") == ","


@pytest.mark.parametrize(
    "raw,tidy",
    [
        (["  First Name ", "AGE", "a--b!!c", "Annual Income (k$)"], ["first_name", "age", "a_b_c", "annual_income_k"]),
        (["a b", "a-b", "A B"], ["a_b", "a_b_2", "a_b_3"]),
        (["имя", "", "x"], ["column_0", "unnamed_1", "x"]),
    ],
)
def test_column_names(raw, tidy):
    assert S.normalise_names(raw) == tidy


def test_types_and_missing_tokens(spark, tmp_path):
    path = write(
        tmp_path, "t.csv",
        'id,price,flag,day,note,empty,mixed\n1,1.5,True,2024-01-01,"a, ""quoted""",,1\n2,N/A,false,2024-01-02,NA,,x\n'
        "-3,1e3,,null,plain,NaN,2\n",
    )
    df = S.load_table(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "price": "double", "flag": "boolean", "day": "string", "note": "string",
        "empty": "double", "mixed": "string",
    }
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows[2] == (2, None, False, "2024-01-02", None, None, "x")
    assert rows[1][4] == 'a, "quoted"' and rows[0][1] == 1000.0 and rows[0][2] is None


def test_java_number_suffixes_are_text(frame):
    assert dict(S.infer_types(frame("a string, b string", ("1d", "0x1F"))).dtypes) == {"a": "string", "b": "string"}
    assert S.infer_types(frame("a string", ("99999999999999999999",))).first().a == 1e20


def test_errors(spark, tmp_path):
    for path in (write(tmp_path, "t.txt", "a\n1"), write(tmp_path, "empty.csv", ""), write(tmp_path, "only_header.csv", "a,b\n")):
        with pytest.raises(S.DataLoadError):
            S.load_table(spark, path)


def test_typed_formats_and_folders(spark, tmp_path):
    df = spark.range(3).selectExpr("id AS `Row Id`", "double('NaN') AS x")
    for fmt in ("parquet", "orc", "json"):
        path = str(tmp_path / f"t.{fmt}")
        df.write.format(fmt).save(path)
        loaded = S.load_table(spark, path)
        assert loaded.columns[0] == "row_id" and loaded.count() == 3
    assert S.load_table(spark, str(tmp_path / "t.parquet")).first().x is None
    folder = tmp_path / "many.csv"
    folder.mkdir()
    write(folder, "1.csv", "a,b\n1,x\n")
    write(folder, "2.csv", "a,b\n2,y\n")
    assert S.load_table(spark, str(folder)).count() == 2


def test_quoted_line_breaks_need_multiline(spark, tmp_path):
    path = write(tmp_path, "t.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert S.load_table(spark, path, multiline=True).count() == 2


def test_preview_and_written_results(spark, tmp_path):
    df = spark.range(300).selectExpr("300 - id AS k")
    assert [r.k for r in S.preview(df, "k").collect()] == list(range(1, 101))
    tables = {"head": S.preview(df, "k", 5), "all": df}
    paths = S.write_results(tables, str(tmp_path / "out"), ["head"])
    assert len(paths) == 1 and spark.read.parquet(paths[0]).count() == 5
    assert len(S.write_results(tables, str(tmp_path / "out2"), fmt="json")) == 2
    with pytest.raises(ValueError):
        S.write_results(tables, str(tmp_path / "out"), ["nope"])


def test_no_field_and_no_line_is_lost(spark, tmp_path):
    for body in ("a,b\n1,2\n3,4,5\n", "a,b\n1,2\n3\n", 'a,b\n1,"x\ny"\n'):
        with pytest.raises(S.DataLoadError):
            S.load_table(spark, write(tmp_path, "bad.csv", body))
    broken = write(tmp_path, "broken.csv", 'a,"b\nc"\n1,"x\ny"\n2,z\n')
    df = S.load_table(spark, broken, multiline=True)
    assert df.columns == ["a", "b_c"] and {tuple(r) for r in df.collect()} == {(1, "x\ny"), (2, "z")}
    with pytest.raises(S.DataLoadError):
        S.load_table(spark, write(tmp_path, "long.csv", "a,b\n1,2\n3,4,5\n"), multiline=True)
    same = S.load_table(spark, write(tmp_path, "same.csv", "a,b\nx,y\na,b\n\na,b\n"))
    assert sorted(map(tuple, same.collect())) == [("a", "b"), ("a", "b"), ("x", "y")]


def test_delimiters_inside_quotes_do_not_count():
    assert S.detect_delimiter('a;b\n"1,2,3";4\n"5,6";7') == ";"
    assert S.detect_delimiter("a|b|c\n1,5|2|3\n4|5,5|6") == "|"


def test_lines_become_a_table(spark):
    lines = spark.createDataFrame([("Id;Some Name",), ('1;"a;b"',), ("2;NA",)], "value string")
    df = S.parse_lines(lines)
    assert df.columns == ["id", "some_name"] and sorted(map(tuple, df.collect()), key=repr) == [(1, "a;b"), (2, None)]


def test_one_file_with_quoted_breaks_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    texts = ["a\nb", '"q"\n\n"', "plain", "x,y\r\nz", "long\n" * 300, '"', "é\n", " pad "]
    rows = [(i, rng.choice(texts), i * 0.5) for i in range(400)]
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for name, part, end in (("a.csv", rows[:300], "\n"), ("b.csv", rows[300:], "\r\n")):
        with open(folder / name, "w", newline="") as file:
            writer = csv.writer(file, lineterminator=end)
            writer.writerows([("id", "the\nname", "x"), *part])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = S.read_records(spark, str(folder))
        ranges = spark.read.text(str(folder / "a.csv")).rdd.getNumPartitions()
        df = S.load_table(spark, str(folder), multiline=True)
        assert ranges > 20 and records.count() == 402
        assert df.columns == ["id", "the_name", "x"]
        assert sorted(tuple(r) for r in df.collect()) == rows
        with pytest.raises(S.DataLoadError, match="unclosed"):
            S.load_table(spark, write(tmp_path, "open.csv", 'a,b\n1,"x\n2,y\n' + "3,z\n" * 500), multiline=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    one = spark.read.options(header=True, multiLine=True, escape='"').csv(str(folder / "a.csv"))
    assert one.count() == 300


def test_files_with_other_headers_raise(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    for name, text in (("a.csv", "a,b\n1,2\n"), ("b.csv", "a,c\n3,4\n")):
        (folder / name).write_text(text)
    with pytest.raises(S.DataLoadError, match="headers"):
        S.load_table(spark, str(folder), multiline=True)
