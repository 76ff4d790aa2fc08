"""Text files by line: skipped lines, own headers, any width, detected types."""

import re
import time

import duckdb
import pytest

from driver_queries import files
from somaframe.sources import lines as ln
from somaframe.sources import readers as r
from somaframe.sources import writers as w
from somaframe.sources.callfiles import read_wide


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("2k", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def test_skip_in_files_of_many_splits(spark, tmp_path, rows, small_splits):
    for name in ("a", "b"):
        body = "\n".join(f"{i}\t{name}{i}" for i in range(1_500))
        (tmp_path / f"{name}.txt").write_text(f"any\nlines\t\n\nat\tall\nid\tname\n{body}\n")
    got = r.read_by_name(spark, str(tmp_path), {"id": "int", "name": "string"}, skip=4)
    assert got.rdd.getNumPartitions() > 4
    assert rows(got) == sorted((i, f"{n}{i}") for n in "ab" for i in range(1_500))


def test_file_without_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    with pytest.raises(Exception, match="no header after 2 lines"):
        r.read_by_name(spark, str(tmp_path), {"one": "string"}, skip=2).collect()


def test_headers_differ_and_fields_hold_separators(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('x,"y,y",z\n1,"a ""b"", c",\n2,,NA\n,"",u\n\n')
    (tmp_path / "b.csv").write_text('z,x\nw\nv,7,8\n"q",-\n')
    got = r.read_by_name(spark, str(tmp_path), {"x": "int", "y_y": "string", "z": "string", "none": "double"}, sep=",")
    assert rows(got) == [
        (1, 'a "b", c', "", None), (2, "", None, None), (7, None, "v", None), (None, "", "u", None),
        (None, None, "q", None), (None, None, "w", None)]


@pytest.mark.parametrize("line, expected", [
    ("", [""]), ("\t", ["", ""]), ("a\t\t", ["a", "", ""]), ('"a\tb"\tc"d\t""', ["a\tb", 'c"d', ""]), ('"open\tb', ['"open', "b"]),
])
def test_fields(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(ln.fields(df.line, "\t")).first()[0] == expected


def test_wider_than_any_reader_limit(spark, tmp_path):
    n = 200_000
    (tmp_path / "a.tsv").write_text("id\t" + "\t".join(f"g{i}" for i in range(n)) + "\nr\t" + "\t".join(str(i) for i in range(n)) + "\n")
    (tmp_path / "b.tsv").write_text("g1\tid\n5\ts\nNA\tt\n")
    got = read_wide(spark, str(tmp_path), ["id"], "gene", "n", kind="bigint")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000
    total = got.groupBy("id").agg({"n": "sum", "*": "count"}).collect()
    assert {(r["id"], r["sum(n)"], r["count(1)"]) for r in total} == {("r", n * (n - 1) // 2, n), ("s", 5, 1), ("t", None, 1)}
    (tmp_path / "c.tsv").write_text("id\tg\nr\t1\t2\n")
    with pytest.raises(Exception, match="more cells"):
        read_wide(spark, str(tmp_path / "c.tsv"), ["id"], "gene", "n").collect()


def test_rows_of_cells_carry_the_ids_only(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tg1\tnote\tsite\n7\t1\tx\ts\n")
    got = read_wide(spark, str(tmp_path), ["id", "site"], "gene", "n", drop=("note",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Generate explode\(_pairs#\d+\), \[id#\d+, site#\d+\], false", plan)
    assert [tuple(r) for r in got.collect()] == [("7", "s", "g1", "1")]


def _suppliers_and_lines(spark, tmp_path, suppliers, lines):
    spark.createDataFrame([(k,) for k in suppliers], "s_suppkey bigint").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(lines, "l_linenumber int, l_suppkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    return files.QUERIES["wide_file_by_supplier"](spark, str(tmp_path))


def test_time_of_a_matrix_file_grows_with_its_cells(spark, tmp_path):
    n = 60_000  # half of them are found in the lines, every third of those twice
    lines = [(line, 2 * k) for line in (1, 2) for k in range(n // 2) for _ in range(1 + (k % 3 == 0))]
    begun = time.monotonic()
    got = _suppliers_and_lines(spark, tmp_path, range(n), lines).toPandas()
    taken = time.monotonic() - begun
    expected = {f"S-{k}": None if k % 2 else 1 + (k // 2 % 3 == 0) for k in range(n)}
    for line in (1, 2):
        cells = got[got.line == line]
        assert len(cells) == n
        assert {s: None if v != v else int(v) for s, v in zip(cells.supplier, cells.n)} == expected
    assert len(got) == 2 * n and taken < 60  # looking each column up along the line takes several times that


def test_matrix_of_missing_and_repeated_keys(spark, tmp_path, rows):
    got = _suppliers_and_lines(spark, tmp_path, [1, 2, 2, 10], [(1, 2), (1, 2), (1, None), (1, 9), (3, 10), (None, 1), (None, None)])
    con = duckdb.connect()
    for name in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = con.execute(files.SQL["wide_file_by_supplier"]).fetchall()
    assert len(expected) == 12 and sorted(map(str, rows(got, "line", "supplier", "n"))) == sorted(map(str, expected))


@pytest.mark.parametrize("cells, kind", [
    (["1", "-2", None, ""], "int"), (["1", "3000000000"], "bigint"), (["1", "99999999999999999999"], "double"),
    (["1", ".5", "1e-3", "NaN"], "double"), (["TRUE", "false", "NA"], "boolean"), (["TRUE", "1"], "string"),
    (["1", "1d"], "string"), (["007", " 8 "], "int"), ([None, "", "NA"], "string"), (["1", "late"], "string"),
])
def test_types_of_columns(spark, cells, kind):
    df = spark.createDataFrame([(c,) for c in cells], "c string").repartition(4)
    assert ln.detect_types(df) == {"c": kind}


def test_separator_and_a_late_text_value(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_text("id;when;what\n1;2;3\n4;5;6\n")
    (tmp_path / "b.txt").write_text('id;when;what\n7;8;"x;y, z"\n')
    got = r.read_detected(spark, str(tmp_path))
    assert got.dtypes == [("id", "int"), ("when", "int"), ("what", "string")]
    assert rows(got) == [(1, 2, "3"), (4, 5, "6"), (7, 8, "x;y, z")]
    (tmp_path / "c.txt").write_text("id;when\n")
    with pytest.raises(ValueError, match="state it"):
        ln.detect_separator(spark, str(tmp_path))


def test_many_tagged_files_in_one_scan(spark, tmp_path, rows):
    paths = {}
    for i in range(60):
        (tmp_path / f"f {i}.tsv").write_text(f"id\tv\n{i}\t{i * i}\n" if i % 2 else f"v\tid\n{i * i}\t{i}\n")
        paths[f"tag{i}"] = str(tmp_path / f"f {i}.tsv")
    got = r.read_tagged(spark, paths, {"id": "int", "v": "int"})
    assert rows(got) == sorted((i, i * i, f"tag{i}") for i in range(60))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3  # lines, tops and headers, whatever the number of files
    with pytest.raises(ValueError, match="two of the paths"):
        r.read_tagged(spark, paths | {"again": paths["tag1"]}, {"id": "int"})


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default if key == "spark.checkpoint.dir" else "/warehouse"

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        w.scratch_path(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert w.scratch_path(Session, "x").startswith("/warehouse/stages/x-")
    w._PATHS.pop()
