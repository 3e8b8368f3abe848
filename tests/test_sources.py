from __future__ import annotations

import math
import random

import numpy as np
import pytest
from matrix_data import from_blocks, from_coo, to_coo

import blockweave as bw
from blockweave.operators.layout import list_in_full
from blockweave.sources import staging

FOUR = np.arange(1.0, 17.0).reshape(4, 4)


def lines_of(x: np.ndarray, name: str = "") -> list[str]:
    head = f"{name}," if name else ""
    return [f"{head}{i},{j},{x[i, j]:g}" for i, j in np.ndindex(*x.shape)]


@pytest.fixture
def matrix_file(tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes("\r\n".join(lines_of(FOUR)).encode())  # CRLF, no newline at the end
    return str(path)


def test_read_coo(spark, matrix_file):
    df = bw.read_coo(spark, matrix_file)
    assert df.dtypes == [("i", "bigint"), ("j", "bigint"), ("v", "double")]
    assert df.count() == 16 and np.array_equal(from_coo(df, (4, 4)), FOUR)
    assert bw.read_coo(spark, matrix_file, partitions=3).rdd.getNumPartitions() == 3


def test_read_tagged(spark, tmp_path):
    lines = lines_of(FOUR, "A") + lines_of(16 - FOUR + 1, "B")
    random.Random(0).shuffle(lines)
    (tmp_path / "ab.csv").write_text("\n".join(lines))
    df = bw.read_tagged(spark, str(tmp_path / "ab.csv"), partitions=4)
    assert df.rdd.getNumPartitions() == 4
    assert np.array_equal(from_coo(bw.select_operand(df, "A"), (4, 4)), FOUR)
    assert np.array_equal(from_coo(bw.select_operand(df, "B"), (4, 4)), 17 - FOUR)
    assert bw.infer_square_dim(df, matrices=2).first().n == 4


def test_read_blocks(spark, matrix_file):
    m = bw.read_blocks(spark, matrix_file, 2)
    assert (m.n_rows, m.n_cols) == (4, 4) and np.array_equal(from_blocks(m), FOUR)
    assert np.array_equal(from_blocks(bw.read_blocks(spark, matrix_file, 4, dims=(6, 5)))[:4, :4], FOUR)


USES = {
    "collect": lambda df: df.collect(),
    "count": lambda df: df.count(),
    "infer_dims": lambda df: bw.infer_dims(df).collect(),
    "one column": lambda df: df.select("i").collect(),
}
BAD_LINES = ["1,x,2.0", "1,2", "1.5,0,1", "1,2,", ",1,2", "-1,0,1", "1,2,three", "0,1,2.0,9", "0,-3,1", "0,1,zz", "x,1,2.0"]


@pytest.mark.parametrize("line", BAD_LINES)
@pytest.mark.parametrize("use", USES)
def test_bad_line_fails(spark, tmp_path, line, use):
    path = tmp_path / "bad.csv"
    path.write_text(f"0,0,1.0\n{line}\n")
    with pytest.raises(Exception):
        USES[use](bw.read_coo(spark, str(path)))


@pytest.mark.parametrize("line", [*(f"A,{line}" for line in BAD_LINES), ",0,1,5.0", "C,1,1,7.0", "a,1,1,7.0"])
@pytest.mark.parametrize("use", [*USES, "select_operand"])
def test_bad_tagged_line_fails(spark, tmp_path, line, use):
    path = tmp_path / "bad.csv"
    path.write_text(f"A,0,0,1.0\nB,0,0,1.0\n{line}\n")
    df = bw.read_tagged(spark, str(path))
    with pytest.raises(Exception):
        bw.select_operand(df, "B").collect() if use == "select_operand" else USES[use](df)


def test_other_names_can_be_permitted(spark, tmp_path):
    path = tmp_path / "cd.csv"
    path.write_text("C,0,0,1.0\nD,0,1,2.0\n")
    assert bw.read_tagged(spark, str(path), names=("C", "D")).count() == 2


def test_partial_listing_has_no_square_side(spark):
    assert bw.infer_square_dim(to_coo(spark, FOUR)).first().n == 4
    with pytest.raises(Exception):
        bw.infer_square_dim(to_coo(spark, FOUR).where("i + j > 0")).collect()


def test_tagged_file_to_blocks(spark, tmp_path):
    a, b = FOUR[:3, :2], np.arange(8.0).reshape(2, 4) + 1
    (tmp_path / "ab.csv").write_text("\n".join(lines_of(a, "A") + lines_of(b, "B") + ["A,0,0,5"]))
    tagged = bw.read_tagged(spark, str(tmp_path / "ab.csv"))
    assert bw.tagged_dims(tagged) == (3, 2, 4)
    blocks = bw.tagged_coo_to_blocks(tagged, 2, (3, 2, 4))
    a = a + np.array([[5, 0], [0, 0], [0, 0]])
    for levels in (0, 1):
        product = bw.strassen_multiply_tagged(blocks, (3, 2, 4), 2, levels)
        assert np.array_equal(from_blocks(product), a @ b)
    with pytest.raises(Exception):
        bw.tagged_coo_to_blocks(tagged, 2, (3, 1, 4)).collect()


def test_special_values(spark, tmp_path):
    path = tmp_path / "special.csv"
    path.write_text("0,0,NaN\n0,1,Infinity\n1,0,-Infinity\n1,1,1e3\n")
    got = {(r.i, r.j): r.v for r in bw.read_coo(spark, str(path)).collect()}
    assert math.isnan(got[0, 0]) and got[0, 1] == math.inf and got[1, 0] == -math.inf and got[1, 1] == 1000.0


def test_dims(spark):
    x = np.zeros((5, 7))
    x[4, 6] = x[0, 0] = 1.0
    assert bw.infer_dims(to_coo(spark, x)).first() == (5, 7, 2)
    assert bw.matrix_dims(to_coo(spark, x)) == (5, 7)
    assert bw.infer_dims(to_coo(spark, np.zeros((2, 2)))).first() == (0, 0, 0)
    assert bw.infer_square_dim(to_coo(spark, FOUR)).first().n == 4


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_and_read_back(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    bw.write_coo(to_coo(spark, FOUR / 3), path, fmt)
    assert np.array_equal(from_coo(bw.read_coo(spark, path, fmt=fmt), (4, 4)), FOUR / 3)
    with pytest.raises(Exception):
        bw.write_coo(to_coo(spark, FOUR), path, fmt)  # never overwrites unless told to


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        bw.write_coo(to_coo(spark, FOUR), "/nowhere", "xml")
    with pytest.raises(ValueError):
        bw.read_coo(spark, "/nowhere", fmt="xml")


def test_preview(spark):
    assert [tuple(r) for r in bw.preview(to_coo(spark, FOUR), 3).collect()] == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)]


def test_stage_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = bw.scratch_path(spark, "x"), bw.scratch_path(spark, "x")
    assert first.startswith(root) and first != second
    staged = bw.stage(to_coo(spark, FOUR), "four")
    assert root in staged.inputFiles()[0]
    assert np.array_equal(from_coo(staged, (4, 4)), FOUR)
    bw.unstage(staged)
    with pytest.raises(Exception):
        staged.collect()


def test_only_staged_tables_can_be_unstaged(spark, tmp_path):
    path = str(tmp_path / "mine")
    bw.write_coo(to_coo(spark, FOUR), path, "parquet")
    with pytest.raises(ValueError):
        bw.unstage(spark.read.parquet(path))
    assert bw.read_coo(spark, path, fmt="parquet").count() == 16


def test_a_shared_folder_given_as_uri(spark, tmp_path, monkeypatch):
    """However the shared folder is written, what was staged there is recognised."""
    for root in (f"file://{tmp_path}/u", f"file:{tmp_path}/v", f"{tmp_path}/w/"):
        monkeypatch.setattr(staging, "shared_root", lambda _, root=root: root.rstrip("/"))
        staged = bw.stage(to_coo(spark, FOUR), "four")
        assert staged.count() == 16
        bw.unstage(staged)
        assert not list((tmp_path / root.rstrip("/")[-1]).iterdir())


def test_dimensions_from_footers(spark, tmp_path):
    path = str(tmp_path / "cells")
    bw.write_coo(to_coo(spark, np.triu(np.ones((5, 9)))).repartition(3), path, "parquet")
    df = bw.footer_dims(spark, path)
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(i), MIN(j), MAX(i), MAX(j), COUNT(i), COUNT(j), COUNT(v), COUNT(*)]" in scan
    assert tuple(df.first()) == tuple(bw.infer_dims(bw.read_coo(spark, path, fmt="parquet")).first()) == (5, 9, 35)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false", "the caller's session is as it was"


@pytest.mark.parametrize("row", [(-1, 0, 1.0), (0, -1, 1.0), (0, 0, None), (None, 0, 1.0)])
def test_footers_show_bad_entries(spark, tmp_path, row):
    path = str(tmp_path / "cells")
    spark.createDataFrame([(1, 1, 1.0), row], bw.COO_SCHEMA).write.parquet(path)
    # A file in which an index is missing everywhere has no least one in its footer, which fails the scan.
    with pytest.raises(Exception, match="negative index or a missing value|FAILED_READ_FILE"):
        bw.footer_dims(spark, path).collect()


def test_footers_of_an_empty_matrix(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.createDataFrame([], bw.COO_SCHEMA).write.parquet(path)
    assert tuple(bw.footer_dims(spark, path).first()) == (0, 0, 0)


BAD = {
    "x,2,3": "not a triplet", "1,2": "not a triplet", "1,2,3,4": "not a triplet", " 1,2,3": "not a triplet", "1.0,2,3": "not a triplet",
    "nonsense": "not a triplet", "1,2,": "missing value", ",2,3": "missing value", "-1,2,3": "negative index", "1,-2,3": "negative index",
}


def test_bad_lines_are_set_aside(spark, tmp_path):
    good = ["0,0,1.5", "1,2,-3", '"1",3,4', "5,6,1e3", "7,7,NaN"]
    path = tmp_path / "lines.csv"
    path.write_bytes("\r\n".join([*good[:2], "", *BAD, *good[2:], "1,2,-3"]).encode())
    found = bw.read_quarantined(spark, str(path))
    assert sorted((r.i, r.j) for r in found.good.collect()) == [(0, 0), (1, 2), (1, 2), (1, 3), (5, 6), (7, 7)]
    assert {r.line: r.reason for r in found.bad.collect()} == BAD
    assert all(r.file.endswith("lines.csv") for r in found.bad.collect())
    path.write_text("\n".join(good))
    strict = bw.read_coo(spark, str(path))
    assert strict.exceptAll(bw.read_quarantined(spark, str(path)).good).isEmpty() and bw.read_quarantined(spark, str(path)).bad.isEmpty()
    for line in BAD:
        path.write_text(line)
        with pytest.raises(Exception):
            bw.read_coo(spark, str(path)).collect()


def test_bad_tagged_lines(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text("A,0,0,1\nB,1,1,2\nC,0,0,1\nA,0,0\n,0,0,1\nB,x,0,1\n")
    found = bw.read_quarantined(spark, str(path), names=("A", "B"))
    assert sorted(tuple(r) for r in found.good.collect()) == [("A", 0, 0, 1.0), ("B", 1, 1, 2.0)]
    assert {r.line: r.reason for r in found.bad.collect()} == {"C,0,0,1": "unknown name", "A,0,0": "not a triplet", ",0,0,1": "missing value", "B,x,0,1": "not a triplet"}


def test_an_aggregate_of_good_lines_still_reads_lines_whole(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text("1,2,3\n1,2,x\n1,2\n")
    found = bw.read_quarantined(spark, str(path))
    assert (found.good.count(), found.bad.count()) == (1, 2)
    assert found.good.select("i").count() == 1 and found.bad.select("reason").distinct().count() == 1


def test_full_listing_has_zeros_in_runs(spark):
    x = np.array([[0, 0, 5, 0, 0], [0, 0, 0, 0, 0], [1, 0, 0, 0, 2], [1, 2, 3, 4, 5], [0, 7, 0, 8, 0]], dtype=float)
    rows = list_in_full(to_coo(spark, x), 5, 5).collect()
    out = np.full((5, 5), np.nan)
    for r in rows:
        assert np.isnan(out[r.i, r.j:r.j + r.times]).all(), "a cell is listed twice"
        out[r.i, r.j:r.j + r.times] = r.v
    assert np.array_equal(out, x)
    assert len(rows) <= 2 * np.count_nonzero(x) + 5
    assert bw.infer_square_dim(list_in_full(to_coo(spark, x), 5, 5), times="times").first().n == 5
    assert bw.infer_square_dim(list_in_full(to_coo(spark, x), 0, 0).where("false"), times="times").first().n == 0
    with pytest.raises(Exception, match="do not list"):
        bw.infer_square_dim(list_in_full(to_coo(spark, x), 5, 5).where("i + j > 0"), times="times").collect()
    with pytest.raises(Exception, match="outside"):
        bw.infer_square_dim(list_in_full(to_coo(spark, x), 4, 5), times="times").collect()


def test_a_wide_listing_takes_no_row_for_each_cell(spark):
    """A million cells a side with three entries: a row for each of 10 ** 12 cells would never end."""
    coo = spark.createDataFrame([(0, 0, 1.0), (5, 999_999, 2.0), (999_999, 17, 3.0)], bw.COO_SCHEMA)
    listed = list_in_full(coo, 1_000_000, 1_000_000)
    assert bw.infer_square_dim(listed, times="times").first().n == 1_000_000
    assert listed.count() == 1_000_004
