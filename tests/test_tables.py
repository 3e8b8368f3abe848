from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from matrix_data import from_blocks, integers, to_blocks, to_coo

import blockweave as bw
from blockweave.sources import staging
from blockweave.sources.staging import shared_root


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def folders(spark) -> set[str]:
    root = Path(shared_root(spark).removeprefix("file:"))
    return {p.name for p in root.iterdir()} if root.exists() else set()


@pytest.mark.parametrize("shape", [(6, 40, 6), (5, 33, 9), (4, 4, 4)])
@pytest.mark.parametrize("task_bytes", [1, 1 << 28])
def test_product_without_a_shuffle_of_operands(spark, shape, task_bytes):
    m, k, n = shape
    a, b = integers(1, m, k, 0.8), integers(2, k, n, 0.8)
    with bw.bucket_blocks(to_blocks(spark, a, 4), "bc", 5) as left, bw.bucket_blocks(to_blocks(spark, b, 4), "br", 5) as right:
        got = bw.bucketed_product(left, right, task_bytes)
        below = plan(got.df).split("SortMergeJoin")
        assert len(below) == 2 and "Exchange" not in below[1] and below[0].count("Exchange") == 1
        assert below[1].count("SelectedBucketsCount: 5 out of 5") == 2
        assert np.array_equal(from_blocks(got), a @ b)


def test_sum_without_a_shuffle(spark):
    a, b = integers(1, 20, 12), integers(2, 20, 12)
    b[8:12] = 0
    with bw.bucket_blocks(to_blocks(spark, a, 4)) as left, bw.bucket_blocks(to_blocks(spark, b, 4)) as right:
        for total, expected in ((bw.add_blocks, a + b), (bw.subtract_blocks, a - b)):
            got = total(left.matrix, right.matrix)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            assert "Exchange" not in plan(got.df)
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            assert np.array_equal(from_blocks(got), expected)


def test_a_table_is_files_in_the_shared_folder_and_goes_with_its_owner(spark):
    before = folders(spark)
    x = integers(3, 8, 8)
    with bw.bucket_blocks(to_blocks(spark, x, 2)) as table:
        assert folders(spark) - before == {Path(table.path).name}
        spark.catalog.clearCache()  # nothing of it lives in an executor
        assert "InMemoryTableScan" not in plan(table.matrix.df) and "FileScan" in plan(table.matrix.df)
        assert np.array_equal(from_blocks(table.matrix), x)
        assert spark.catalog.tableExists(table.name)
    assert folders(spark) == before and not spark.catalog.tableExists(table.name)
    with pytest.raises(RuntimeError), bw.bucket_blocks(to_blocks(spark, x, 2)):
        raise RuntimeError
    assert folders(spark) == before


def test_buckets_have_to_match(spark):
    m = to_blocks(spark, integers(4, 8, 8), 2)
    with bw.bucket_blocks(m, "bc", 3) as left, bw.bucket_blocks(m, "br", 4) as more, bw.bucket_blocks(m, "bc", 3) as other:
        for right in (more, other):
            with pytest.raises(ValueError, match="buckets"):
                bw.bucketed_product(left, right)


def test_empty_matrix(spark):
    m = to_blocks(spark, integers(4, 8, 8), 2)
    empty = m.with_df(m.df.limit(0))
    with bw.bucket_blocks(empty, "bc", 3) as left, bw.bucket_blocks(m, "br", 3) as right:
        assert bw.bucketed_product(left, right).df.count() == 0


def test_owned_tables_are_dropped(spark):
    before, coo = folders(spark), to_coo(spark, integers(5, 4, 4))
    with bw.owned():
        first = bw.stage(coo, "first")
        with bw.owned():
            bw.stage(first, "second")
            third = bw.stage(first, "third", keep=True)
            assert len(folders(spark) - before) == 3
        assert {f.split("-")[0] for f in folders(spark) - before} == {"first", "third"}
        kept = bw.stage(third, "kept", keep=True)
    assert {f.split("-")[0] for f in folders(spark) - before} == {"kept"}
    assert kept.count() == coo.count()
    bw.unstage(kept)
    with pytest.raises(ZeroDivisionError), bw.owned():
        bw.stage(coo, "lost")
        raise ZeroDivisionError
    assert folders(spark) == before


def test_only_folders_below_the_shared_one_are_dropped(spark, tmp_path):
    (tmp_path / "mine").mkdir()
    for path in (tmp_path / "mine", shared_root(spark), f"{shared_root(spark)}-other/x"):
        with pytest.raises(ValueError):
            staging.drop_folder(spark, str(path))
