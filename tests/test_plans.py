from __future__ import annotations

import re
from pathlib import Path

import pytest
from matrix_data import integers, to_blocks, to_coo
from oracle import entry

import blockweave as bw
from blockweave.plans import matrices as mx

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"^[\s:+\-|*()\d]*Exchange ", plan(df), re.MULTILINE))


@pytest.fixture(scope="module")
def stored(spark):
    """Two 8 x 8 block grids kept as parquet, so that plans show the operators alone."""
    return [
        m.with_df(bw.stage(m.df, f"plan-{seed}"))
        for seed in (1, 2)
        for m in [to_blocks(spark, integers(seed, 16, 16), 2)]
    ]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_shuffles_of_strassen(stored, levels):
    a, b = stored
    assert shuffles(bw.strassen_multiply(a, b, levels).df) == 3
    assert shuffles(bw.strassen_single_stream(a, b, levels).df) == 2 * levels + 1
    assert shuffles(bw.strassen_by_table(a, b, levels).df) == 2 * levels + 1


def test_shuffles_of_block_product(stored):
    a, b = stored
    assert shuffles(bw.multiply_blocks(a, b).df) == 1
    assert shuffles(bw.multiply_blocks(a, b, task_bytes=1).df) == 1
    wide, tall = bw.quadrant(a, 0, 0), bw.quadrant(b, 0, 0)
    wide = bw.BlockMatrix(wide.df.where("br = 0"), 2, 8, 2)
    tall = bw.BlockMatrix(tall.df.where("bc = 0"), 8, 2, 2)
    assert shuffles(bw.multiply_blocks(wide, tall, min_flops=0.0).df) == 2  # parts of inner tiles are added up


def test_coefficient_tables_are_broadcast(stored):
    a, b = stored
    text = plan(bw.strassen_by_table(a, b, 1).df)
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_quadrant_is_a_pushed_filter(stored):
    text = plan(bw.quadrant(stored[0], 0, 1).df)
    assert "LessThan(br,4)" in text and "GreaterThanOrEqual(bc,4)" in text and "Exchange" not in text


@pytest.mark.parametrize("name", ["quadrant_11", "quadrant_12", "quadrant_21", "quadrant_22"])
def test_quadrants_are_cut_before_the_first_shuffle(spark, name):
    lines = [x for x in plan(entry.queries()[name](spark, SF_DIR)).splitlines() if re.search("Exchange|Filter .*dayofyear", x)]
    first = max(i for i, x in enumerate(lines) if "Exchange" in x)
    assert any("Filter" in x and "l_suppkey" in x for x in lines[first + 1:])


def test_block_products_sort_once_by_the_contracted_index(stored):
    text = plan(bw.multiply_blocks(*stored).df)
    assert len(re.findall(r"Sort \[part#\d+ ASC NULLS FIRST, base#\d+L ASC NULLS FIRST, c#\d+L ASC", text)) == 1
    assert text.count("Sort [") == 1


def test_sparse_product_builds_each_operand_once(spark):
    text = plan(entry.queries()["multiply_sparse_blocks"](spark, SF_DIR))
    assert text.count("FlatMapGroupsInArrow [br") == 2  # one to fill the blocks of either operand


def test_recursive_form_runs_nothing_while_it_is_planned(spark, stored):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    bw.strassen_recursive(*stored, 1)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_entry_product_combines_before_the_shuffle(spark):
    a, b = to_coo(spark, integers(1, 4, 4)), to_coo(spark, integers(2, 4, 4))
    df = bw.multiply_coo(a, b, unique=True, split_heavy=False)
    assert "partial_sum((av" in plan(df) and shuffles(df) == 3
    assert "partial_sum" in plan(bw.add_coo(a, b)) and shuffles(bw.add_coo(a, b)) == 1


def test_heavy_index_search_reuses_the_shuffles(spark):
    df = bw.multiply_coo(mx.supplied(spark, SF_DIR), mx.calendar(spark, SF_DIR))
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_unique_cells_save_a_shuffle(spark):
    a = to_coo(spark, integers(1, 4, 4))
    assert shuffles(bw.coo_to_blocks(a, 2, (4, 4)).df) == 2
    assert shuffles(bw.coo_to_blocks(a, 2, (4, 4), unique=True).df) == 1


def test_scans_read_only_their_columns(spark):
    text = plan(mx.supplied(spark, SF_DIR))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in text


@pytest.mark.parametrize("name", entry.registry.queries())
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_library_never_gathers_data_on_the_driver():
    root = Path(bw.__file__).parent
    for file in root.rglob("*.py"):
        if file.parent.name == "llm":  # an optional part with rules and tests of its own
            continue
        text = file.read_text()
        for word in (".collect(", ".toPandas(", ".toLocalIterator(", "localCheckpoint", ".rdd", "crossJoin", "udf(", "tempfile"):
            assert word not in text, f"{word} in {file.name}"


@pytest.mark.parametrize("name", ["multiply_coo", "multiply_coo_sketched", "multiply_coo_gram", "preview_product"])
def test_large_entry_products_are_summed_where_they_are_formed(spark, name):
    """Before the result is shuffled, no task sums up the pairs of a join over all of the result."""
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "FlatMapGroupsInArrow [rt" in text and "partial_sum((av" not in text


def test_sketch_takes_an_exchange_less(spark):
    pair = to_coo(spark, integers(1, 4, 4)), to_coo(spark, integers(2, 4, 4))
    full, sketch = (bw.multiply_coo(*pair, unique=True, search=s) for s in ("counts", "sketch"))
    grouped = [len(re.findall(r"Exchange hashpartitioning", plan(df))) for df in (full, sketch)]
    assert grouped[1] < grouped[0]
    assert "partial_approx_top_k" in plan(sketch)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_shared_sums_scan_each_level_once(stored, monkeypatch, levels):
    from blockweave.operators import strassen

    scans = []
    write = strassen.stage
    monkeypatch.setattr(strassen, "stage", lambda df, *a, **k: (scans.append(plan(df).count("FileScan")), write(df, *a, **k))[1])
    bw.strassen_shared(*stored, levels)
    assert scans == [2] + [1] * (2 * levels - 1), "both operands at first, then one table a level"
