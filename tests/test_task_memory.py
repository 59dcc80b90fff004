"""What a task holds at once does not grow with the rows: the view's joins and groupings, and the passes of a selection."""

import tracemalloc

import numpy as np
import pyarrow as pa

from morphotab.functions.columns import key_struct
from morphotab.llm import kneser_ney
from morphotab.operators import selection
from morphotab.plans import measurement_view


def test_view_deals_lines_by_their_number(spark, tmp_path, monkeypatch):
    lines = [(p % 7, p % 5, 10.0 + p, 1.0 * (p % 3), p % 4, 0.01 * (p % 10), "F" if p % 2 else "O") for p in range(100)]
    tables = {
        "lineitem": (lines, "l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_linenumber int, l_discount double, l_linestatus string"),
        "part": ([(p, f"type {p % 2}", p) for p in range(7)], "p_partkey long, p_type string, p_size int"),
        "supplier": ([(s, s % 2) for s in range(5)], "s_suppkey long, s_nationkey int"),
        "nation": ([(0, 0), (1, 0)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "north")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    whole = measurement_view.measurement_view(spark, str(tmp_path)).collect()
    monkeypatch.setattr(measurement_view, "LINES", 9)
    view = measurement_view.measurement_view(spark, str(tmp_path))
    assert sorted(map(str, view.collect())) == sorted(map(str, whole)) and len(whole) > 50
    plan = view._jdf.queryExecution().executedPlan().toString()
    # 100 lines in 12 partitions of 9 lines, each time before they are grouped
    assert plan.count(", 12), REPARTITION_BY_NUM") >= 2


def test_selection_takes_fewer_bits_for_many_facets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(f), int(b)) for f, b in zip(rng.integers(0, 40, 3000), rng.integers(-(1 << 62), 1 << 62, 3000), strict=True)] + [(1, 5)] * 50
    df = spark.createDataFrame(rows, "f long, b long").select(key_struct(["f"]).alias("_key"), "f", "b").withColumnRenamed("b", "_bits")

    def found():
        got = selection.selected_keys(df, lambda n: {"first": n * 0 + 1, "third": n / 3 + 1}).collect()
        return sorted((r["_name"], r["_n"], r["_cell"]) for r in got)

    want = []
    for f in {f for f, _ in rows}:
        own = sorted(b for g, b in rows if g == f)
        want += [("first", len(own), own[0]), ("third", len(own), own[len(own) // 3])]
    assert found() == sorted(want)
    monkeypatch.setattr(selection, "CELLS", 1 << 10)
    assert selection._step(1) == 10 and selection._step(40) == 4 and found() == sorted(want)


def test_spellings_are_counted_in_small_slices():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{x:05d}" for x in rng.permutation(50_000)[:500]) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    (out,) = kneser_ney._count(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 4.5 MB of text; the counts of all n-grams take 42 MB
    assert peak < 130e6 and sum(out.column("c").to_pylist()) == sum(len(t) + 1 for t in texts)
