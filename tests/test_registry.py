"""Registered queries on tables of this file's own."""

import itertools

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from lodewright.operators.staging import spread_runs
from lodewright.plans import registry


def test_means_between_two_decimals_are_rounded_by_sums_in_the_files_order(spark, tmp_path):
    n = 6400  # 32 parts a name: a mean of hundredths may end in half a millionth
    key = list(range(1, n + 1))
    name = ["q" + "abcdefghij"[k // 32 % 10] + "klmnopqrst"[k // 320 % 10] + "uv"[k // 3200 % 2] for k in range(n)]
    same = ["b"] * n
    pq.write_table(pa.table({"p_partkey": key, "p_brand": same, "p_name": name, "p_size": [1] * n, "p_type": same, "p_retailprice": [1.0] * n}), tmp_path / "part.parquet")
    found = {r.first_id: (r.merged_count, r.avg_confidence) for r in registry.QUERIES["norm_groups"](spark, str(tmp_path)).collect()}
    told, halves = {}, 0
    for first in range(1, n, 32):
        hundredths = [k % 101 if k % 4 >= 2 else 0 for k in range(first, first + 32)]
        total = 0.0
        for h in hundredths:
            total += h / 100.0
        told[first] = (32, float(int(total / 32 * 1e6 + 0.5)) / 1e6)
        halves += sum(hundredths) % 2
    assert halves > 10
    assert found == told


def test_runs_keep_the_order_of_a_file(spark, tmp_path):
    n = 400_000
    pq.write_table(pa.table({"k": range(n)}), tmp_path / "t.parquet")
    parts = spread_runs(spark.read.parquet(str(tmp_path / "t.parquet"))).rdd.map(lambda r: r.k).glom().collect()
    assert list(itertools.chain(*parts)) == list(range(n))
    assert sum(map(bool, parts)) == 4


def test_a_stage_with_two_rows_of_its_smallest_part_takes_the_first_output(spark, tmp_path):
    rows = []
    for order in range(40):  # two outputs of one part in either order, a part that is null, a flag that is null
        flags = ["R", "A"] if order % 2 else ["A", "R"]
        rows += [(order, 7, 1, flags[0]), (order, 7, 1, flags[1]), (order, 9, 2, "N"), (order, None, 2, "A"), (order, 3, 3, None), (order, 4, 3, "A"), (order, 1, 4, "A")]
        rows += [(order + 100, 5, 1, f) for f in flags]
    columns = dict(zip(("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), zip(*rows, strict=True), strict=True))
    pq.write_table(pa.table({k: pa.array(v, pa.string() if k == "l_returnflag" else pa.int32() if k == "l_linenumber" else pa.int64()) for k, v in columns.items()}), tmp_path / "lineitem.parquet")
    found = sorted(map(tuple, registry.QUERIES["stage_revert"](spark, str(tmp_path)).collect()))
    assert found == [(o, "-3-3", 3, 3) for o in range(40)] + [(o + 100, "A-1-5", 1, 1) for o in range(40)]
    duck = duckdb.connect()
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert sorted(duck.sql(registry.ORACLES["stage_revert"]).fetchall()) == found
