"""Clusters of whole groups."""

import pyarrow as pa
import pyarrow.parquet as pq

from arborstream.plans.detection import QUERIES


def test_weights_add_up_to_the_rows_and_small_clusters_stay(spark, tmp_path):
    values = [float(i % 997) for i in range(5000)] + [1e6 + i for i in range(5)]
    nations = [1] * len(values) + [2] * 40
    values += [float(i % 2 * 1000) for i in range(40)]
    customer = {"c_custkey": list(range(len(values))), "c_nationkey": pa.array(nations, pa.int32()), "c_acctbal": values}
    pq.write_table(pa.table(customer), tmp_path / "customer.parquet")
    got = QUERIES["cluster_multi"](spark, str(tmp_path)).collect()
    weight = lambda n, low=-1.0: sum(r.weight for r in got if r.c_nationkey == n and r.representative > low)
    assert abs(weight(1) - 5005) < 1e-6 and abs(weight(2) - 40) < 1e-6
    assert abs(weight(1, 9e5) - 5) < 1e-6
    assert {(r.representative, round(r.weight)) for r in got if r.c_nationkey == 2} == {(0.0, 20), (1000.0, 20)}
