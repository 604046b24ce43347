from functools import reduce

from pyspark.sql import functions as F

from tracewell.plans.pipelines import stream_fingerprint

COLS = ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
ROWS = [(1, 10, "high", "F", 5.0), (2, 11, None, "O", 7.5), (2, 11, None, "O", 7.5), (3, 12, "low", None, None)]


def test_any_changed_row_changes_it(spark, tmp_path):
    def of(rows):
        d = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{d}/orders.parquet")
        r = stream_fingerprint(spark, d).first()
        hashes = [h for h, in spark.read.parquet(f"{d}/orders.parquet").select(F.xxhash64(*COLS, *[F.isnull(c) for c in COLS])).collect()]
        assert (r["n"], int(r["sum"]), r["mix"]) == (len(rows), sum(hashes), reduce(lambda a, b: a ^ b, hashes, 0))
        return tuple(r)

    first = of(ROWS)
    assert of(ROWS[::-1]) == first
    for k, value in ((0, 9), (2, "mid"), (3, "P"), (4, 5.1)):
        changed = [*ROWS[0]]
        changed[k] = value
        assert of([tuple(changed), *ROWS[1:]]) != first
    assert of([*ROWS[:3], (3, 12, None, "low", None)]) != first
    assert of([]) == (0, 0, 0)
