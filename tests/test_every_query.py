"""Every registered query runs on empty tables and on tables with an all-null row and columns of clashing names."""

import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
#: Names that operators use inside; given tables may hold columns of the same names.
CLASHING = ["rank", "n", "score", "key", "at", "place", "symbol", "length", "cluster", "state", "depth", "_k"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def made(folder, change):
    for f in os.listdir(DATA):
        pq.write_table(change(pq.read_table(f"{DATA}/{f}")), f"{folder}/{f}")
    return str(folder)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return made(tmp_path_factory.mktemp("empty"), lambda t: t.slice(0, 0))


@pytest.fixture(scope="module")
def dirty(tmp_path_factory):
    def change(t):
        nulls = pa.table({c.name: pa.nulls(1, c.type) for c in t.schema}, schema=t.schema.remove_metadata())
        t = pa.concat_tables([t.replace_schema_metadata(None), nulls, nulls])
        for c in CLASHING:
            if c not in t.column_names:
                t = t.append_column(c, pa.array([c] * len(t)))
        return t

    return made(tmp_path_factory.mktemp("dirty"), change)


def ran(spark, name, folder):
    df = entry.queries()[name](spark, folder)
    df.write.format("noop").mode("overwrite").save()
    return df


@pytest.mark.parametrize("name", list(entry.queries()))
def test_empty_tables(spark, name, empty):
    ran(spark, name, empty)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_nulls_and_clashing_columns(spark, name, dirty):
    ran(spark, name, dirty)
