import glob
import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from riskweave.catalog import QUERIES

# one of each family; tools/check_oracle.py compares all of them
CHECKED = [
    "a2_review_curve",
    "a6_policy_outcome",
    "a11_average_precision",
    "a17_calibration_error",
    "d4_drift_report",
    "j6_metric_mismatches",
    "l1_level_summary",
    "p1_temporal_grouped_split",
    "p6_rolling_folds",
    "s2_headline_bootstrap",
    "src1_creditcard_csv",
    "w1_stream_velocity_ties",
    "w2_entity_velocity",
]


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, nan_ok=True) if all(
            isinstance(v, (int, float)) for v in a
        ) else a == b


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 8 and "recall_auto" in df.columns


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(QUERIES) <= set(queries)


SURVEYED = {
    "SRC": 8, "SNK": 5, "F": 13, "P": 10, "W": 8, "J": 12, "A": 28, "M": 16, "S": 8, "D": 8,
    "L": 12, "T": 3, "X": 6, "R": 5,
}


def test_inventory_is_covered():
    """Every surveyed operator has a query of its own."""
    wanted = [f"{p.lower()}{i}" for p, n in SURVEYED.items() for i in range(1, n + 1)]
    wanted += ["o11", "o12", "o13", "o14", "u1"]
    have = {name.split("_")[0] for name in entry.queries()}
    assert sorted(set(wanted) - have) == []
