"""Driver contract and the DuckDB oracle at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

TABLES = ("documents labels conversations benchmark").split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["level", "direction", "num_examples", "num_scored_examples", "exact_match",
                          "token_f1", "chrf_like", "metrics_note"]
    assert df.count() >= 1


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["eval_summary", "sample_balanced_topup", "calibration_records", "prepare_stats",
                                  "compare_runs", "shuffle_order", "chat_examples", "row_index"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(SF_SMALL) / (t + '.parquet')}')")
    df = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(_n(r[c]) for c in cols) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(_n(row[i]) for i in idx) for row in res.fetchall()), key=str)
    assert sorted(got, key=str) == want


def _n(v):
    return round(v, 9) if isinstance(v, float) else v
