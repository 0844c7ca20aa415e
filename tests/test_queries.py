"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from pricelink.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_every_query_has_sql_or_its_own_test():
    alone = {"sequence_ratio", "similarity", "similarity_legacy", "best_candidates", "assignment", "comparison_fuzzy", "comparison_manual", "comparison_legacy", "ranking_fuzzy", "relations_fuzzy", "pair_sequence_ratio", "job_comparison"}
    assert set(QUERIES) - set(ORACLE_SQL) == alone
