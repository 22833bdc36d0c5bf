import random

import duckdb

from cohortry.operators import quantiles


def test_quantiles_are_duckdbs_to_the_last_bit(spark):
    """A value may lie exactly between two quantiles: which side it falls on is decided by their last bit."""
    rnd = random.Random(4)
    rows = [(g, round(rnd.gauss(0, 0.125), 4)) for g in range(300) for _ in range(64)] + [(300, 1.0), (301, float("-inf")), (301, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    at = [0.01, 0.5, 0.95, 0.99]
    con = duckdb.connect()
    con.sql("create table t(g int, v double)")
    con.executemany("insert into t values (?, ?)", rows)
    want = {r[0]: list(r[1:]) for r in con.sql(f"select g, {', '.join(f'quantile_cont(v, {p})' for p in at)} from t group by g").fetchall()}
    for small in (1 << 20, 50):
        got = {r["g"]: r["quantiles"] for r in quantiles.exact_quantiles(df.where("g < 20 or g > 299") if small == 50 else df, ["g"], at, "v", small).collect()}
        assert all(got[g] == want[g] for g in got if g != 301) and got[301][0] == float("-inf")
