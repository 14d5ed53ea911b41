"""p13_radius_join on many rows at few places and on odd rows, held against its SQL."""

import duckdb

from isoweave.operators import lines
from isoweave.plans import registry

NAME = "p13_radius_join"


def both(spark, folder, rows):
    """The query's rows and its SQL's on a table ``part`` of these rows."""
    con = duckdb.connect()
    con.sql(f"copy (select k::bigint as p_partkey, s::integer as p_size, p::double as p_retailprice from ({rows}) t(k, s, p)) to '{folder}/part.parquet' (format parquet)")
    con.sql(f"create view part as select * from '{folder}/part.parquet'")
    got = registry.queries()[NAME](spark, str(folder)).select("p_partkey", "n", "first").collect()
    return sorted(map(tuple, got), key=str), sorted(con.sql(registry.oracle_sql()[NAME]).fetchall(), key=str)


def test_rows_at_one_place_are_not_paired(spark, tmp_path, monkeypatch):
    met, within = [], lines.within

    def seen(*args, **more):
        met.append(within(*args, **more))
        return met[-1]

    monkeypatch.setattr(lines, "within", seen)
    got, want = both(spark, tmp_path, "select r, 5 + r % 4, 900 + r % 3 * 2 + 0.1 from range(1200) t(r)")
    assert got == want and len(got) == 1200
    assert 0 < sum(df.count() for df in met) <= 12 * 13


def test_odd_rows_are_those_of_the_sql(spark, tmp_path):
    near = "(1, 5, 10.2), (2, 5, 10.4), (2, 6, 11.6), (null, 5, 12.5), (null, 90, 3), (null, 90, 3), (3, null, 10), (4, 5, null), (5, 7, 8), (7, 2, 10), (8, -1, -0.4), (9, -2, -0.5), (8, -3, -1.5)"
    far = "(20, 5, 'nan'), (21, 5, 'inf'), (22, 5, 'inf'), (23, 5, '-inf'), (24, 5, '1e300'), (25, 5, '1e300'), (26, 5, '-1e300')"
    got, want = both(spark, tmp_path, " union all ".join(f"select k, s, p::double from (values {rows}) t(k, s, p)" for rows in (near, far)))
    assert got == want and {24, 25, 26} <= {r[0] for r in got}
    assert not {3, 4, 20, 21, 22, 23} & {r[0] for r in got}
