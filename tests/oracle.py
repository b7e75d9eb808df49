"""A query's rows and its SQL's rows, in one comparable form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def both(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    ours = sorted(tuple(repr(r[c]) for c in names) for r in frame.collect())
    theirs = sorted(tuple(repr(v) for _, v in sorted(zip(columns, r, strict=True))) for r in found.fetchall())
    return ours, theirs
