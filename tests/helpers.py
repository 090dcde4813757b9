import datetime
import math
from pathlib import Path

import duckdb

from mathloom.runtime import ship

FOLDER = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def compare(spark, name, query, sql):
    ship(spark)
    df = query(spark, str(FOLDER))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan, name
    columns = sorted(df.columns)
    rows = df.select(*(f"`{c}`" for c in columns)).collect()
    if sql is None:
        return rows
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns, name
    wanted = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(map(plain, r))) for r in rows), name
    return rows
