"""Side-by-side check of registered queries against DuckDB. Run as a script: oracle.py SF_DIR [name ...]."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return repr(v)
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted([tuple(_cell(r[n]) for n in names) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in cursor.fetchall()])


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    names, rows = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return None
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return f"columns {names} against {want_names}"
    if len(rows) != len(want):
        return f"{len(rows)} rows against {len(want)}: spark {rows[:2]} duckdb {want[:2]}"
    different = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(different)} of {len(rows)} rows differ, first {different[0]}" if different else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from populi.session import build_session
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", 8, spark__driver__memory="8g", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '}{name} {time.time() - start:.1f}s "
              f"{'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
