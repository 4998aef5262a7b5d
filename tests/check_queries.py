"""Compare every query with its SQL: python tests/check_queries.py [folder] [name ...]."""

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        if (Path(folder) / f"{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def compare(spark, db, query, sql, folder):
    """Problem text, or None when columns and all rows agree; and the row count."""
    got = query(spark, folder)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(names)
    if sorted(got.columns) != order:
        return f"columns {sorted(got.columns)} != {order}", 0
    left = Counter(tuple(r[c] for c in order) for r in got.collect())
    place = [names.index(c) for c in order]
    right = Counter(tuple(r[i] for i in place) for r in result.fetchall())
    if left != right:
        return f"{(left - right).total()} rows only in Spark, {(right - left).total()} only in SQL; e.g. {list((left - right))[:2]} / {list((right - left))[:2]}", left.total()
    return None, left.total()


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pulsetally.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "check",
        "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls = connect(folder), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if name not in sqls or len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            problem, count = compare(spark, db, query, sqls[name], folder)
        except Exception as e:
            problem, count = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name} {count} rows {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("without SQL:", sorted(set(entry.queries()) - set(sqls)))
    sys.exit(bool(bad))
