"""Run registered queries and compare them with their SQL twins: check_queries.py [sf] [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from assayer import catalog  # noqa: E402
from assayer.session import local_session  # noqa: E402

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for name in NAMES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(round(v, 5) + 0.0)
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name):
    start = time.time()
    df = catalog.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    sql = catalog.checks().get(name)
    if sql is None:
        return spent, len(rows), "rows-only" if rows else "EMPTY"
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    a, b = canonical(rows, df.columns), canonical(expected, expected_columns)
    if a[0] != b[0]:
        return spent, len(rows), f"COLUMNS {a[0]} vs {b[0]}"
    if len(a[1]) != len(b[1]):
        return spent, len(rows), f"ROWS {len(a[1])} vs {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if bad:
        return spent, len(rows), f"VALUES {len(bad)} differ, e.g. {a[0]} {bad[0]}"
    types_a = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types_b = {d[0]: str(d[1]) for d in cursor.description} if cursor.description else {}
    odd = [(c, types_a[c], types_b[c]) for c in a[0] if ("HUGEINT" in types_b[c]) or ("DECIMAL" in types_b[c]) or (types_a[c].startswith("decimal"))]
    return spent, len(rows), "ok" if rows else "ok-EMPTY", odd


if __name__ == "__main__":
    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    session = local_session("check", cores=8, partitions=8)
    con = connect(sf_dir)
    wanted = sys.argv[2:] or list(catalog.queries())
    failed = 0
    for name in wanted:
        try:
            result = compare(session, con, sf_dir, name)
        except Exception as exc:  # noqa: BLE001
            result = (0.0, 0, "ERROR " + str(exc).replace("\n", " ")[:1500])
        bad = not str(result[2]).startswith(("ok", "rows-only"))
        failed += bad
        print(f"{'FAIL' if bad else 'pass'} {name:34s} {result[0]:6.2f}s rows={result[1]} {' '.join(map(str, result[2:]))}", flush=True)
    print("failed", failed, "of", len(wanted))
