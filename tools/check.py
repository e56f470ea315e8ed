"""Compare registered queries with their DuckDB text: names, types, rows, values."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

from tallyframe.session import build_session  # noqa: E402
from tallyframe.catalog import oracle_sql, queries  # noqa: E402


def family(name: str) -> str:
    low = name.lower()
    if low.startswith(("int", "bigint", "long", "smallint", "tinyint", "hugeint", "integer", "ubigint")):
        return "int"
    if low.startswith(("float", "double")):
        return "double"
    if low.startswith(("string", "varchar")):
        return "string"
    if low.startswith("timestamp"):
        return "timestamp"
    if low.startswith("bool"):
        return "bool"
    return low


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return v
    return str(v)


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:]
    data = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = queries(), oracle_sql()
    picked = [q for q in qs if not names or any(q.startswith(n) for n in names)]
    bad = 0
    for q in picked:
        t0 = time.time()
        try:
            df = qs[q](spark, data)
            rows = [r.asDict(recursive=False) for r in df.collect()]
            t1 = time.time() - t0
            if q not in sqls:
                print(f"rows  {q:28s} {len(rows):7d} {t1:6.2f}s {df.dtypes if len(rows) == 0 else ''}")
                continue
            rel = con.sql(sqls[q])
            cols = rel.columns
            left_types = {n: family(t) for n, t in df.dtypes}
            right_types = {n: family(str(t)) for n, t in zip(cols, rel.types)}
            want = rel.fetchall()
            keys = sorted(cols)
            problem = ""
            if sorted(df.columns) != keys:
                problem = f"columns {sorted(df.columns)} != {keys}"
            elif left_types != right_types:
                problem = f"types { {k: (left_types[k], right_types[k]) for k in keys if left_types[k] != right_types[k]} }"
            if sorted(df.columns) == keys:
                a = sorted((tuple(norm(r[k]) for k in keys) for r in rows), key=repr)
                b = sorted((tuple(norm(dict(zip(cols, r))[k]) for k in keys) for r in want), key=repr)
                if a != b:
                    sa, sb = set(a), set(b)
                    problem += (f" rows {len(a)} vs {len(b)}\n   keys   {keys}"
                                f"\n   spark  {sorted(sa - sb, key=repr)[:3]}\n   duckdb {sorted(sb - sa, key=repr)[:3]}")
            bad += bool(problem)
            print(f"{'FAIL ' if problem else 'ok   '} {q:28s} {len(rows):7d} {t1:6.2f}s {problem}")
        except Exception as exc:
            bad += 1
            print(f"ERROR {q:28s} {type(exc).__name__}: {str(exc)[:700]}")
            if "-v" in sys.argv:
                traceback.print_exc()
        sys.stdout.flush()
    print("bad:", bad, "of", len(picked))
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
