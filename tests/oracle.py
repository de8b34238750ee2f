"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py [sf] [query ...]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from sigspark.session import local_session  # noqa: E402

ROOT = "/root/testdata"


def connect(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, con, name, sf_dir):
    """Empty text when both sides agree exactly, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    want_cols, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL gives {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if any(
        a != b and not (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))
        or type(a) is not type(b) for a, b in zip(g, w))]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{ROOT}/sf{sf}"
    spark, con = local_session(8, "oracle"), connect(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    sql, failed = entry.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            if name in sql:
                state = compare(spark, con, name, sf_dir)
            else:
                state = f"no SQL, {entry.queries()[name](spark, sf_dir).count()} rows"
        except Exception as e:  # report and go on
            state = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        failed += bool(state) and not state.startswith("no SQL")
        print(f"{name:28s} {time.time() - start:6.2f}s {state or 'same'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
