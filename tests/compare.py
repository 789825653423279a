"""Run queries next to their SQL and report differences: python tests/compare.py [sf] [name ..]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    text = frame.astype(object).where(frame.notna(), None).map(lambda v: "" if v is None else repr(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for c in ours.columns:  # a column of integers with nulls comes as floats from one side
        if theirs[c].dtype.name == "Int64" and ours[c].dtype.name == "float64":
            ours = ours.assign(**{c: ours[c].astype("Int64")})
    kinds = {c: (ours[c].dtype.name, theirs[c].dtype.name) for c in ours.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if odd and len(ours):
        return f"types {odd}"
    a, b = canonical(ours), canonical(theirs)
    if not a.equals(b):
        wrong = (a != b).any(axis=1)
        return f"{int(wrong.sum())} rows differ\n{a[wrong].head(3)}\n{b[wrong].head(3)}"
    return None


def main():
    import __spark_entry__ as entry
    from postflow.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions="8",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            ours = queries[name](spark, folder).toPandas()
        except Exception as error:
            bad.append(name)
            print(f"{name}: FAILED {str(error)[:600]}", flush=True)
            continue
        seconds = time.time() - start
        if name not in oracle:
            print(f"{name}: {seconds:.1f}s, {len(ours)} rows, no SQL", flush=True)
            continue
        try:
            start = time.time()
            theirs = con.sql(oracle[name]).df()
            found = difference(ours, theirs)
        except Exception as error:
            found = f"SQL FAILED {str(error)[:600]}"
        if found:
            bad.append(name)
        print(f"{name}: {seconds:.1f}s (SQL {time.time() - start:.1f}s), {len(ours)} rows, {found or 'equal'}", flush=True)
    print("different:", bad or "none")


if __name__ == "__main__":
    main()
