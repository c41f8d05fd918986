"""Run registered queries against DuckDB at one scale. Usage: oracle_check.py SF_DIR [name part ...]"""
import sys, time
sys.path.insert(0, "/root/repo")
import duckdb, pandas as pd, numpy as np


def frames_equal(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    cols = sorted(a.columns)

    def norm(df):
        out = {}
        for c in cols:
            s = df[c]
            if str(s.dtype).startswith(("Int", "UInt", "Float")):
                out[c] = s.map(lambda v: "NULL" if pd.isna(v) else repr(float(v)))
            elif s.dtype.kind in "f":
                out[c] = s.map(lambda v: "NULL" if pd.isna(v) else repr(float(v) + 0.0))
            elif s.dtype.kind in "iu":
                out[c] = s.map(lambda v: repr(float(v)))
            elif s.dtype.kind == "M":
                out[c] = s.map(lambda v: "NULL" if pd.isna(v) else str(pd.Timestamp(v)))
            else:
                def f(v):
                    if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT or v is pd.NA: return "NULL"
                    if hasattr(v, "isoformat"): return str(pd.Timestamp(v))
                    if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)): return repr(float(v))
                    return str(v)
                out[c] = s.map(f)
        return pd.DataFrame(out).sort_values(cols).reset_index(drop=True)

    x, y = norm(a), norm(b)
    diff = (x != y).any(axis=1)
    if diff.any():
        m = pd.merge(x, y, how="outer", indicator=True)
        bad = m[m["_merge"] != "both"].sort_values(cols)
        return f"{int(diff.sum())} rows differ\n{bad.head(8).to_string()}"
    return None


def duck(sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from hazegrid.session import build_session
    import __spark_entry__ as e
    sf = sys.argv[1]; parts = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress":"false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if parts and not any(p in name for p in parts): continue
        t = time.time()
        try:
            a = fn(spark, sf)
            schema = a.schema
            a = a.toPandas()
        except Exception as ex:
            print(f"ERR  {name}: {str(ex)[:900]}", flush=True); bad += 1; continue
        dt = time.time() - t
        if name not in sqls:
            print(f"rows {name}: {len(a)} rows {dt:.2f}s", flush=True); continue
        t = time.time()
        try:
            rel = con.execute(sqls[name]); b = rel.df()
        except Exception as ex:
            print(f"SQLERR {name}: {str(ex)[:900]}", flush=True); bad += 1; continue
        msg = frames_equal(a, b)
        kinds = [f"{c}:{a[c].dtype}/{b[c].dtype}" for c in a.columns if c in b.columns and a[c].dtype.kind != b[c].dtype.kind]
        print(f"{'OK  ' if not msg else 'BAD '} {name}: {len(a)} rows {dt:.2f}s (duck {time.time()-t:.2f}s) {kinds or ''} {msg or ''}", flush=True)
        bad += bool(msg)
    print("bad:", bad)
