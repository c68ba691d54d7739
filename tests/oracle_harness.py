"""Local re-creation of the driver's correctness gate.

Runs each Spark query and its DuckDB oracle on the same parquet files and
compares column names, row counts and the order-insensitive multiset of
rows (exactly, and with a 1e-9 relative tolerance on floats).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, tol: bool):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (pd.Timestamp, dt.datetime, dt.date)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if tol:
            return float(f"{v:.9g}")
        return v
    if hasattr(v, "item"):
        return _norm(v.item(), tol)
    return v


def _kind(s: pd.Series) -> str:
    if s.isna().all():
        return "null"
    k = s.dtype.kind
    if k == "O":
        v = s.dropna().iloc[0]
        return type(v).__name__
    return {"i": "int", "u": "int", "f": "float", "M": "datetime", "b": "bool"}.get(k, k) + str(s.dtype.itemsize)


def rows(df: pd.DataFrame, tol: bool) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c], tol) for c in cols) for _, r in df[cols].iterrows()]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


SPARK_TYPES = {"LongType": "int64", "IntegerType": "int32", "DoubleType": "double", "StringType": "string",
               "TimestampNTZType": "timestamp", "BooleanType": "bool", "DateType": "date", "ShortType": "int16",
               "ByteType": "int8", "FloatType": "float"}
DUCK_TYPES = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "string",
              "TIMESTAMP": "timestamp", "BOOLEAN": "bool", "DATE": "date", "SMALLINT": "int16",
              "TINYINT": "int8", "FLOAT": "float", "HUGEINT": "int128"}


def engine_types(spark_schema, duck_rel) -> dict:
    """Column -> (spark type, duckdb type) where they differ."""
    s = {f.name: SPARK_TYPES.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in spark_schema.fields}
    d = {}
    for name, t in zip(duck_rel.columns, duck_rel.types):
        t = str(t)
        d[name] = DUCK_TYPES.get(t, "decimal" if t.startswith("DECIMAL") else t)
    return {c: (s[c], d[c]) for c in s if c in d and s[c] != d[c]}


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> dict:
    res = {
        "cols_match": sorted(spark_pdf.columns) == sorted(duck_pdf.columns),
        "rows_spark": len(spark_pdf), "rows_oracle": len(duck_pdf),
    }
    res["rows_match"] = res["rows_spark"] == res["rows_oracle"]
    if res["cols_match"]:
        a, b = rows(spark_pdf, False), rows(duck_pdf, False)
        res["exact"] = a == b
        ta, tb = rows(spark_pdf, True), rows(duck_pdf, True)
        res["tolerant"] = ta == tb
        if not res["tolerant"]:
            sa, sb = set(ta), set(tb)
            res["only_spark"] = list(sa - sb)[:3]
            res["only_oracle"] = list(sb - sa)[:3]
    else:
        res["spark_cols"] = sorted(spark_pdf.columns)
        res["oracle_cols"] = sorted(duck_pdf.columns)
    return res


def run_all(spark, sf_dir: str, keys=None, verbose=True) -> dict[str, dict]:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for key in keys or list(qs):
        try:
            sdf = qs[key](spark, sf_dir)
            sp = sdf.toPandas()
        except Exception as ex:  # noqa: BLE001
            out[key] = {"error": f"spark: {type(ex).__name__}: {str(ex)[:400]}"}
            if verbose:
                print(key, out[key], flush=True)
            continue
        if key not in sqls:
            out[key] = {"rows_spark": len(sp), "oracle": None}
        else:
            try:
                dk = con.execute(sqls[key]).fetchdf()
            except Exception as ex:  # noqa: BLE001
                out[key] = {"error": f"duckdb: {type(ex).__name__}: {str(ex)[:400]}", "rows_spark": len(sp)}
                if verbose:
                    print(key, out[key], flush=True)
                continue
            out[key] = compare(sp, dk)
            diff = engine_types(sdf.schema, con.sql(sqls[key]))
            if diff:
                out[key]["dtype_diff"] = diff
        if verbose:
            print(key, out[key], flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from deliverix.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = get_session()
    res = run_all(spark, sf, keys)
    bad = [k for k, v in res.items() if not (v.get("exact") or v.get("oracle", 1) is None)]
    print("NOT EXACT:", bad)
