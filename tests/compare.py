"""Row-by-row comparison of a Spark result with its checking SQL."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), v) if not isinstance(v, bool) else (False, "bool", v) for v in row))


def differences(spark_df, connection, sql):
    """Empty when both sides agree; otherwise a short description."""
    result = connection.execute(sql)
    names = [item[0] for item in result.description]
    wanted = normal_rows(names, result.fetchall())
    found = normal_rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(names)} != {sorted(spark_df.columns)}"
    if len(wanted) != len(found):
        return f"{len(found)} rows, wanted {len(wanted)}"
    for left, right in zip(found, wanted):
        if left != right:
            return f"found {left}, wanted {right}"
    return ""
