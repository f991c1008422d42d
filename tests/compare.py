"""A registered query against its SQL, on the same tables."""

import math

import duckdb

from lodeseek.schemas import TABLES


def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canonical(row[i]) for i in order) for row in rows)


def compare(spark, connection, query, sql, sf_dir):
    """None when equal, else what differs."""
    result = query(spark, sf_dir)
    got = rows_of(result.columns, [tuple(r) for r in result.collect()])
    reply = connection.execute(sql)
    names = [d[0] for d in reply.description]
    expected = rows_of(names, reply.fetchall())
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} and {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    if not got:
        return "no rows"
    different = [(g, e) for g, e in zip(got, expected) if g != e]
    if different:
        return f"{len(different)} of {len(got)} rows differ, first {different[0]}"
    return None
