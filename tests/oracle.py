"""Comparison of a registered query with its SQL, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def database(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    return value


def differences(spark, sf_dir, name, queries, oracles):
    """Empty when rows and columns agree, else a short account."""
    got = queries[name](spark, sf_dir)
    columns = sorted(got.columns)
    mine = sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    cursor = database(sf_dir).execute(oracles[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    place = [names.index(c) for c in columns]
    theirs = sorted((tuple(_plain(r[i]) for i in place) for r in cursor.fetchall()), key=repr)
    if mine == theirs:
        return ""
    a = [r for r in mine if r not in theirs][:2] if len(mine) < 20000 else mine[:2]
    b = [r for r in theirs if r not in mine][:2] if len(mine) < 20000 else theirs[:2]
    return f"{len(mine)} rows against {len(theirs)}; {columns} {a} {b}"
