"""Compare a query with its SQL on one set of tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """A DuckDB connection with one view per table of ``folder``."""
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def differences(spark: SparkSession, connection, folder: str, name: str) -> list[str]:
    """What differs between the query ``name`` and its SQL; empty if nothing."""
    ours = QUERIES[name](spark, folder).toArrow()
    theirs = connection.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    if columns != sorted(theirs.column_names):
        return [f"columns {columns} against {sorted(theirs.column_names)}"]
    found = []
    for column in columns:
        kinds = [str(t.field(column).type).removeprefix("large_") for t in (ours, theirs)]
        if kinds[0] != kinds[1]:
            found.append(f"{column} is {kinds[0]} against {kinds[1]}")
    rows = [
        Counter(zip(*(t.column(column).to_pylist() for column in columns)))
        for t in (ours, theirs)
    ]
    if rows[0] != rows[1]:
        only = [(rows[0] - rows[1]), (rows[1] - rows[0])]
        found.append(f"{ours.num_rows} against {theirs.num_rows} rows")
        found += [f"only {who}: {list(c.items())[:3]}" for who, c in zip(("ours", "theirs"), only)]
    return found
