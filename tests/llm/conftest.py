import os

import duckdb
import pytest


def doubled(a, b, joint=" ", steps=11):
    """Two texts of 2**steps symbols that collide under every polynomial hash modulo 2**64."""
    one, two = [a], [b]
    for _ in range(steps):
        one, two = one + two, two + one
    return joint.join(one), joint.join(two)


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture()
def table_dir(spark, tmp_path):
    """A function that writes a documents table and gives the folder."""

    def write(rows, schema="doc_id long, text string, lang string, source string, n_chars long", name="documents"):
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return write
