"""Nearest vectors: all of them ask, whatever their ids, and copies and vectors without a length stand as the SQL has them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from compare import TABLES, rows

from stratascope.operators import neighbours
from stratascope.plans import catalogue


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("vectors"), np.random.default_rng(4)
    v = rng.normal(size=(60, 64)).astype(np.float32)
    v[7:21], v[33], v[34] = v[3], 0, 0  # more copies of one vector than a query has neighbours, and two without a length
    v[40] = v[41] * 2
    pd.DataFrame({"vec_id": np.arange(60) * 7 + 1, "embedding": list(v), "label": 0}).to_parquet(folder / "embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["nearest_by_cosine", "mutual_knn_alignment"])
def test_all_vectors_ask(spark, table, name):
    import duckdb

    assert "embeddings" in TABLES
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{table}/embeddings.parquet'")
    got, want = catalogue.queries()[name](spark, str(table)).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
    assert got["id"].nunique() == 60 if name == "nearest_by_cosine" else got["points"][0] == 60


def test_blocks_of_any_size_find_the_same(spark, table):
    v = spark.read.parquet(f"{table}/embeddings.parquet")
    found = [rows(neighbours.similarities(v, v.where("vec_id % 2 = 0"), "vec_id", "embedding", 4, block=b).toPandas()) for b in (3, 4096)]
    assert found[0] == found[1] and len(found[0]) == 4 * 30


def test_a_missing_vector_is_not_passed_over(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, 0.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="a vector is missing"):
        neighbours.similarities(v, v, "id", "v", 1).collect()
