import pytest

from edge_rows import SCHEMA, VECTORS, rows, vectors


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_dir(spark, edge, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edge"))
    edge.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (5, None, None), (None, 1, 1), (99, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(vectors(), VECTORS).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, nothing, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    nothing.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{d}/embeddings.parquet")
    return d
