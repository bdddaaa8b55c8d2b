import pytest

LONG = "lorem ipsum dolor " * 30_000
EDGE = [
    (1, "under the MIT license a b c d e f"), (2, None), (3, ""), (None, "no id here, none"), (5, LONG), (5, "same id, other text"), (6, "under the MIT license a b c d e f"),
    (6, "under the MIT license a b c d e f"), (7, " \n\t "), (8, "日本語 のテキスト 😀 <|endoftext|>"), (9, "that it."), (10, "\x00\x1c\x85 É's Ñ ²3"), (11, LONG),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, file_key string, fp int, score string, label string, `__score` string, sequence_id string, host string"


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and extra columns whose names clash."""
    rows = [(i, t, None, None, None, "d", "f", 0, "s", "l", "x", "q", "h") for i, t in EDGE]
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def memory_edge(spark):
    """The same rows, not of files."""
    return spark.createDataFrame([(i, t, None, None, None, "d", "f", 0, "s", "l", "x", "q", "h") for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
