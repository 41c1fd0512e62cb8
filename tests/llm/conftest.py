import pytest

FOLDER = "/root/testdata/sf0.01"

LONG = "Über the résumé of 3 things, " * 8_000


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark):
    """All texts of the smallest documents by id."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {row.doc_id: row.text or "" for row in rows}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and further columns named like the operators' own."""
    rows = [
        (1, None, 5),
        (2, "", 5),
        (3, " \n\t ", 5),
        (4, "a", 5),
        (5, LONG, 5),
        (5, LONG, 5),
        (6, "word " * 30, 5),
        (7, "one two three four five six seven eight nine ten eleven twelve " * 2, 5),
        (None, "mail me at jo.do7@mail.example.com or +1 (555) 010-7788 now", 5),
        (None, None, 5),
        (8, "日本語 🎉 émigré  \x00 x ▁ y", 5),
    ]
    rows = [(i, t, n, "x", "y", True, 1, "z", [1], "u") for i, t, n in rows]
    schema = (
        "doc_id long, text string, n_chars long, lang string, source string, kept boolean, fp long, shard string, "
        "ids array<int>, _sig string"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def all_partitions(spark):
    """Shuffles keep their partitions, which Spark would merge where the rows are few."""
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    yield
    spark.conf.unset(merge)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
