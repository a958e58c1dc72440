import pytest


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    from mirrorline.llm.common import workers_import
    workers_import(spark)


#: Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows.
ODD = [
    (None, None, "x"), (None, "", "x"), (1, "", "x"), (2, "a", "y"), (2, "a", "y"), (3, "word " * 30000, "y"),
    (4, "Same text here, twice over.", None), (5, "Same text here, twice over.", None), (6, "äöü ñ 日本 🎉\n\n\t x", "z"), (None, "Same text here, twice over.", None),
]


@pytest.fixture()
def odd(spark):
    """Odd rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, s, -1, "clash") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words bigint, score string").repartition(2)


@pytest.fixture()
def empty(odd):
    return odd.limit(0)
