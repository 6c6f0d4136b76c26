import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 900} the of" for i in range(20000))
    rows = [
        (None, "a b c", None, None), (3, None, "de", "s"), (3, "x y z", None, "s"), (3, "x y z", None, "s"), (1, "", "en", ""), (7, "   \n\t ", "en", "s"),
        (9, long, "en", "s"), (10, long + " tail", "en", "t"), (11, "123 — !? ١٢", "fr", "t"), (12, "Ünïcode straße × ÷ 日本 'tis don't", "de", None), (13, "one", "en", "s"),
    ]
    df = spark.createDataFrame([(*r, 5, 6, "h") for r in rows], "doc_id long, text string, lang string, source string, n long, row int, h string")
    return df.coalesce(2)
