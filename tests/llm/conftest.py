import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = DOCS + ", keep string, copy int, line string, host string, lines int, node string, label double, body string, cut string, level int, r int, h string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text, lang, source, n_chars) as documents."""
    return lambda rows: spark.createDataFrame([tuple(r) for r in rows], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and long texts, repeats, and extra columns whose names
    the operators use themselves."""
    prose = "the quick brown fox of the north and the lazy dog went to the river in spring and it was that day"
    rows = [
        (1, prose, "en", "a", len(prose)),
        (1, prose, "en", "a", len(prose)),
        (2, None, "en", "a", None),
        (3, "", "en", "a", 0),
        (4, " \n\t\n ", None, None, 5),
        (None, prose + " again", None, "b", 20),
        (None, None, None, None, None),
        (7, "word " * 60_000, "en", "b", 300_000),
        (8, "x" * 200_000, "xx", "b", 200_000),
        (9, "ééé ÄÖÜ 漢字かな 🙂 token = \"0123456789abcdef0123456789abcdef\"", "de", "c", 50),
        (10, "?!... --- ***", "fr", "c", 13),
    ]
    return spark.createDataFrame([(*r, "k", 1, "l", "h", 2, "n", 0.5, "b", "c", 3, 4, "hh") for r in rows], ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)
