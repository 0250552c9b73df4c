import pytest

#: Rows that every operator on documents has to bear: nulls, empty and blank texts, copies, repeated rows, a long
#: text, a null id, and columns whose names are those of results and inner columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, fp long, row string, size int, n_words string, component int, removed string, score string, _text string, _null string, absent string, spans string, class int, bits int"
LONG = "the quick brown fox jumps over lazy dogs " * 3000


def odd_rows():
    texts = [None, "", " \n\t ", "One two three four five six seven.", "One two three four five six seven.", LONG, "ÀÉ ñ ß Ω 漢字", "\x00\x01 nul", "!!! ??? ...", "a"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    return [(*r, "x", 1, "y", 2, "z", 3, "q", "p", "t", "u", "v", "w", 4, 5) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def small(spark):
    from ..conftest import SMALL

    return spark.read.parquet(f"{SMALL}/documents.parquet")
