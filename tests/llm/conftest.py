import pytest
from samples import BASE, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, key long, words string"


@pytest.fixture(scope="session")
def frame(spark):
    return lambda data: spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def odd():
    """NULLs in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of {i}" for i in range(40_000))
    table = rows([BASE, BASE, BASE + " again", "", " \t\n", "x", long, "MIT License " + BASE, "«é» 中文   'll don't", "a\x00b"])
    table += [table[0], table[0]]  # repeated rows
    table += [(None, BASE, None, None, None, None, None, None, None), (40, None, None, None, None, None, None, None, None)]
    table += [(None, None, "en", None, 0, 1, "r", 2, "w")]
    return table
