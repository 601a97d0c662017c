"""Fixtures: a table of odd rows, and an empty one."""
import pytest

SF = "/root/testdata/sf0.001"

ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, row_ string, d int, f int, score string, keep int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, repeated rows and ids, odd texts, columns named like ours."""
    long = "very long " * 30000 + "end"
    texts = [None, "", " ", "\n\n", "one", "one two", "same line here\nother line\nsame line here", "same line here\nother line",
             "same line here\nother line", "🙂 ünïcode ßtuff\x00\x01", long, long, "tab\tand\x0bvt\x0c\r\n x"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t), i, "x", 1, 2, "y", 3)
            for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id at all, none", None, None, None, None, None, None, None, None, None),
             (6, "another text with id six", "de", "s", 24, 1, "x", 1, 2, "y", 3)]
    return spark.createDataFrame(rows, ODD).repartition(4).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD)
