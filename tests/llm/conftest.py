import pytest
from texts import paragraphs, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version long, content string, leader string, start long, probability double, fingerprint string, kept boolean, hash long, _tokens int, _version string, _quality int, _mix int, _cell string, _of int, _share double, _id string"


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls, blanks, copies that differ in white space, near copies, shared passages, repeated rows and a long text."""
    base = [paragraphs(i, 6) for i in range(12)]
    passage = words(999, 60)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[0]), (21, base[0].replace(" ", "  ")), (22, base[0].replace("\n", " \t\r\n")), (19, base[1] + " "), (23, base[2].replace(".", "!", 1))]
    out += [(30 + i, words(500 + i, 30) + " " + passage + " " + words(600 + i, 30)) for i in range(4)]
    out += [(40, None), (41, ""), (42, " \n\t "), (43, "a"), (44, "Ä ö ü ß 日本 😀 é"), (45, "x" * 70), (46, "x" * 120), (47, "  mixed\x1cwhite")]
    out += [(50, base[3]), (50, base[3]), (51, base[4]), (51, "another text under the same id"), (None, base[5]), (60, words(7, 12_000)), (61, words(7, 12_000) + " end"), (62, "Re " * 3000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    langs, sources = ["en", "de", None], ["a", "a", "b", None]
    data = [(d, t, langs[i % 3], sources[i % 4], len(t or ""), 1, "c", "l", 5, 0.5, "f", True, 9, 77, "v", 3, 4, "c", 6, 0.1, "i") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
