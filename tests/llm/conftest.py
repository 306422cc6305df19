"""Small inputs with the odd cases that every operator must stand."""

import pytest

SF = "/root/testdata/sf0.001"
CLASHING = "ids string, key long, node string, label string, row string, start long, kept string, bands string, group string"

PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old tree near the river "


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, repeated rows, ties."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \n\t \x0b ", "en", None),
        (4, PROSE * 2 + "one", "en", "a"),
        (5, PROSE * 2 + "one", "en", "b"),
        (5, PROSE * 2 + "one", "en", "b"),
        (None, PROSE + "two", "en", "b"),
        (None, None, None, None),
        (7, long, "en", ""),
        (8, "three words only", "en", "a"),
        (9, "Three WORDS only", "en", "a"),
        (10, "über straße naïve café 　 x y 你好 🙂🙂", "de", "c"),
        (11, "x", "fr", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names operators use themselves."""
    extra = ("z", 1, "z", "z", "z", 2, "z", "z", "z")
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    rows = [(*r, len(r[1]) if r[1] is not None else None, *extra) for r in odd_rows]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    """An empty table."""
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
