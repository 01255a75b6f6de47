import pytest

LONG = "word " * 40_000 + "x" * 200_000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like the operators' own."""
    rows = [
        (1, "the cat sat on the mat\nand that was all of it for now and then", "a"),
        (1, "the cat sat on the mat\nand that was all of it for now and then", "a"),
        (2, "the cat sat on the mat\nand that was all of it for now and then", None),
        (3, None, "a"),
        (None, "a text without an id that is fairly short", "b"),
        (None, None, None),
        (4, "", "b"),
        (5, " \n\t ", "c"),
        (6, LONG, "a"),
        (7, "é ü mail a.b@example.com and +1 (938) 555-1226\nReleased under the MIT License.", "c"),
        (8, "###", ""),
    ]
    own = "size bigint, shard int, law string, slot bigint, pieces string, words string, id string, th bigint, c string, h string, key string, n int, n_chars int, target double, taken bigint, kept boolean, lines string, pass string, parts string, block string, hash string, ids string, copies int, labels string, spans string, url string, payload string"
    own += "".join(f", __{c} string" for c in "th n_words counts words lines grams kept id block own rid rth row key_hash hash bad uid size piece rank pieces input_0 input_1 w".split())
    names = [x.split(" ")[0] for x in own.split(", ")]
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], f"doc_id bigint, text string, source string, {own}")


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
