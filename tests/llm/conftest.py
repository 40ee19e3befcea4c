from pathlib import Path

import pytest

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))


#: Cases that every operator must take: nulls, nothing, long runs, repeated rows, odd characters.
ODD = [(1, None), (2, ""), (3, "a" * 30_000), (4, "same text of a few words here"), (4, "same text of a few words here"), (5, "same text of a few words here"), (None, "no id but some words in it"), (6, " \n\t \x0b"), (7, "1" * 20_000), (8, "naïve 漢字 😀 \x00   end"), (9, "word " * 5_000), (10, "a <|endoftext|> in it<|endoftext|>")]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), i, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid long, word string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
