import pytest

WORDS = "the river runs under old bridges while quiet boats carry letters between distant towns and nobody counts the hours"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    long = " ".join(f"{WORDS} {k}" for k in range(6000))
    rows = [
        (1, WORDS, "en", "a"), (2, WORDS, "en", "a"), (2, WORDS, "en", "a"), (3, WORDS.upper(), None, "b"), (4, None, None, None), (5, "", "en", "b"), (6, " \n\t ", "de", None), (7, "12 !! 34", "de", "b"),
        (8, long, "en", "a"), (9, long + " more", "en", "a"), (10, "Der Fluss fließt unter alten Brücken, während stille Boote Briefe tragen", "de", "b"), (11, "one", "en", "b"), (12, "One", "en", "b"),
        (13, "naïve café <|endoftext|> 東京。 😀\x00 end", "fr", "b"), (14, WORDS + " indeed", "en", "a"),
    ]
    extra = ["ids", "score", "kept", "rep", "hub", "n", "norm", "digest", "locator", "held_out", "tokens", "probability", "topic2", "sig", "row", "key", "mixture", "lang_pred"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in extra)
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame([(*r, None, *["clash"] * len(extra)) for r in rows], schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(odd):
    """The same columns without a row."""
    return odd.where("doc_id < 0")
