import pytest

#: Names the operators use inside; documents may have columns of the same names.
CLASHING = ["row", "order", "digest", "key", "n", "size", "bucket", "fp", "score", "scan_row", "taken", "sequence_id", "word"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with clashing extra columns."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
        data = [(i, t, lang, src, None if t is None else len(t), *CLASHING) for i, t, lang, src in full]
        return spark.createDataFrame(data, schema).coalesce(2)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, repeated rows, equal texts, one id with two texts, a long text, unusual characters."""
    long = "Long words " + " ".join(f"token{i % 977} and{i % 13}" for i in range(40_000))
    return [
        (1, "Hello there, World of words", "en", "a"),
        (2, "hello there, world of words", "en", None),
        (2, "hello there, world of words", "en", None),
        (3, None, None, "a"),
        (4, "", "fr", "b"),
        (5, " \t\n ", "fr", "b"),
        (None, "no id at all", "en", "c"),
        (None, None, None, None),
        (6, "one id", "de", "c"),
        (6, "with two texts", "de", "c"),
        (-7, "É accents stay, A-Z go down; ÀÉ <|endoftext|> 　 \U0001F600 ͸ 0 ٣ \x00 end", "fr", "b"),
        (8, long, "en", "a"),
        (9, long.upper(), "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts_by_id(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
