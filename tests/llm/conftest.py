import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, text_hash long, digest string, _pii int, size int"


@pytest.fixture
def documents(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def make(texts, ids=None, sources=None):
        n = len(texts)
        ids, sources = ids or list(range(n)), sources or ["s"] * n
        rows = [(i, t, "en", s, None if t is None else len(t), True, 1, "d", 2, 3) for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


LONG = " ".join(f"w{i * i % 9973}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(80))
ODD = [
    None,
    "",
    " \t\n",
    "one",
    "one two",
    "ONE  two",
    LONG,
    LONG,
    "a " * 5000,
    "x" * 200_000,
    f"before {PASSAGE} after",
    f"{PASSAGE} and more of it",
    "naïve İstanbul   ﬁ é ​ ẞ Σίσυφος 中文 😀 <|endoftext|> \x00 \x1c end",
    "  leading and trailing  \n\n",
]


@pytest.fixture
def odd(documents):
    """Null, empty, blank, tiny, very long, repetitive and unusual texts; two rows are repeated whole, one has no doc_id."""
    texts = [*ODD, "one two", LONG, "nobody's text"]
    ids = [*range(len(ODD)), 4, 6, None]
    return documents(texts, ids)


@pytest.fixture
def none(documents):
    """An empty table."""
    return documents(["x"]).filter("doc_id < 0")
