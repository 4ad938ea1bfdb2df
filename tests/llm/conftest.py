import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names an operator might use itself.
CLASH = ["row", "n", "size", "key", "label", "score", "host", "cluster", "shard", "taken", "p", "r", "a", "b", "item", "gone_row", "mix_row_text", "a.b", "two words", "ключ"]


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text, source) rows with the columns of documents and more of clashing names."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), *["x"] * len(CLASH)) for i, t, s in rows]
        return spark.createDataFrame(full, COLUMNS + "".join(f", `{c}` string" for c in CLASH)).repartition(3)

    return make


def words(n, seed=0, vocab=2000):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


@pytest.fixture
def odd(docs):
    """Null, empty, blank, tiny, very long and repeated texts, null keys and ties."""
    long = " ".join(words(60_000, 9, 50_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "a"), (5, long, "b"), (6, "x y z " * 40, "b"), (6, "x y z " * 40, "b"), (None, "no key here\nat all", None), (7, "Ünïcödé 文字 \U0001f600 text", "ü")]
    rows += [(100 + k, "\n".join(" ".join(words(12, 31 * k + j)) for j in range(8)), f"s{k % 3}") for k in range(12)]
    return docs(rows)
