import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, copy int, key string, rep long, ids binary, kept boolean, next string, keys string, fingerprint string"
#: Columns that operators use inside or return, as a table may have them too.
CLASH = (0.5, 7, "k", 9, b"x", False, "n", "ks", "f")


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    long = "\n".join(sentence(i, 40) for i in range(500))
    base = sentence("base", 200)
    near = base.replace(base.split()[50], "changed", 1)
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, near, "de", None), (4, None, None, "b"), (5, "", "en", "b"),
        (6, " \n\t ", "fr", "b"), (7, long, "fr", "c"), (8, "1234 5678 !!", None, "c"), (None, "some text with no id at all", "en", "c"),
        (9, "Éa ß ﬁ ½ \x1c\x85 'll don't <|endoftext|> 日本 …...\r\nword. word", "de", "c"), (10, "one", "en", "a"), (11, "One\n", "en", "a"),
        (12, sentence("other", 100).upper(), "en", None),
    ]
    return [(*t, len(t[1]) if t[1] else None, *CLASH) for t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
