import random

import pytest

#: An extra column of each kind that operators use inside.
CLASHES = "size int, uid long, key string, c long, bin string, n int, unit int, item int, k0 int, p0 int, g int, u int, toxicity string, score string, part string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
TAIL = (1, 2, "k", 3, "b", 4, 5, 6, 7, 8, 9, 10, "t", "s", "p")


def prose(rng: random.Random, words: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


def rows():
    """Nulls, empty and long texts, exact and near copies, repeated rows, ties, odd characters."""
    rng = random.Random(1)
    base = prose(rng, 300)
    near = base.split()
    near[10] = "changed"
    out = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"), (8, "one two"), (9, "ONE\ttwo"), (10, prose(rng, 60_000))]
    out += [(i, prose(rng, rng.randrange(5, 200))) for i in range(11, 60)]
    out += [(60, "!!! ??? 123"), (61, "naïve café été 中文 🙂 İstanbul"), (62, "x" * 5000), (7, "one two")]
    docs = [(i, t, None if i % 9 == 0 else "en", None if i % 13 == 0 else f"s{i % 3}" if i % 2 else "hot", None, *TAIL) for i, t in out]
    docs.append((None, "a text without an id of its own here", "en", "hot", 3, *TAIL))
    docs.append((None, None, None, None, None, *TAIL))
    return docs


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
