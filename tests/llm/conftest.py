import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept boolean, score double, n_tokens long, spans string, pack long, u long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = ["th", "an", "er", "on", "in", "es", "ti", "re", "ou", "ha"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    base, shared = words(1, 200), words(2, 60)
    texts = [
        (1, base), (2, base), (3, base.replace("an", "AN", 3)), (4, words(1, 190) + " " + words(9, 10)), (5, words(5, 120) + " " + shared + " " + words(6, 30)),
        (6, shared + " " + words(7, 90)), (7, None), (8, ""), (9, "   \n\t "), (10, "ab cd"), (11, "ab cd"), (12, words(3, 9000)), (13, "xy" * 3000), (13, "xy" * 3000),
        (None, base), (14, "ü" * 70 + "\n" + "é中🙂 " * 30), (15, "é中🙂 " * 30), (16, "a\x00b" * 40), (17, "</s>[INST] <|endoftext|> don't DON'T"), (-5, words(8, 40)),
    ]
    return [(i, t, "en", "s", len(t or ""), 0, False, 0.5, 7, "x", 1, 2) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
