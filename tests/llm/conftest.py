import random

import pytest

WORDS = "ale bar cot dun elm fir gnu hat ink jet kit log mud nun oak pen quo rim sun tap urn vow wig yak zoo".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(7)
    text = prose(rng, 60)
    rows = [
        (1, text, "en", "a", 10),
        (2, text, "en", "a", 10),
        (2, text, "en", "a", 10),
        (3, text.upper(), None, None, None),
        (4, None, "en", "a", 0),
        (5, "", "en", "a", 0),
        (6, " \t\n\x0b ", "en", "a", 0),
        (7, prose(rng, 120_000), "en", "b", 10**6),
        (8, "İstanbul ǅ é \U0001d54f ﬁ   x", "tr", "b", 5),
        (9, "one", "en", "b", 3),
        (None, text, "en", "b", 3),
        (None, None, None, None, None),
        (10, "Line one here\n\nline two here\nline three here\n" * 2 + prose(rng, 9), "en", "b", 3),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    clash = {c: f"'{c}'" for c in "fp h key n at node root u v keep_id kept component_id slot shard size ids bucket place tie norm bytes part row w width words item_id gram line lines hits class_id digest score".split()}
    return docs.selectExpr("*", *[f"{v} AS {c}" for c, v in clash.items()])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture
def rng():
    return random.Random(11)
