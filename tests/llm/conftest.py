import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "to", "ba", "di") for b in ("n", "r", "s", "t", "l", "m", "k", "p")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def corpus(seed=7):
    """Rows (doc_id, text, source): unique texts, exact and near copies, shared passages, odd rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    for _ in range(6):
        base = prose(rng, 120)
        for _ in range(5):
            words = base.split()
            for _ in range(rng.choice((0, 1, 2, 3, 6))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    passage = prose(rng, 70)
    texts += [prose(rng, rng.randint(0, 90)) + " " + passage + "\n" + prose(rng, rng.randint(0, 90)) for _ in range(8)]
    texts += [texts[0], texts[0], texts[45], "", " \n\t", "one", "one two three", "ONE two THREE", passage, prose(rng, 6000)]
    rng.shuffle(texts)
    rows = [(i * 3, t, rng.choice(("b", "a", "a", "ä", None))) for i, t in enumerate(texts)]
    return [*rows, (1, None, "a"), (None, texts[5], "a"), (None, None, None)]


@pytest.fixture(scope="session")
def documents(spark):
    """The corpus with extra columns whose names the operators also use."""

    def build(rows):
        full = [(i, t, "en", s, len(t or ""), 9, -1) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA + ", size long, root long")

    return build


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
