import random

import pytest

from synthtab.llm.common import ship
from synthtab.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, label string, id long, key long, gone string, body string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with further columns whose names operators use themselves."""
    ship(spark)

    def build(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 1, "x", 2, 3, "g", "b") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def words_file():
    return vocabulary()


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "ri", "su", "ten", "é", "Mo"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Null, empty, white, short, long, repeated and strange texts; null and repeated ids."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, long), (7, long), (8, long + " end"),
        (9, "x" * 3000), (10, "Straße ΑΣ İ ½ ² <|endoftext|>it's"), (10, "Straße ΑΣ İ ½ ² <|endoftext|>it's"), (10, "another text of this id"),
        (None, "a text without an id"), (None, None), (11, "日本語 🙂 \x1c \x85 a\u00a0b"), (12, "a  b\tc\n\nd"), (13, "a b c d"),
        (14, sentence(rng, 40)), (15, "\n".join([sentence(rng, 8)] * 5)),
    ]
