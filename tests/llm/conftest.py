import random

import pytest

SCHEMA = "doc_id long, text string, source string"
EXTRA = "doc_id long, text string, source string, n long, node long, label string, key long, part int, found string"


@pytest.fixture
def docs(spark):
    """Rows ``(doc_id, text[, source])`` as a table."""
    def build(rows, parts=3):
        return spark.createDataFrame([(*r, "s")[:3] for r in rows], SCHEMA).repartition(parts)
    return build


@pytest.fixture
def odd_docs(spark):
    """Null and empty values, ties, repeated rows, a long text, and columns with names used inside."""
    rows = [(None, None, None), (1, "", "a"), (2, " \t\n", None), (3, "one two three", "b"), (3, "one two three", "b"),
            (4, "x" * 50_000, "a"), (5, "word " * 20_000, "b"), (None, "null id here", "b"), (6, "é😀 ünï", "c")]
    return spark.createDataFrame([(*r, 1, 2, "l", 3, 4, "f") for r in rows], EXTRA)


@pytest.fixture
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def prose():
    """Sentences of invented words, some documents edited copies of others."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))
    out = [text(rng.randint(1, 120)) for _ in range(60)]
    passage = text(45)
    for i in range(40):
        near = rng.choice(out[:60]).split()
        for _ in range(rng.randint(0, 2)):
            near[rng.randrange(len(near))] = rng.choice(words)
        out.append(" ".join(near) if i % 3 else f"{text(8)} {passage} {text(5)}")
    out += [out[3], out[3], out[70].upper(), "", None, "a b", "a b", "b a"]
    return list(enumerate(out))
