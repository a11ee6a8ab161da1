import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, partitions=3):
        full = [(*r, None, None, None)[:5] if len(r) == 2 else (*r, 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture
def clashing(spark):
    """Adds columns whose names the operators use themselves, and an odd one."""
    from pyspark.sql import functions as F

    names = "row key node label group size keep tag kept slot shard word at n tree page block start doc gram __id a.b".split()

    def add(df):
        return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])

    return add


@pytest.fixture
def prose():
    """Texts of made-up words, the same for the same seed."""

    def text(seed, n, letters="abcdefghij"):
        draw = random.Random(seed)
        return " ".join("".join(draw.choices(letters, k=draw.randint(2, 8))) for _ in range(n))

    return text


@pytest.fixture
def long_texts():
    """About 40 MB in 80 texts, more than four steps of a reading task; each text from 40 on is a near copy of one before."""
    draw, rows = random.Random(8), []
    for i in range(40):
        rows.append((i, " ".join(chr(65 + i % 26) + f"{draw.getrandbits(400):x}" for _ in range(5000 + i))))
    for i in range(40):
        words = rows[i][1].swapcase().split(" ") if i % 2 else rows[i][1].split(" ")
        for _ in range(i):
            words[draw.randrange(len(words))] = f"w{draw.getrandbits(30)}"
        rows.append((40 + i, " ".join(words)))
    return rows
