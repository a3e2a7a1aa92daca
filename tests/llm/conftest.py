import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as further columns of the table.
CLASHES = ["id", "n", "part", "size", "comp", "set", "spans", "rows", "shard", "_id", "_n", "_gone", "_bad", "line", "cell", "v", "taken", "target", "score"]


def prose(rnd: random.Random, n: int) -> str:
    words = [rnd.choice("abcdefghij") * rnd.randrange(1, 3) + rnd.choice(["an", "el", "or", "um", "ix"]) + str(rnd.randrange(40)) for _ in range(n)]
    return " ".join(w + (rnd.choice([".", "\n", ","]) if rnd.random() < 0.12 else "") for w in words)


def odd_documents() -> list[tuple]:
    """Copies exact and near, ties, nulls anywhere, empty and blank texts, a very long one, repeated rows and ids."""
    rnd = random.Random(5)
    base = [prose(rnd, rnd.randrange(1, 160)) for _ in range(40)]
    texts = base + base[:6] + [t.replace(" ", "  ", 3).upper() for t in base[:4]]
    for t in base[6:16]:
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "   ", "\n\n", "one", "one", "One two", "é ü 漢字 😀 " * 9, "same words " * 40, prose(rnd, 30_000), base[3] + "\n" + base[4]]
    rows = [(i * 3 + 1, t, rnd.choice(["en", None]), rnd.choice(["web", "code", "books", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base[0], None, None, None), (None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The table with clashing columns in three partitions, and its rows."""
    from pyspark.sql import functions as F

    rows = odd_documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(-7).alias(c) for c in CLASHES]), rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
