import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) rows with copies, near copies, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(rng.randint(20, 120)) for _ in range(20)]
    passage = say(60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i].upper()) for i in range(5)]  # equal after lower-casing
    for i in range(12):  # near copies of one text, at different distances
        w = base[7].split()
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{say(15)}\n{passage}\t{say(10)}") for i in range(6)]
    rows += [(400, None), (401, None), (402, ""), (403, " \n\t"), (404, "one two"), (405, "one  two"), (406, say(30_000)), (407, "É é ÇA ça")]
    rows += [(408, "word " * 500), (409, "x" * 5000), (3, base[3])]  # the last one is a repeated row
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows, with further columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, i, "k", [1], i) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, node long, label string, marks array<int>, n int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
