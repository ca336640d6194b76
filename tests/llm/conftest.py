import random

import pytest

#: Columns whose names the operators use inside; they must not get in the way.
CLASHING = "key long, n long, token string, rank int, block int, words string, member long, root long, node string, slot int, place int, part int, conv int"


@pytest.fixture(scope="session")
def random_texts():
    """Prose with near copies, copies, short and empty texts: a list of (doc_id, text)."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([30, 60, 120])))) for i in range(40)]
    for i in range(40, 90):
        words = rows[rng.randrange(8)][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(90, ""), (91, None), (92, " \n "), (93, "one two"), (94, "One TWO"), (95, "one"), (96, None)]
    rows += [(97, "long " + " ".join(f"x{i}" for i in range(30_000))), (98, rows[0][1].upper())]
    return rows


@pytest.fixture
def documents(spark):
    def make(rows, source=lambda i: "a", extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (f", {CLASHING}" if extra else "")
        width = len(CLASHING.split(",")) if extra else 0
        data = [(i, t, "en", source(i), len(t or ""), *[None] * width) for i, t in rows]
        return spark.createDataFrame(data, schema)

    return make
