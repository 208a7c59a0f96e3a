import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _src string, shard int"


def words(rng, n):
    return [rng.choice(["al", "be", "ga", "de", "ep", "ze", "et", "th", "io", "ka"]) + rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, copies, near copies and extra columns whose names clash with inner ones."""
    rng = random.Random(3)
    rows, base = [], [" ".join(words(rng, 60)) for _ in range(12)]
    for i in range(80):
        w = base[i % 12].split()
        if i >= 12:
            for _ in range(i % 3):
                w[rng.randrange(len(w))] = "zz" + str(rng.randrange(9))
        rows.append((i, " ".join(w), "en", None if i % 7 == 0 else f"src{i % 4}"))
    rows += [(80, None, None, None), (81, "", "en", "src1"), (82, " \t\n", "en", "src1"), (83, "one two", "de", "src2"), (84, "one  TWO", "de", "src2"), (85, " ".join(words(rng, 6000)), "en", "src9"), (86, "same", None, "src3"), (87, "same", None, "src3")]
    rows.append(rows[5])  # a repeated row
    rows.append((None, "no id here at all", "en", "src1"))
    data = [(a, b, c, d, len(b or ""), 7, "x", -1) for a, b, c, d in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
