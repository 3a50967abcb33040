import random

import pytest

#: Columns whose names the operators use inside themselves.
CLASHES = ["digest", "keep_id", "uid", "locator", "part", "bin", "kind", "cell", "doc", "rank", "score", "bucket", "run", "n", "cdf", "rate"]


@pytest.fixture(scope="session")
def table(spark):
    """Rows (id, text) as a documents table, with extra columns of clashing names."""

    def make(rows, clashes=True):
        names = CLASHES if clashes else []
        data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), *[7] * len(names)) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {n} long" for n in names))

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, repeated lines, blanks and nulls."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([2, 5, 12, 80, 200]))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 8])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            text = " ".join(t)
            if rnd.random() < 0.2:
                text = text.upper()
            if rnd.random() < 0.2:
                text += "\n" + passage
            rows.append(text)
    rows += ["line of text that repeats itself\n" * 40, "ab" * 300, "z" * 500, "", " \n", None, "Ünïcödé Straße " * 12, "Ünïcödé straße " * 12, "x"]
    return [(3 * i + 1, t) for i, t in enumerate(rows)]
