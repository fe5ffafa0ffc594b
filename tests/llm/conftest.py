import random

import pytest

from scoreline.llm import words as wd  # noqa: F401  (fails early if the package is missing)


@pytest.fixture(scope="module")
def corpus():
    """Small texts: copies, near copies, shared passages, short, empty, null, long words."""
    rng = random.Random(5)
    vocab = ["the", "of", "and", "à", "über"] + [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    passage = text(60)
    out = []
    for _ in range(40):
        out.append(text(rng.randint(20, 200)))
    for i in range(12):
        out.append(out[i])
    for i in range(30):
        w = out[i].split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        out.append(" ".join(w))
    for i in range(10):
        out.append(text(rng.randint(5, 30)) + "\n" + passage + "  " + text(rng.randint(5, 30)))
    out += ["", " \n\t ", "one", "one two", "One  TWO", "a " * 50, "a " * 40, "a b " * 30,
            "Q" * 5000, None, None]
    rng.shuffle(out)
    return list(enumerate(out, start=10))


@pytest.fixture()
def documents(spark, corpus):
    """The corpus as a table with null and repeated rows and clashing column names."""
    rows = [(i, t, "en", "src0", len(t or ""), 1, "x") for i, t in corpus]
    rows += [rows[0], (None, "some text without an id", None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "n_words int, score string")
