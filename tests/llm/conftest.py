import random

import pytest

WORDS = "the of and stone river house light plain green water small quick".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, nulls, empty and very long ones."""
    rng = random.Random(11)
    passage = sentence(rng, 60)
    out = [sentence(rng, rng.randrange(15, 120)) for _ in range(40)]
    out += [out[0], out[0].upper(), out[1], out[1]]
    for i in range(2, 12):  # near copies: one word changed of at least 60
        w = (out[i] + " " + passage).split()
        out.append(" ".join(w))
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 20) for _ in range(6)]
    out += [None, "", " \n\t ", "one", "one two three", "a " * 5000 + sentence(rng, 8000), "é" * 30000]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with extra columns whose names clash with those that operators make."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else "big", len(t or ""), i, "x", -1) for i, t in enumerate(texts)]
    rows += [(None, "a null id " * 4, None, None, None, None, None, None), (3, texts[3], "en", "src0", 1, 1, "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, sha string, kept int").repartition(3)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
