import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, blk long, r int, fp long, score double, kind int"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def row(doc_id, text):
    return (doc_id, text, "en", "s", None if text is None else len(text), 7, 7, 7, 0.5, 1)


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty texts, ties, repeated rows, exact and near copies, shared passages, one long text."""
    passage = words(900, 60)
    out = [(i, words(i, 40 + 7 * i)) for i in range(24)]
    out += [(30, None), (31, ""), (32, " \t\n"), (33, "one two"), (34, "one two")]
    out += [(40, out[3][1]), (41, out[3][1] + " extra"), (42, out[5][1].upper()), (43, out[5][1].replace("w1 ", "w2 ", 1))]
    out += [(50, words(51, 20) + " " + passage + " " + words(52, 11)), (51, passage), (52, words(53, 90) + "\n" + passage)]
    out += [(60, "same " * 120), (61, words(61, 4000)), (7, out[7][1]), (7, "another text with the same id"), (None, words(62, 50))]
    out += [(70, "Über Straße ünd ÄÖ. Ähnlich; éá  x\u0085y " * 4)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([row(*t) for t in texts], DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
