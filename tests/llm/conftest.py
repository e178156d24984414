import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source); a column with a clashing name is added."""

    def make(rows):
        full = [(*r, *("en", "src0")[len(r) - 2 :])[:4] for r in rows]
        return spark.createDataFrame([(i, t, la, s, None, "mine") for i, t, la, s in full], SCHEMA)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


#: Null ids and texts, empty texts, ties, repeated rows, one very long text.
ODD = [
    (None, "no id but a text of several words here"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, prose(5, 60)),
    (6, prose(5, 60)),
    (6, prose(5, 60)),
    (7, prose(7, 30000)),
    (8, "É" * 500),
    (9, prose(5, 60), None, None),
]
