"""Small odd documents that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, n_words string, source string"


def words(rng, n, vocab=40):
    return " ".join(rng.choice(VOCAB[:vocab]) for _ in range(n))


VOCAB = [a + b for a in ("the", "Er", "ñas", "on", "bé", "x7") for b in ("", "ton", "ing,", "ß", "LY", "q.", "&")]


def odd_docs(seed=1, n=40):
    """Random, near-copied, repeated, empty, null and very long texts; a clashing extra column."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((i, words(rng, rng.randint(1, 200)), "en", "x", None))
    base = words(rng, 120).split(" ")
    for i in range(6):
        w = list(base)
        for _ in range(i):
            w[rng.randrange(len(w))] = "changed"
        out.append((100 + i, " ".join(w), "en", None, "s"))
    out += [(200, None, None, None, None), (201, "", "en", "", ""), (202, " \n\t ", "en", "", ""), (203, out[3][1], "en", "", "")]
    out += [(204, words(rng, 6000) + "\n\nA line.\nA line.\nA line.", "en", "", ""), (205, "a b", "", "", ""), (206, "single", "", "", ""), (207, "\x1c \x85　 é́ x", "", "", "")]
    return out


def frame(spark, rows=None):
    return spark.createDataFrame(odd_docs() if rows is None else rows, SCHEMA)
