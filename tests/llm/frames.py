"""Small frames that hold the awkward cases: nulls in every column, empty, white and very long
texts, repeated rows, equal ids, and columns whose names clash with those the operators use."""

import random

SYLLABLES = ["the", "an", "er", "on", "ing", "tion", "re", "sh", "nd", "ble", "wh", "est"]


def words(rnd, n):
    return ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def sentence_text(rnd, n):
    return " ".join(words(rnd, n))


def odd_rows(seed=5):
    """(doc_id, text, lang, source, n_chars, then clashing columns)."""
    rnd = random.Random(seed)
    long = sentence_text(rnd, 9000)
    base = sentence_text(rnd, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (None, base, None, None),
        (3, None, "en", "a"), (4, "", "de", ""), (5, "  \n\t ", None, "a"), (6, "one two three", "en", "a"),
        (7, long, "en", "b"), (8, long + " tail", "en", "b"), (9, "x" * 40_000, "fr", "a"),
        (10, "\n".join([sentence_text(rnd, 12)] * 30), "en", "a"), (10, sentence_text(rnd, 80), "en", None),
    ]
    rows += [(100 + i, sentence_text(rnd, 60 + 7 * i), rnd.choice(["en", "de"]), rnd.choice(["a", "b", "c"])) for i in range(20)]
    return [(i, t, lang, s, None if t is None else len(t), "clash", 1, [2], "n", 0.5, True) for i, t, lang, s in rows]


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, node int, at array<int>, "
          "length string, cost double, kept boolean")


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
