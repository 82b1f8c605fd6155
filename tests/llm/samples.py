"""Small documents with every oddity: nulls, empty and long texts, repeated rows, extra and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, label string, rest string"


def words(rnd, n):
    return " ".join("".join(rnd.choice(["ta", "re", "lo", "mi", "ü", "É", "st"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def odd_documents(spark, more=()):
    rnd = random.Random(4)
    base, passage = words(rnd, 200), words(rnd, 120)
    changed = base.split()
    changed[7] = "other"
    texts = [(1, base), (2, base), (2, base), (3, " ".join(changed)), (4, None), (5, ""), (None, "no id " + words(rnd, 40)), (6, "one"),
             (7, "Two words"), (8, words(rnd, 20_000)), (9, words(rnd, 90) + " " + passage), (10, passage + " tail " + words(rnd, 80)),
             (11, "aaaa" * 300), (12, " \t\n"), (13, "naïve <|endoftext|> it's 日本"), (None, None), *more]
    rows = [(d, t, "en", None, None if t is None else len(t), "s", "r", "l", "x") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)
