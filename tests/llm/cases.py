"""Small tables with the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double, size long, hash long, label int"


def docs(spark, rows):
    """Documents from (doc_id, text, lang, source), with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 7, 0.5, 1, 2, 3) for i, t, l, s in rows], DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward(seed=1):
    rng = random.Random(seed)
    base = sentence(rng, 80)
    common = "this line stands on every site of the net"
    rows = [(1, base, "en", "a"), (2, base.upper(), "en", "b"), (3, base + " tail", None, "c"), (4, None, "en", "a"), (5, "", "fr", None),
            (6, " \n\t ", None, None), (7, "one", "en", "a"), (8, "one", "de", "b"), (None, base, "en", "a"), (None, None, None, None),
            (9, "two words", "en", "a"), (9, "two words", "en", "a"), (10, sentence(rng, 30000), "en", "d"), (11, "É é x É é x 日本 #*$%&|<>", "fr", "e")]
    for k in range(12, 40):
        words = sentence(rng, 60).split()
        if k % 3 == 0:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words[:30]) + "\n" + common + "\n" + " ".join(words[30:]) + "\n" + common, rng.choice(["en", "de"]), f"s{k % 14}"))
    return rows
