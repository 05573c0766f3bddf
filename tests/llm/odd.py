"""Small hostile tables: NULLs in every column, empty and long texts, ties, repeats, clashing columns."""

import random

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))


def documents(spark, more=()):
    """doc_id, text, lang, source, n_chars and extra columns named like results of the operators."""
    base = prose(80, 1)
    edited = base.replace(base.split()[40], "changed")
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, edited, "en", "b"), (3, prose(80, 2), "en", None),
        (4, None, None, None), (5, "", "en", "a"), (6, " \n\t ", "de", "b"), (7, "one", "en", "a"), (8, "one two", "en", "a"),
        (9, prose(9000, 3), "fr", "c"), (10, "same same same " * 60, "en", "a"), (None, prose(70, 4), "en", "b"),
        (12, "line of some words 1\n" * 30 + prose(60, 5), "en", "c"), (3, prose(80, 2), "en", None), (3, prose(60, 6), "en", "c"),
        (13, "naïve café ŵords 漢字 " * 20, None, "ü"), (14, "A|B $$$ ### " * 40, "en", "b"), (15, base.upper().replace(" ", "\n"), "en", "a"),
        *more,
    ]
    return spark.createDataFrame(
        [(d, t, lang, s, None if t is None else len(t), "x", -1, None, "y", 1.5) for d, t, lang, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long, Kept string, shard int, size string, n_words string, `a.b` double")


def empty(spark):
    return documents(spark).limit(0)
