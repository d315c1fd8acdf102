"""Small tables with the awkward cases that every operator must bear."""

import random

SYLLABLES = "an be ci do el fu ga hi jo ka lu mo ne pi ro sa tu ve wo zy".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents(spark, rows, clash=()):
    """``rows``: (doc_id, text, lang, source); ``clash``: names of further columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in clash)
    full = [(i, t, la, s, None if t is None else len(t), *["x"] * len(clash)) for i, t, la, s in rows]
    return spark.createDataFrame(full, schema)


def awkward(rng: random.Random):
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties."""
    base = prose(rng, 120)
    rows = [(None, None, None, None), (1, "", "aa", "s"), (2, None, "aa", None), (3, base, "aa", "s"), (3, base, "aa", "s"),
            (4, base.upper(), "bb", "t"), (5, base + " end", "bb", "t"), (6, " \n\t ", None, "s"), (7, "123 456 !!", "aa", "t"),
            (8, "é日本 <|endoftext|> a  b", "aa", "s"), (9, prose(rng, 40_000), "aa", "s"), (None, base, None, "s"),
            (10, "one two", "bb", "s"), (11, "one two", "bb", "t"), (12, "x" * 30_000, "aa", "s")]
    rows += [(20 + i, prose(rng, rng.randint(1, 200)), rng.choice(["aa", "bb"]), rng.choice("stu")) for i in range(60)]
    return rows
