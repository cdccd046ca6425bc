"""Small awkward tables that every operator must take."""

import random

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.05 else " ") for w in words).strip()


def awkward_documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, odd white space."""
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split(" ")
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, " ".join(words[:60] + ["changed"] + words[61:]), "de", None, None),
        (4, None, "en", "a", None), (5, "", None, "a", 0), (6, " \t\n ", "en", "b", 4), (7, "one two three", "en", "b", 13), (8, "One TWO three", "en", "b", 13),
        (9, prose(rng, 40000), "en", "b", None), (10, "é ß\u0085x\r\ny\x0bz  a", "fr", "c", None), (11, "same word " * 80, "en", "c", None),
        (12, "\n".join(["a line that repeats here"] * 20), "en", "c", None), (1, base, "en", "a", 5), (13, "<|endoftext|> ▁x don't’s 123", "en", "c", None),
        (14, prose(rng, 300), "en", "a", None), (15, " ".join(prose(rng, 50).split() + words[10:70] + prose(rng, 50).split()), "en", "a", None),
    ]
    return rows + [(100 + i, prose(rng, rng.randint(1, 200)), rng.choice(["en", "de"]), rng.choice("ab"), i) for i in range(40)]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_documents() if rows is None else rows, SCHEMA)
