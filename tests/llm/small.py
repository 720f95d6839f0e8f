"""Small tables for the corpus operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, `_words` string, score double"


def documents(spark, rows):
    """Documents from (doc_id, text), with extra columns of names that operators use inside."""
    full = [(i, t, "en" if i and i % 2 else None, "s", len(t) if t else None, "x", None, 1.5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, n: int) -> str:
    import random

    chance = random.Random(seed)
    return " ".join(chance.choice("abcdefgh") * chance.randint(1, 3) + str(chance.randint(0, 99)) for _ in range(n))
