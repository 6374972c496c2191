import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose with exact and near copies, shared passages, repeats within a text, junk, empty, null and long texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice(["an", "er", "th", "ön", "qu", "is", "Ou"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", "  ", ", "]) for _ in range(n))
    texts = [prose(rng.randint(1, 160)) for _ in range(40)]
    passage = prose(60)
    texts += [passage + prose(30), prose(20) + passage, prose(30) + passage[5:] + prose(4)] + [texts[i] for i in (1, 2, 2, 3)]
    texts += [texts[5].replace(texts[5].split()[-1], "other"), texts[6] + " tail", prose(900), "ab" * 300, "x" * 250, "", None, "  \n ", "one two", "### *** $$$ " * 30]
    texts += ["same line again here\n" * 20, "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 60, "<|im_end|> a <|endoftext|> b"]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus as the table, with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in corpus], DOCS).repartition(3)
    return df.withColumns({"row": F.lit("x"), "k": F.lit(1), "fp": F.lit("y"), "kept": F.lit(0), "t": F.lit(2), "ids": F.lit(3), "shard": F.lit(4)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, rows that repeat, and ids that two texts share."""
    a, b = "some words that repeat " * 12, "other words entirely, " * 9
    rows = [(None, a), (None, None), (1, a), (1, a), (1, b), (2, b), (2, ""), (3, None)]
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
