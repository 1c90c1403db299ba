"""Small documents with the cases every operator must define: nulls, empties, repeats, ties and clashing columns."""

import random

import pytest

EXTRA = "key string, row string, digest string, fp string, shard string, score string, label string, anchor string"
N_EXTRA = EXTRA.count(",") + 1


def made_texts(n: int, seed: int = 3) -> list[str]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["an", "the", "or", "ti", "ed", "É", "ße", "日"]) for _ in range(rnd.randint(1, 4))) for _ in range(90)]
    found = []
    for _ in range(n):
        lines = [" ".join(rnd.choices(words, k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
        found.append("\n".join(lines))
    return found


@pytest.fixture(scope="session")
def rows():
    texts = made_texts(60)
    long = " ".join(texts) * 4
    odd = [None, "", " ", "\n\n", "word", "Word", "two  words", "two words", "two\twords ", "\U0001f600 <|endoftext|> x", "A" * 700]
    copies = [texts[0]] * 8 + [texts[0] + " end", texts[1] + "\n" + texts[2], texts[2] + "\n" + texts[1], long, long + " tail"]
    found = [(i, t) for i, t in enumerate(texts + odd + copies)]
    # Ids that are null or repeat, with the same and with another text.
    return found + [(None, texts[3]), (None, None), (None, "lonely text of a null id"), (5, texts[5]), (5, texts[6]), (7, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
    full = [(i, t, "aa", "s", len(t or ""), *["x"] * N_EXTRA) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(4).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
