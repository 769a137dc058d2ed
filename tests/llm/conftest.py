import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, shard int, chunk int, bands string, h long"


def sentence(rng, n=12):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def make_texts(seed=5, n=60):
    """Texts with shared lines and passages, copies and near copies, very short and very long ones."""
    rng = random.Random(seed)
    shared = [" ".join(sentence(rng) for _ in range(5)) for _ in range(3)]
    line = "  This Line Stands In Many Documents  "
    texts = []
    for i in range(n):
        body = [sentence(rng, 14) for _ in range(rng.randint(2, 9))]
        if i % 4 == 0:
            body.insert(1, shared[i % 3])
        text = " ".join(body)
        if i % 3 == 0:
            text += f"\n{line}\n" + sentence(rng)
        if i % 10 == 7:
            text = texts[i - 3]
        if i % 10 == 8:
            words = texts[i - 4].split(" ")
            if len(words) > 40:
                words[len(words) // 2] = "changed"
            text = " ".join(words)
        texts.append(text)
    texts += ["", None, "\n\n", "short", "é" * 30 + "\nÉ Ü ß " * 8, "x", "x", " ".join(sentence(rng, 20) for _ in range(400))]
    return texts


def rows_of(texts):
    rows = [(i, t, "en", [None, "a", "b", "Z"][i % 4], None, i % 3, 1, None, "x", 7) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, texts[0], None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    """A small table with NULLs everywhere, ties, repeated rows and columns with clashing names."""
    return spark.createDataFrame(rows_of(make_texts()), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
