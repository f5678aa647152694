import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, row string, doc string, label string"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    syllables = ["ka", "lo", "mi", "tor", "ven", "sha", "ri", "pel", "un", "da"]
    pool = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(vocabulary)]
    out = [rng.choice(pool) for _ in range(words)]
    return " ".join(w + (".\n" if i % 17 == 16 else "") for i, w in enumerate(out)).strip()


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, odd characters."""
    rng = random.Random(9)
    text = prose(rng, 60)
    return [
        (1, text, "en", "a", len(text)),
        (1, text, "en", "a", len(text)),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0),
        (4, " \t\n\r ", "en", None, 5),
        (None, "lone words here", "en", "b", 15),
        (5, text, None, None, len(text)),
        (6, "naïve café — 東京 <|endoftext|> it's 12345 🙂 x", "fr", "b", None),
        (7, prose(rng, 30_000), "en", "b", None),
        (8, "one", "en", "a", 3),
        (-9, "one two three four", "en", "a", 3),
    ]


def documents(spark, rows):
    """With more columns, whose names operators use inside."""
    return spark.createDataFrame([(*r, "h", "r", "d", "l") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, edge_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def corpus_rows():
    """About 300 documents of four made-up languages and three sources, with copies and near copies."""
    rng = random.Random(4)
    sounds = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["eau", "ou", "re", "le"], "dd": ["os", "ci", "que", "na"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        if i % 10 == 9:
            base = rows[rng.randrange(len(rows))]
            words = base[1].split(" ")
            if i % 20 == 19:
                words[rng.randrange(len(words))] = "changed"
            rows.append((i, " ".join(words), base[2], base[3], 0))
            continue
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 150))]
        rows.append((i, " ".join(words), lang, rng.choice("xxxyz"), 0))
    return rows


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    return documents(spark, corpus_rows).repartition(4).cache()
