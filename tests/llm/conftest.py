import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows of documents with copies, near copies, shared passages, junk, nulls, repeated rows and one very long text."""
    rng = random.Random(seed)
    vocab = {x: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(150)] for x, letters in (("en", "abcdefgh "), ("de", "klmnopqü"))}
    passage = " ".join(rng.choices(vocab["en"], k=70))
    texts = []
    for k in range(n):
        lang = "en" if k % 3 else "de"
        words = rng.choices(vocab[lang], k=rng.choice((0, 1, 3, 6, 8, 12, 40, 90, 200)))
        if k % 7 == 0 and words:
            words[len(words) // 2 : len(words) // 2] = passage.split(" ")
        texts.append((" ".join(words), lang))
    for k in range(12):
        text, lang = texts[rng.randrange(n)]
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append((" ".join(words), lang))
    texts += [texts[5], texts[6], texts[6], (texts[9][0].upper(), "en"), ("12 34 !!", "en"), ("", "de"), ("\t\n", None), (" ".join(rng.choices(vocab["en"], k=9000)), "en")]
    rows = [(k * 3 % 251, t, x, f"src{k % 5}" if k % 11 else None, len(t)) for k, (t, x) in enumerate(texts)]
    rows += [(None, "no identifier here at all, none", "en", "src1", 3), (500, None, None, None, None), rows[6], rows[6], (None, rows[7][1], None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(docs):
    """The same rows with columns whose names the operators use within."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("id", "i", "d", "k", "x", "h", "n", "key", "kind", "part", "keep", "size", "u", "v", "_text", "_d", "_k", "label", "epoch", "tokens", "bucket"))])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
