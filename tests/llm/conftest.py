import random

import pytest

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(400)]
CLASHING = "key string, ord long, hits int, id long, n int, bucket int, extra int, component long, pattern int, n_words int, label int, size int, a int, b int, p int, lead long, k int, h long, g int, copy_keys int, kept boolean, members int, hashes binary, count int, moved int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts():
    """(doc_id, text): nulls, empties, repeats, ties, special tokens, odd white space, and one long text."""
    base = prose(1, 300)
    texts = [None, "", " \n\t ", "one", "a b c", base, base, base + " and one more word", base.replace("w1", "x1", 2), "# $ % | <> &" * 5, "Crème brûlée 東京 \U0001f600 x́ " * 20]
    texts += ["line\nline\nline\n\nother", "ab <|endoftext|> cd", "licensed under the MIT license. cc by nc", prose(2, 40), prose(2, 40), prose(2, 12), "\0 x \0", prose(3, 60_000), "A" * 30_000]
    return [(k + 1, t) for k, t in enumerate(texts)] + [(6, base), (7, prose(4, 50)), (None, base), (None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd rows with lang, source, n_chars and further columns whose names the operators use inside."""
    rows = [(i, t, ["de", "en", None][k % 3], "s", None if t is None else len(t)) for k, (i, t) in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs.selectExpr("*", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ")))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id -> text of the smallest table."""
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
