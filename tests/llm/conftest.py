import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, block string, class string, key int, score string"


def corpus() -> list[tuple]:
    """Rows with ties, copies, near copies, shared passages, nulls, no words, odd characters, long words and clashing columns."""
    pick = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["The", "the", "ÄÖ", "naïve", "x" * 40, "don't", "12,5", "😀", " nbsp", "a​b"]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    texts = [text(pick.randint(0, 120)) for _ in range(24)]
    passage = text(50)
    texts += [f"{text(20)}\n{passage}\t{text(9)}", f"{text(3)} {passage}", passage, f"{passage} {text(4)} {passage}"]
    base = text(90).split()
    for i in range(6):  # near copies in a chain
        base = [*base]
        base[i * 11 : i * 11 + 3] = ["changed", f"n{i}", "here"]
        texts.append(" ".join(base))
    one = text(60)
    texts += [one] * 5 + [one.upper(), None, None, "", "  \n\t ", "one", "one", "one two", "\x0b\x0c", "<|endoftext|> and <|startoftext|>", text(3000)]
    rows = [(i * 3 + 1, t, pick.choice(["de", "en", None]), pick.choice(["web", "hot", "hot", None]), None if t is None else len(t), "r", "b", "c", i % 2, "s") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "a row without an id", "en", "web", 19, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in corpus()]
