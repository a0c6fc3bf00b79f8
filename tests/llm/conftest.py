import random

import pyarrow.parquet as pq
import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()

ODD = [
    None, "", "   \n\t ", "one", "one two three", "\n\n", "é ü ▁ 🙂 <unk>", "a" * 30_000, "x y " * 4_000,
    "same text " * 40, "same text " * 40, "line one is here\nline one is here\n\nlast",
]


def prose(seed: int, n: int, vocabulary: int = 5000) -> str:
    rnd = random.Random(seed)
    return " ".join(f"{rnd.choice(WORDS)}{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(sf_dir):
    """doc_id and text of the small table."""
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [(i, text, None if i % 3 == 0 else f"s{i % 2}", None if i % 4 == 0 else "en", i, i, "x", -1) for i, text in enumerate(ODD)]
    rows += [rows[-1], rows[3], (None, "null key " * 30, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    names = "doc_id long, text string, source string, lang string, n_chars long, n_words int, kept string, position int"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
