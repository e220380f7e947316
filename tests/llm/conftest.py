import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def word_path():
    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def piece_path():
    return str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and looping texts, repeated rows and a clashing extra column."""
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(None, None, 1), (1, "", 2), (2, words, 3), (2, words, 3), (3, words.replace("w60", "other"), 4), (4, "ab" * 700, 5),
            (5, "z" * 900, 6), (6, "x y " * 80, 7), (7, "é🙂\x00 " * 120, 8), (None, words[:300], 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, key int")
