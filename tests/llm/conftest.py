import public_tokenizers
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{k % 977} the" for k in range(30_000))
    return spark.createDataFrame(
        [(1, "a b c d e f", "x", 5), (2, "a b c d e f", "x", 5), (2, "a b c d e f", "x", 5), (3, None, None, None),
         (4, "", "y", 0), (5, " \t\n", "y", 0), (None, "a b c d e f", "z", 1), (None, None, None, None),
         (6, "one", "z", 1), (7, "one two", "z", 2), (8, long, "z", 3), (9, 'say "idiot" <s>[INST] \\l ✓ é', None, 3)],
        "doc_id long, text string, source string, score long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def bpe_ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")
