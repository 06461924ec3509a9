import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs; the other columns are made up, one of them clashes with results."""
    def make(pairs):
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "mine") for i, t in pairs]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty, blank, tied, repeated, very long, without blanks, other scripts, and strings tokenizers know."""
    return [
        (0, "the cat sat on the mat and the dog ate the fish on the hill by the sea"), (1, None), (2, ""), (3, " \t\n"),
        (4, "the cat sat on the mat and the dog ate the fish on the hill by the sea"), (5, "x" * 5_000),
        (6, "ab" * 1_500 + " " + "-" * 300), (7, "word " * 4_000), (8, "Ünïcödé  tëxt with　odd   blanks ▁ ok"),
        (9, "日本語 テキスト 𝒳𝒴 ​﻿"), (10, "<s> </s> <0x41> <|endoftext|> don't we'll 12 345 a_b"),
        (11, "THE CAT SAT ON THE MAT"), (12, "the cat sat on the mat"), (12, "the cat sat on the mat"), (None, "no id here at all"),
        (None, "no id here at all"), (13, "\x00\x01 \x1f zero"), (14, "İstanbul ΣΑΣ ǅ ﬁ é \r\n tail"), (2**40, "far away id"),
    ]


@pytest.fixture(scope="session")
def small_tables(spark, tmp_path_factory):
    """The smallest given data, cut from nothing."""
    return "/root/testdata/sf0.001"
