import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, key string, grade string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text, source) rows, with columns whose names operators use inside."""

    def documents(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "size", "row", "key", "grade") for i, t, s in rows], SCHEMA)

    return documents


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="session")
def sample(spark, make):
    """Small real documents and the awkward ones: null and empty texts, a very long one, repeated rows, null ids."""
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    odd = [(None, None, None), (None, None, None), (9001, "", "src1"), (9002, " \n\t", None), (9003, "one two", "src2"), (9004, "One  TWO", "src2"), (9005, "lang " * 40_000 + "é ü 漢", "src3"), (9006, "x" * 300_000, "src3")]
    return rows + odd + rows[:5] + [(9100 + k, rows[3][1], "hot") for k in range(40)]
