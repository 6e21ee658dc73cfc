import random

import pytest

EXTRA = ["id", "print", "data", "score", "label", "block", "kept", "row", "component", "__text", "__score", "__ids", "__lang", "__place", "__source", "__mark", "__found", "__spans", "__key", "__print", "__no_text", "__file", "__bucket", "__index"]


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def dirty_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and extra columns with names that clash with inner ones."""
    r = random.Random(1)
    base = words(r, 300)
    texts = [base, base, base + " tail", words(r, 5000), "", None, "x", "..", "à é ü " * 40, words(r, 80), words(r, 80), base.replace("a", "b")]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s0", None, "s1"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], (0, "another text of id zero", "en", "s0", 23), (None, base, "en", "s0", len(base)), (None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(*x, *range(len(EXTRA))) for x in rows], kinds + "".join(f", `{c}` int" for c in EXTRA))


@pytest.fixture(scope="session")
def empty_documents(spark, dirty_documents):
    return spark.createDataFrame([], dirty_documents.schema)
