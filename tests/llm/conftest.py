import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (id, text) pairs, with columns whose names clash."""

    def build(rows, clash=False):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in ("piece", "score", "bucket", "id", "class", "row", "hits", "row_key", "__row",
                         "__order", "__copies", "order", "copies", "whole", "head", "shingle"):
                df = df.selectExpr("*", f"'kept' as `{name}`")
        return df

    return build


LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
ODD_TEXTS = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "\n\n\t"), (6, "héllo wörld 日本 😀"),
             (7, LONG), (None, "without an id"), (8, "same text"), (8, "same text"), (8, "other")]
