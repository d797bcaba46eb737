import pytest

WORDS = "the of and to in that for with as was on are by this be from or one had not but what all were when we there can an your".split()


@pytest.fixture(scope="session")
def make(spark):
    """Rows as a documents table."""

    def run(rows, extra=False):
        rows = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for name in ("score", "rank", "n_words", "fp", "component_id", "_id", "_row", "kept", "row", "token"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return run
