import pytest

LOREM = "the quick brown fox jumps over the lazy dog and runs away from the angry bear that lives in the dark green forest near a small village"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, long and repeated texts, a null key, and columns with clashing names."""
    rows = [
        (1, None, None, None, 0),
        (2, "", "en", None, 0),
        (3, " \n\t ", "en", "a", 4),
        (4, LOREM, "en", "a", len(LOREM)),
        (4, LOREM, "en", "a", len(LOREM)),
        (5, LOREM + " once more", None, "b", 0),
        (None, LOREM, "en", "a", 0),
        (6, (LOREM + "\n") * 3000, "en", "a", 0),
        (7, "x" * 5000, "en", "a", 0),
        (8, "Grüße aus Köln — naïve café 漢字仮名 🙂 ½ Ⅷ   a  b\n\n c\x1cd", "de", "b", 0),
        (9, "don't we'll I'm <|endoftext|> 12345 a.b,c!?", "en", "b", 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for name in ("kept", "score", "n", "block", "spans", "ids", "id", "digest", "component_id", "piece", "word"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
