import pytest

#: nulls in any column, empty and white texts, ties and repeated rows, one long text, a clashing extra column
ODD = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "en", "s1", 51, "x"),
    (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "en", "s1", 51, "y"),
    (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "en", "s1", 51, "y"),
    (3, None, "en", None, None, None),
    (4, "", None, "", 0, ""),
    (5, " \t\n ", "en", "s2", 4, "z"),
    (6, "one two", "en", "s2", 7, "z"),
    (7, "One TWO", "en", "s2", 7, "z"),
    (8, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "s3", 100, "z"),
    (None, "a b c d e f g h i j k l m n o p q r s t u v w x y Z", None, None, 51, None),
    (9, "ünï çödé 日本語   nbsp em  two  blanks\n\nlines\nlines\n", "fr", "s1", 40, "w"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
