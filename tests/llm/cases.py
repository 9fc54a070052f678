"""Small awkward tables shared by the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat and the dog were in the house with all of their friends and then they went home to eat dinner together"
DE = "der hund und die katze waren im haus mit allen ihren freunden und dann gingen sie nach hause um zu essen"


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """(doc_id, text, lang, source) rows; by default with nulls, ties, repeats, blanks and a long text, and with
    extra columns of the names that operators add."""
    if rows is None:
        rows = [
            (1, EN, "en", "a"), (2, EN, "en", "a"), (2, EN, "en", "a"), (3, DE, "de", "b"), (None, EN, "en", "a"), (None, None, None, None),
            (4, None, "en", "a"), (5, "", "de", None), (6, " \t\n ", None, "b"), (7, "123 456 !!!", "en", "b"), (8, "word", "en", "a"),
            (9, (EN + " " + DE + "\n") * 3000, "en", "a"), (10, "ÄÖÜ ß é \U0001F600 x", "de", "b"), (11, "x" * 5000, "en", "a"), (12, DE + "\n" + DE, "de", "b"),
        ]
    df = spark.createDataFrame([(a, t, l, s, len(t) if t else 0) for a, t, l, s in rows], DOCUMENTS)
    for name in ("kept", "score", "lang_pred", "n_words", "slot", "block", "mixed", "component_id", "cls", "h", "share", "n", "first", "good", "enter"):
        df = df.selectExpr("*", f"'own' as {name}")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENTS)
