"""Small dirty tables for the operators' tests."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

LONG = "Of the thonre erthan whst. " * 4000

DIRTY = [
    (1, "The cat sat on the mat and looked at the dog.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "en"),
    (5, "The cat sat on the mat and looked at the dog.", "en"),
    (6, "the CAT sat  on the mat and looked at the dog.", "en"),
    (7, LONG, "en"),
    (8, LONG + "end", "en"),
    (9, "日本語のテキスト éàü ß 123 <|endoftext|> it's I'LL", None),
    (None, "a row without an id", "en"),
    (11, "1234 !!! ---", "de"),
    (12, "x", "de"),
    (12, "x", "de"),
]


def dirty(spark, rows=DIRTY):
    """Documents with columns that clash with names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("*", "'s' as source", "cast(1 as long) as n_chars", "1 as fp", "'c' as component_id",
                         "2 as row", "3 as score", "4 as node", "5 as part", "6 as place", "7 as length", "8 as n")


def empty(spark):
    return dirty(spark).where("false")
