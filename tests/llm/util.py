from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"

#: Nulls, empty and long texts, ties, repeated rows and ids, white space of all kinds, characters of one to four bytes.
ODD = [
    (1, "a  b\tc"), (2, "a b c"), (2, "a b c"), (None, "a b c"), (None, None), (3, None), (4, ""), (5, "   "),
    (6, "A B C"), (7, "x" * 70_000), (8, "word " * 20_000), (9, "é ü 中文 𝒳  z"), (10, "a\x0bb\x0cc"), (11, "<|endoftext|> it's 123 don't"),
]


def odd_documents(spark: SparkSession):
    """With columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", k, "x", k, "y", "z", None) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, sha string, component int, _key string, _hits string, fp long")


def empty_documents(spark: SparkSession):
    return spark.createDataFrame([], "doc_id long, text string")
