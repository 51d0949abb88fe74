"""Small tables with the awkward rows that every operator has to bear."""

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))

#: (doc_id, text, lang, source)
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, "a"),
    (4, "one", "en", None),
    (5, "one two three four five six seven", "en", "b"),
    (5, "one two three four five six seven", "en", "b"),
    (6, "ONE two three FOUR five six seven", None, None),
    (None, "one two three four five six seven", "en", "b"),
    (None, "nothing like the others at all here", "en", "b"),
    (7, LONG, "de", "c"),
    (8, "café Été naïve 日本語   x́ <|endoftext|> a\u0085b", "fr", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def documents(spark, rows=ODD, **extra):
    """A documents table; ``extra`` adds constant columns, to clash with names that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


#: Names that operators use inside.
CLASH = {n: 1 for n in "t h id row k_id k_hash b_id w n size part copies times e kept c gid f1 sketch place x".split()}
