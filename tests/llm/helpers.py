"""Rows that every operator must take: nulls, blanks, ties, repeated rows and extra columns with clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows], DOCS)


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "word " * 30_000), (6, "same text here"), (6, "same text here"), (7, "same text here"), (None, "no id"), (8, "Ünï cödé \U0001f600 \x00 z"), (9, "a\r\nb\r\n\n")]
    return docs(spark, rows)


def wide(df):
    """With extra columns named like results and like internals."""
    from pyspark.sql import functions as F

    names = ["score", "fp", "shard", "slot", "key", "rank", "length", "piece", "component_id", "n_lines", "n_dropped", "sequence_id", "offset", "root", "a", "b", "variant", "n", "host", "line", "did", "th", "spans", "todo", "start", "end", "digest", "mz", "c", "p", "w", "times", "first", "page", "words", "slots", "y", "word"]
    return df.select("*", *[F.lit(1).alias(c) for c in names if c not in df.columns])


def save(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
