from __future__ import annotations

from pyspark.sql import functions as F

from srclens.functions.text import byte_view
from srclens.operators.catalog import only
from srclens.operators.scan import issues, with_rule_counts


def files_of(spark, texts, name="Sample.php"):
    """Files from texts: a list, or a dict of stored name -> text (str, bytes or None)."""
    if not isinstance(texts, dict):
        pairs = [(name, t) for t in texts]
    else:
        pairs = list(texts.items())
    rows = [(i, n, n, t.encode() if isinstance(t, str) else t) for i, (n, t) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "file_id LONG, original_name STRING, stored_name STRING, content BINARY")
    return df.select("file_id", "original_name", "stored_name", F.col("stored_name").alias("path"),
                     byte_view(F.col("content")).alias("body"))


def lines_of(spark, number, text, name="Sample.php"):
    """The lines on which one rule hits."""
    rows = issues(files_of(spark, [text], name), only(number)).collect()
    return [r.line for r in rows]


def counts_by_rule(spark, texts):
    """Per text, the counts of every rule as a dict number -> count."""
    rows = with_rule_counts(files_of(spark, texts)).orderBy("file_id").collect()
    return [{int(k[1:]): v for k, v in r.asDict().items() if k[0] == "n" and k[1:].isdigit()} for r in rows]
