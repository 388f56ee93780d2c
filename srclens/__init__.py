"""srclens: lint and migration reports for source corpora, as Spark DataFrames."""
