"""Mixing sources to target weights with a hierarchical budget.

The token budget runs down a tree (say domain, language, source).  At each node
the children share it in proportion to their weights; a child takes no more than
its subtree can supply in all its epochs, and what it leaves goes to its siblings,
so a shortage reaches an ancestor only when all siblings are exhausted.  A leaf
reads its documents epoch by epoch, each in an order of its own seed, and stops at
its budget: all epochs but the last are whole, the last is a prefix.

The prefix is found without gathering a source: documents fall into ``BUCKETS`` by
the first digits of their order key, bucket sums tell which buckets are wholly in
or out, and only the bucket at the boundary is ordered document by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srclens.llm.common import table, written

BUCKETS = 3  # hexadecimal digits of the order key: 4096 buckets a leaf
EPOCHS = 3
SEED = 17
WORD = r"[^ \t\n\r]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], budget: Column) -> DataFrame:
    """Leaves (level columns, ``supply``) with the tokens each gets, ``amount``.

    ``weights``: for each level a column over the level columns down to it; nodes
    of weight 0, null or less get nothing.  The rows are nodes of the tree.
    """
    levels = list(levels)
    amounts = None
    for depth in range(1, len(levels) + 1):
        path, parent = levels[:depth], levels[:depth - 1]
        nodes = leaves.groupBy(*path).agg(F.sum("supply").alias("supply"))
        weight = F.coalesce(weights[depth - 1].cast("double"), F.lit(0.0))
        nodes = nodes.withColumn("weight", weight).where("weight > 0")
        if amounts is None:
            whole = nodes.agg(F.sum("supply").alias("whole"))
            nodes = nodes.join(whole).withColumn(
                "parent_amount", F.least(budget, F.col("whole")).cast("double")).drop("whole")
        else:
            nodes = nodes.join(amounts, parent)
        order = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("weight"), path[-1])
        before = F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        # The rate at which exactly the nodes before this one are exhausted; the largest is the right one.
        nodes = nodes.withColumn("rate", (F.col("parent_amount") - before) / rest)
        rate = F.max("rate").over(Window.partitionBy(*parent))
        amounts = nodes.withColumn("amount", F.least(F.col("supply").cast("double"), rate * F.col("weight"))).select(
            *path, F.col("amount").alias("parent_amount"))
    return leaves.join(amounts.withColumnRenamed("parent_amount", "amount"), levels)


def mixture(docs: DataFrame, levels: Sequence[str], weights: Sequence[Column], budget: Column, tokens: Column,
            key: Column, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Selected documents: ``doc`` (the row), the level columns, ``epoch``, ``tokens`` and ``taken``.

    ``budget`` is a column over ``available``, the tokens of all documents;
    ``tokens`` and ``key`` are columns of ``docs``.  ``taken`` is less than
    ``tokens`` where a leaf's budget ends inside a document.  Level values that are
    null count as the empty string; documents without tokens are never selected;
    equal rows count each; ties of the order key go by the key, then the tokens.
    """
    levels = list(levels)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"mix_{i}") for i, c in enumerate(levels)),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"), F.coalesce(key.cast("string"), F.lit("")).alias("key"))
    names = [f"mix_{i}" for i in range(len(levels))]
    rows = rows.where("tokens > 0")
    leaves = written(rows.groupBy(*names).agg(F.sum("tokens").alias("once")))
    available = leaves.agg(F.coalesce(F.sum("once"), F.lit(0)).alias("available"))
    total = available.select(F.floor(budget).alias("b")).first()[0]
    plan = budgets(leaves.withColumn("supply", F.col("once") * epochs).toDF(*levels, "once", "supply"),
                   levels, weights, F.lit(total or 0).cast("long")).toDF(*names, "once", "supply", "amount")
    wanted = F.floor("amount").cast("long")
    plan = written(plan.select(*names, F.expr("floor(amount) div once").cast("int").alias("full"),
                               (wanted % F.col("once")).alias("rest")))

    rows = rows.join(plan, names)
    whole = rows.where("full > 0").select(
        "doc", *names, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "tokens",
        F.col("tokens").alias("taken"))
    last = rows.where("rest > 0").withColumn(
        "place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), "key").cast("binary")))
    last = last.withColumn("bucket", F.substring("place", 1, BUCKETS))
    sums = last.groupBy(*names, "bucket", "rest").agg(F.sum("tokens").alias("held"))
    before = F.sum("held").over(Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = written(sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest").select(
        *names, "bucket", "before", (F.col("before") + F.col("held") > F.col("rest")).alias("edge")))
    last = last.join(sums, [*names, "bucket"]).withColumnRenamed("full", "epoch")
    inside = last.where("NOT edge").select("doc", *names, "epoch", "tokens", F.col("tokens").alias("taken"))
    running = F.sum("tokens").over(
        Window.partitionBy(*names, "bucket").orderBy("place", "key", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    edge = last.where("edge").withColumn("left", F.col("rest") - F.col("before") - F.coalesce(running, F.lit(0))).where(
        "left > 0").select("doc", *names, "epoch", "tokens", F.least("tokens", "left").alias("taken"))
    return whole.unionByName(inside).unionByName(edge).toDF("doc", *levels, "epoch", "tokens", "taken")


DOMAIN = r"CASE WHEN source RLIKE '^src[0-9]+$' THEN concat('domain', CAST(substring(source, 4) AS BIGINT) % 4) ELSE 'other' END"
LEVELS = ("domain", "lang", "source")


def domain_weights() -> tuple[Column, Column, Column]:
    """Four domains 4:3:2:1 (others 1), English twice any other language, sources alike."""
    d = F.col("domain")
    return (F.when(d == "domain0", 4).when(d == "domain1", 3).when(d == "domain2", 2).otherwise(1),
            F.when(F.col("lang") == "en", 2).otherwise(1), F.lit(1))


def op2_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, dealt by the weights above, up to three epochs of each source."""
    docs = written(table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.expr(DOMAIN).alias("domain"), count_words(F.col("text")).alias("n_words")))
    return mixture(docs, LEVELS, domain_weights(), F.col("available") / 2, F.col("n_words"), F.col("doc_id")).select(
        F.col("doc.doc_id").alias("doc_id"), *LEVELS, "epoch", "tokens", "taken")


def mix_documents(docs: DataFrame, share: float = 0.9) -> DataFrame:
    """The documents of a mix of ``share`` of all tokens, each at most once, columns unchanged.

    The document at which a source's budget ends keeps its first words, parted by
    blanks; n_chars follows.  The domain is always that of ``source``; a column of
    that name is like any other one.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    known = rows.select("row", "row.lang", "row.source").withColumn("domain", F.expr(DOMAIN))
    chosen = mixture(known, LEVELS, domain_weights(), F.col("available") * share, count_words(F.col("row.text")),
                     F.col("row.doc_id"), epochs=1)
    row = F.col("doc")["row"]
    cut = F.col("taken") < F.col("tokens")
    words = F.filter(F.split(row["text"], r"[ \t\n\r]+"), lambda w: w != "")
    text = F.when(cut, F.array_join(F.slice(words, 1, F.greatest(F.col("taken"), F.lit(1)).cast("int")), " ")).otherwise(
        row["text"])
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.char_length(text)).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return chosen.select(*(changed.get(c, F.col(f"doc.row.`{c}`")).alias(c) for c in docs.columns))


QUERIES = {"op2_hierarchical_mix": op2_hierarchical_mix}


def _level_sql(depth: int) -> str:
    path = ", ".join(LEVELS[:depth])
    parent = ", ".join(LEVELS[:depth - 1])
    by = f"PARTITION BY {parent} " if parent else ""
    source = "total" if depth == 1 else f"amount{depth - 1} USING ({parent})"
    weight = ("CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END",
              "CASE lang WHEN 'en' THEN 2 ELSE 1 END", "1")[depth - 1]
    join = "CROSS JOIN" if depth == 1 else "JOIN"
    return f"""
node{depth} AS (
    SELECT {path}, sum(once)::BIGINT * {EPOCHS} AS supply, ({weight})::DOUBLE AS weight FROM leaf GROUP BY {path}
), rate{depth} AS (
    SELECT n.*, parent_amount, (parent_amount - coalesce(sum(supply) OVER (
        {by}ORDER BY supply / weight, {LEVELS[depth - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (
        {by}ORDER BY supply / weight, {LEVELS[depth - 1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
    FROM node{depth} n {join} {source}
), amount{depth} AS (
    SELECT {path}, least(supply::DOUBLE, max(rate) OVER ({by}) * weight) AS parent_amount FROM rate{depth}
)"""


ORACLES = {"op2_hierarchical_mix": f"""
WITH doc AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           CASE WHEN regexp_matches(source, '^src[0-9]+$')
                THEN 'domain' || (substring(source, 4)::BIGINT % 4) ELSE 'other' END AS domain,
           len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS tokens
    FROM documents
), leaf AS (
    SELECT domain, lang, source, sum(tokens)::BIGINT AS once FROM doc WHERE tokens > 0 GROUP BY ALL
), total AS (
    SELECT floor(sum(once)::BIGINT / 2) AS parent_amount FROM leaf
),{_level_sql(1)},{_level_sql(2)},{_level_sql(3)}, plan AS (
    SELECT domain, lang, source, floor(parent_amount)::BIGINT // once AS full_epochs,
           floor(parent_amount)::BIGINT % once AS rest
    FROM leaf JOIN amount3 USING (domain, lang, source)
), d AS (
    SELECT * FROM doc JOIN plan USING (domain, lang, source) WHERE tokens > 0
), whole AS (
    SELECT doc_id, domain, lang, source, unnest(range(full_epochs))::INTEGER AS epoch, tokens, tokens AS taken
    FROM d WHERE full_epochs > 0
), ordered AS (
    SELECT *, rest - coalesce(sum(tokens) OVER (
        PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || full_epochs || ':' || doc_id)
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over
    FROM d WHERE rest > 0
)
SELECT doc_id, domain, lang, source, epoch, tokens, taken FROM whole
UNION ALL
SELECT doc_id, domain, lang, source, full_epochs::INTEGER, tokens, least(tokens, left_over) FROM ordered WHERE left_over > 0
"""}
