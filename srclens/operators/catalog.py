"""The rule catalog: registered packs, and their texts as a small DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from srclens.operators.rules import fixed_values as fixed
from srclens.operators.rules import migration, psr, standard, static_checks, style
from srclens.operators.rules.base import Rule, RulePack

DEFAULT_PACKS: tuple[RulePack, ...] = (
    psr.PACK, static_checks.PACK, style.PACK, standard.PACK, migration.PACK,
)

CATALOG_SCHEMA = T.StructType([
    T.StructField("number", T.IntegerType()),
    T.StructField("analyzer", T.StringType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("level", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("suggestion", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("php_version", T.StringType()),
    T.StructField("before_code", T.StringType()),
    T.StructField("after_code", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("reachable", T.BooleanType()),
])


def register_pack(pack: RulePack, packs: tuple[RulePack, ...] = DEFAULT_PACKS) -> tuple[RulePack, ...]:
    """``packs`` plus a user's own pack; numbers must stay unique."""
    taken = {r.number for p in packs for r in p.rules}
    clash = sorted(taken & {r.number for r in pack.rules})
    if clash:
        raise ValueError(f"rule numbers already in use: {clash}")
    return (*packs, pack)


def all_rules(packs: tuple[RulePack, ...] = DEFAULT_PACKS) -> list[Rule]:
    return [rule for pack in packs for rule in pack.rules]


def only(*numbers: int, packs: tuple[RulePack, ...] = DEFAULT_PACKS) -> tuple[RulePack, ...]:
    """The packs cut down to some rules."""
    cut = (RulePack(p.name, tuple(r for r in p.rules if r.number in numbers)) for p in packs)
    return tuple(p for p in cut if p.rules)


def evaluated(pack: RulePack) -> tuple[Rule, ...]:
    """The rules of a pack that a scan has to look at: one that can never fire is
    left out, unless it was asked for alone."""
    return tuple(r for r in pack.rules if r.reachable or len(pack.rules) == 1)


def rule_catalog(spark: SparkSession, packs: tuple[RulePack, ...] = DEFAULT_PACKS) -> DataFrame:
    """One row per rule; its size is the number of rules, whatever the corpus."""
    names = CATALOG_SCHEMA.fieldNames()
    rows = [
        tuple(pack.name if n == "analyzer" else getattr(rule, n) for n in names)
        for pack in packs for rule in pack.rules
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def standards(spark: SparkSession) -> DataFrame:
    """The graded standards with their rule descriptions."""
    rows = [
        (i, standard, key, text)
        for i, standard in enumerate(fixed.STANDARDS)
        for key, text in fixed.STANDARD_RULES[standard].items()
    ]
    return spark.createDataFrame(
        rows, "standard_no INT, standard STRING, key STRING, description STRING")
