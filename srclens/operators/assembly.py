"""Issues and reports of files of any size: no row holds the lines or hits of a large file.

A text is cut into chunks of whole lines and each chunk's lines are judged as rows; a
chunk of at most ``IN_ROW`` characters is judged within its row, for speed.
The hits, written once, are sorted by ranges of (file, step, line, number); a running
number over the sorted parts cuts each file's hits into report parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.operators.catalog import DEFAULT_PACKS, all_rules
from srclens.operators.ordinal import ordinals
from srclens.operators.report import ISSUES_PER_PART, report_heads
from srclens.operators.rollup import Packs, overview_of, total_in_map
from srclens.operators.rules.base import FALLBACK, FILE, LINE, RulePack
from srclens.operators.scan import (
    HIT_TYPE, LINES_MARK, UNREADABLE, failure_hit, hit_rows, issue_fields, rendered_issues, split_lines, with_hits,
)
from srclens.session import shared_folder

CHUNK = 1 << 20
IN_ROW = 1 << 16  # a text of so many characters is judged within its row


def chunked(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """``files`` as rows ``chunk`` and ``body``: the lines that begin within each ``size`` characters.

    The line feed between two chunks is in neither, so the lines of all chunks are the
    lines of the text.  A file with a null body has no chunk.
    """
    body, feed = F.col("body"), F.lit("\n")
    many = F.ceil(F.length(body) / size).cast("int")
    feeds = F.when(many > 1, F.transform(F.sequence(F.lit(1), many - 1), lambda i: F.position(feed, body, i * size)))
    later = F.transform(F.filter(feeds, lambda at: at > 0), lambda at: at + 1)
    starts = F.array_distinct(F.concat(F.array(F.lit(1)), F.coalesce(later, F.array().cast("array<int>"))))
    cuts = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.struct(a.alias("start"), b.alias("next")))
    rows = files.where(body.isNotNull()).select("*", F.posexplode(cuts).alias("chunk", "_cut"))
    start, after = F.col("_cut.start"), F.col("_cut.next")
    text = F.substring(body, start, F.coalesce(after - start - 1, F.length(body)))
    return rows.withColumn("body", text).drop("_cut")


def _level(packs: Packs, *levels: str) -> Packs:
    cut = (RulePack(p.name, tuple(r for r in p.rules if r.level in levels and r.reachable)) for p in packs)
    return tuple(p for p in cut if p.rules)


def _short_hits(rows: DataFrame, packs: Packs, *keep: str, mark_lines: bool = False) -> DataFrame:
    """``hit_rows`` of readable texts of bounded size: their lines are judged in the row, which is much cheaper."""
    marks = F.array(F.struct(
        F.lit(LINES_MARK).alias("step"), F.size(split_lines(F.col("body"))).alias("line"), F.lit(LINES_MARK).alias("number"),
        F.lit(None).cast("array<string>").alias("captures")).cast(HIT_TYPE)) if mark_lines else F.array().cast(f"array<{HIT_TYPE}>")
    # An expression is exploded, not the column: no filter on its size evaluates the rules again.
    return with_hits(rows, packs).select(*keep, F.explode(F.concat("hits", marks)).alias("hit"))


def _stored(rows: DataFrame, where: str) -> DataFrame:
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)


class Assembly:
    """One scan of ``files`` by chunks, and what is made of its stored hits."""

    def __init__(self, files: DataFrame, packs: Packs = DEFAULT_PACKS, chunk: int = CHUNK) -> None:
        self.packs, self.folder = packs, shared_folder(files.sparkSession)
        own = [c for c in ("file_id", "ordinal", "original_name", "path", "error") if c in files.columns]
        readable = F.col("body").isNotNull()
        self.files = _stored(files.select(*own, readable.alias("readable")), f"{self.folder}/files")
        # A short text of one chunk is scanned once by all rules; of others the chunks by line rules, the whole by file rules.
        short = F.length("body") <= min(chunk, IN_ROW)
        both = _short_hits(files.where(short), _level(packs, FILE, LINE), "file_id", mark_lines=True).withColumn("chunk", F.lit(0))
        long = files.where(~short)
        whole = hit_rows(long, _level(packs, FILE), "file_id", failures=False).withColumn("chunk", F.lit(0))
        cut, by_line, own = chunked(long, chunk), _level(packs, LINE), ("file_id", "chunk")
        lines = (_short_hits(cut, by_line, *own, mark_lines=True) if chunk <= IN_ROW
                 else hit_rows(cut, by_line, *own, failures=False, mark_lines=True))
        found = _stored(both.unionByName(lines).unionByName(whole).select("file_id", "chunk", "hit.*"), f"{self.folder}/found")
        # A chunk's lines come after those of the chunks before it; there is a row per chunk, not per line.
        before = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        self._bases = found.where(F.col("number") == LINES_MARK).select(
            "file_id", "chunk", F.coalesce(F.sum("line").over(before), F.lit(0)).cast("int").alias("base"))
        self._found = found.where(F.col("number") != LINES_MARK)
        self.counted = _stored(self._counted(), f"{self.folder}/counts")

    def _counted(self) -> DataFrame:
        """``files`` with ``counts``, a map of rule number to hits; null where unreadable."""
        # A column per rule: one exchange, of a row per task and file.
        numbers = [r.number for r in all_rules(self.packs) if r.level != FALLBACK]
        each = [F.count_if(F.col("number") == n).alias(f"n{n}") for n in numbers]
        entries = F.array(*[F.struct(F.lit(n).alias("number"), F.col(f"n{n}").alias("n")) for n in numbers])
        many = self._found.groupBy("file_id").agg(*each).select(
            "file_id", F.map_from_entries(F.filter(entries, lambda e: e["n"] > 0)).alias("counts")) if numbers else (
            self._found.select("file_id", F.create_map().cast("map<int,bigint>").alias("counts")))
        none = F.create_map().cast("map<int,bigint>")
        rows = self.files.join(many, "file_id", "left").withColumn(
            "counts", F.when(F.col("readable"), F.coalesce("counts", none)))
        for pack in self.packs:
            others = [r.number for r in pack.rules if r.level != FALLBACK]
            for rule in (r for r in pack.rules if r.level == FALLBACK):
                alone = F.col("counts").isNotNull() & (total_in_map(others) == 0)
                entry = F.create_map(F.lit(rule.number), F.lit(1).cast("long"))
                rows = rows.withColumn("counts", F.when(alone, F.map_concat("counts", entry)).otherwise(F.col("counts")))
        return rows

    def overview(self) -> DataFrame:
        """Status and metrics of every file."""
        return overview_of(self.counted, self.packs, total_in_map)

    def hits(self) -> DataFrame:
        """``file_id, seq, hit`` in report order, ``seq`` from 1; failures and fallback rules included."""
        found = self._found.join(self._bases, ["file_id", "chunk"], "left")
        file_rules = [r.number for r in all_rules(self.packs) if r.level == FILE]
        in_text = ~F.col("number").isin(file_rules) if file_rules else F.lit(True)
        line = F.col("line") + F.when(in_text, F.coalesce("base", F.lit(0))).otherwise(0)
        rows = found.select("file_id", F.struct("step", line.alias("line"), "number", "captures").cast(HIT_TYPE).alias("hit"))
        reason = F.coalesce(F.col("error"), F.lit(UNREADABLE)) if "error" in self.files.columns else F.lit(UNREADABLE)
        stand_ins = [self._stand_in(r) for r in all_rules(self.packs) if r.level == FALLBACK]
        none = F.array().cast(f"array<{HIT_TYPE}>")
        more = F.when(~F.col("readable"), F.array(failure_hit(reason))).otherwise(
            F.array_compact(F.array(*stand_ins)) if stand_ins else none)
        rows = rows.unionByName(self.counted.select("file_id", F.explode(more).alias("hit")))
        placed = ordinals(rows.select("file_id", "hit", "hit.step", "hit.line", "hit.number"), "file_id", "step", "line", "number")
        first = placed.groupBy("file_id").agg(F.min("ordinal").alias("first"))
        return placed.join(first, "file_id").select("file_id", (F.col("ordinal") - F.col("first") + 1).alias("seq"), "hit")

    def _stand_in(self, rule) -> Column:
        hit = F.struct(F.lit(rule.step).alias("step"), F.lit(1).alias("line"), F.lit(rule.number).alias("number"),
                       F.lit(None).cast("array<string>").alias("captures")).cast(HIT_TYPE)
        return F.when(F.map_contains_key("counts", F.lit(rule.number)), hit)

    def issues(self) -> DataFrame:
        """The flat issue table, as ``scan.issues`` gives it."""
        rows, own = self.hits(), ["file_id"]
        if "ordinal" in self.files.columns:
            rows, own = rows.join(self.files.select("file_id", "ordinal"), "file_id"), ["file_id", "ordinal"]
        return rows.select(*own, F.col("seq").cast("int").alias("seq"), *issue_fields(self.packs))

    def reports(self, per_part: int = ISSUES_PER_PART) -> DataFrame:
        """Nested reports as ``report.file_reports`` gives them; at most ``per_part`` hits in a row."""
        part = F.floor((F.col("seq") - 1) / per_part).cast("int").alias("part")
        cut = self.hits().groupBy("file_id", part).agg(F.sort_array(F.collect_list(F.struct("seq", "hit"))).alias("_hits"))
        cut = cut.select("file_id", "part", F.transform("_hits", lambda x: x["hit"]).alias("hits"))
        own = [c for c in ("file_id", "ordinal") if c in self.files.columns]
        heads = report_heads(self.counted.withColumn("parts", F.greatest(
            F.ceil(self._listed() / per_part), F.lit(1)).cast("int")), self.packs, F.col("counts").isNotNull(), total_in_map)
        none = F.array().cast(f"array<{HIT_TYPE}>")
        rows = heads.join(cut, "file_id", "left").withColumns({
            "part": F.coalesce("part", F.lit(0)), "hits": F.coalesce("hits", none)})
        return rows.select(*own, "part", "parts", "name", "path", "status", rendered_issues(self.packs).alias("issues"),
                           "psr_compliance", "migration_summary", "metrics")

    def _listed(self) -> Column:
        """How many rows a file has in its report: its hits, or its failure."""
        return F.coalesce(F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, n: a + n), F.lit(1))
