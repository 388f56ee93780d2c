"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.functions import text
from srclens.operators import filters, gate, normalize, report, rollup, scan
from srclens.operators.catalog import DEFAULT_PACKS, all_rules, only, register_pack
from srclens.operators.rules.base import FALLBACK, LINE, Rule, RulePack, groups, match
from srclens.plans import oracles, rendered
from srclens.session import shared_folder
from srclens.operators.assembly import Assembly
from srclens.operators.ordinal import with_ordinal
from srclens.sources import store, tree
from srclens.sources.corpus import from_read, from_table, spread
from srclens.streaming import lint_stream
from srclens.streaming.batches import BatchStore, FileStream, write_batch_reports

Query = Callable[[SparkSession, str], DataFrame]

RULE_COLUMNS = ("file_id", "line", "severity", "rule", "message", "suggestion", "before_code", "after_code")
MIGRATION = tuple(p for p in DEFAULT_PACKS if p.name == "migration")
ACTIVE = ("error", "migration")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(
        _with_sources(sql, names), **{n: table(spark, sf_dir, n) for n in names})


def _with_sources(sql: str, names: tuple[str, ...]) -> str:
    """``FROM name`` -> ``FROM {name}``, the DataFrame placeholder of ``spark.sql``."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = sql.replace(f"FROM {n}\n", f"FROM {{{n}}}\n").replace(f"FROM {n})", f"FROM {{{n}}})")
    return sql


def _text_sql(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """Like ``_sql`` over one table, spread over the cores before any text is made of it."""
    rows = spread(table(spark, sf_dir, name))
    return spark.sql(_with_sources(sql, (name,)), **{name: rows})


def _as_files(rows: DataFrame) -> DataFrame:
    return from_table(rows, F.col("file_id"), F.col("src"), F.col("original_name"), F.col("stored_name"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_files(_text_sql(spark, sf_dir, rendered.part_files("spark"), "part"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_files(_text_sql(spark, sf_dir, rendered.DOCUMENT_FILES, "documents"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_files(_text_sql(spark, sf_dir, rendered.PAGE_FILES, "pages"))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_files(_text_sql(spark, sf_dir, rendered.CONVERSATION_FILES, "conversations"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_sql(spark, sf_dir, rendered.UPLOADS, "orders")


def _findings(sql: str):
    return lambda spark, sf_dir: _text_sql(spark, sf_dir, sql, "events")


def _over(files, operator) -> Query:
    return lambda spark, sf_dir: operator(files(spark, sf_dir))


def _rule_query(number: int, fallback: bool) -> Query:
    packs = MIGRATION if fallback else only(number)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Unreadable files have their own query; here only what the rule finds.
        rows = scan.issues(part_files(spark, sf_dir), packs, failures=False)
        if fallback:
            rule = next(r.rule for r in all_rules(packs) if r.number == number)
            rows = rows.where(F.col("rule") == rule)
        return rows.select(*RULE_COLUMNS)

    return run


def _scan_corpus(files: DataFrame) -> DataFrame:
    lines = F.when(F.col("body").isNotNull(), F.size(scan.split_lines(F.col("body"))))
    return files.select("file_id", "original_name", "stored_name", "size", lines.alias("n_lines"))


def _scan_lines(files: DataFrame) -> DataFrame:
    line = F.col("line")
    return scan.scan_lines(files).select(
        "file_id", "line_no", text.to_utf8(line).alias("line"), F.length(line).alias("bytes"),
        F.length(text.rtrimmed(line)).alias("trimmed_bytes"))


def _migration_issues(files: DataFrame) -> DataFrame:
    return filters.migration_only(scan.issues(files, MIGRATION, failures=False)).drop("seq")


def _rewrite_preview(files: DataFrame) -> DataFrame:
    return scan.issues(files, MIGRATION, failures=False).where(F.col("before_code").isNotNull()).select(
        "file_id", "line", "rule", "before_code", "after_code")


def _escape_html(files: DataFrame) -> DataFrame:
    return _rewrite_preview(files).select(
        "file_id", "line", "rule", text.escape_html(F.col("before_code")).alias("before_html"),
        text.escape_html(F.col("after_code")).alias("after_html"))


def _migration_summary(files: DataFrame) -> DataFrame:
    return rollup.migration_summary(files).select(
        "file_id", "total_suggestions", F.to_json("by_category").alias("by_category"),
        F.to_json("php_versions").alias("php_versions"), "complexity")


def _manifest(mode: str):
    return lambda up: gate.manifest(up, mode, "batch_id").select(
        "upload_id", "original_name", "stored_name", "path", "size", "mime_type")


def _path_parts(up: DataFrame) -> DataFrame:
    name = F.col("original_name")
    return up.select("upload_id", text.base_name(name).alias("base_name"),
                     text.file_stem(name).alias("stem"), text.extension(name).alias("extension"))


def _stored_name(up: DataFrame) -> DataFrame:
    name, time = F.col("original_name"), F.col("unix_time")
    return up.select(
        "upload_id", text.stored_name(name, time, F.col("batch_id"), F.col("upload_id")).alias("stored_name"),
        text.report_id(time, F.col("upload_id")).alias("report_id"))


def _stored_names_unique(up: DataFrame) -> DataFrame:
    """Uploads and distinct stored names; some uploads share name, size and time."""
    return _stored_name(up).where(F.col("stored_name").isNotNull()).agg(
        F.count("*").alias("uploads"), F.count_distinct("stored_name").alias("names"))


def _format_size(up: DataFrame) -> DataFrame:
    return up.select("upload_id", "size", text.human_size(F.col("size")).alias("shown"))


def _purge(target: str, summary: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = store.purge_plan(_sql(spark, sf_dir, oracles.LISTING, "orders"), target)
        return store.purge_summary(plan, target) if summary else plan

    return run


RUN_TIME = 1_700_000_000


def _report_lookup(table_name: str) -> Query:
    """Store two runs, then read one of them back by its id."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = shared_folder(spark)
        files = part_files(spark, sf_dir)
        wanted = store.new_report_id(spark, RUN_TIME, "parts")
        other = store.new_report_id(spark, RUN_TIME + 1, "pages")
        store.save_report(files, root, wanted, nested=False)
        store.save_report(page_files(spark, sf_dir), root, other, nested=False)
        return store.require_report(spark, root, wanted, table_name).drop("report_id")

    return run


def _report_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store a run, store it again with half of the files, read it back."""
    root, files = shared_folder(spark), part_files(spark, sf_dir)
    run = store.new_report_id(spark, RUN_TIME, "replaced")
    store.save_report(files, root, run, nested=False)
    store.save_report(files.where(F.col("file_id") % 2 == 0), root, run, nested=False)
    return store.require_report(spark, root, run, "issues").drop("report_id")


# A pack a user would add to the catalog.
USER_PACK = RulePack("team", (Rule(
    100, 20, LINE, "info", "team.output", "Output of <1>", "Use the logger", match(r"(echo|print)\s"),
    captures=groups(r"(echo|print)\s", 1)),))


def _rule_pack(files: DataFrame) -> DataFrame:
    packs = register_pack(USER_PACK)
    return scan.issues(files, only(100, packs=packs), failures=False).select(*RULE_COLUMNS)


def _landed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as a stream of newly landed data files, rendered as they arrive."""
    schema = table(spark, sf_dir, "part").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[p]art.parquet")
    stream = stream.repartition(spark.sparkContext.defaultParallelism)  # short rows, long texts
    return _as_files(spark.sql(_with_sources(rendered.part_files("spark"), ("part",)), part=stream))


def _streamed(rows_of, after=lambda df: df) -> Query:
    """Run a stream to the end of what has landed, then read its sink."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = shared_folder(spark)
        rows = rows_of(_landed_parts(spark, sf_dir))
        lint_stream.write_stream(
            rows, f"{root}/rows", f"{root}/checkpoint", available_now=True).awaitTermination()
        return after(spark.read.schema(rows.schema).parquet(f"{root}/rows"))

    return run


def _batch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the micro-batches of what has landed."""
    root = shared_folder(spark)
    lint_stream.write_batch_summaries(
        _landed_parts(spark, sf_dir), f"{root}/batches", f"{root}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{root}/batches").withColumn("batch_id", F.col("batch_id").cast("long"))


def _stored_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics merged over two stored runs; texts are not read again."""
    root = shared_folder(spark)
    for i, files in enumerate((part_files, document_files)):
        run = store.new_report_id(spark, RUN_TIME + i, "statistics")
        store.save_report(files(spark, sf_dir), root, run, nested=False)
    return store.rule_statistics(spark, root)


DAY = 86_400


def _retention(done: bool) -> Query:
    """Four daily runs of a quarter of the parts each; those older than 60 hours go, but for the last three."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, files = shared_folder(spark), part_files(spark, sf_dir)
        for day in range(4):
            name = store.new_report_id(spark, RUN_TIME + day * DAY, "retention")
            store.save_report(files.where(F.col("file_id") % 4 == day), root, name, only(1, 37), nested=False)
        plan = store.retention_plan(spark, root, RUN_TIME + 4 * DAY, max_age=60 * 3600, keep_last=3)
        if not done:
            return plan.drop("report_id")
        failed = store.apply_retention(plan, root).where("error IS NOT NULL").count()
        return store.runs_of(spark, root).select("unix_time", "total_files", F.lit(failed).alias("failures"))

    return run


def _landed_tree(files: DataFrame, root: str) -> None:
    """Part files as real files in directories; some names and directories are hidden, null bodies stay away."""
    k = F.col("file_id")
    hidden = F.when(k % 10 == 1, "_").when(k % 10 == 2, ".").otherwise("")
    folder = F.concat(F.when(k % 9 == 0, "__d").otherwise("d"), (k % 8).cast("string"), F.lit("/"))
    rows = files.where(F.col("body").isNotNull()).select(
        F.concat(folder, hidden, "original_name").alias("path"), F.encode("body", "ISO-8859-1").alias("content"))
    tree.land_files(rows, root).write.format("noop").mode("overwrite").save()


def _part_number(name: str) -> Column:
    return F.regexp_extract(name, r"(\d+)\.php$", 1).cast("long")


def _read_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the parts, list them, remove some, read all that was listed; large ones are not opened."""
    root = shared_folder(spark)
    _landed_tree(part_files(spark, sf_dir), root)
    listed = tree.list_tree(spark, root)
    gone = listed.where(_part_number("path") % 7 == 3)
    tree.remove_files(gone).write.format("noop").mode("overwrite").save()
    files = from_read(tree.read_listed(listed, rendered.READ_LIMIT))
    lines = F.when(F.col("body").isNotNull(), F.size(scan.split_lines(F.col("body"))))
    return files.select("original_name", "size", "error", lines.alias("n_lines"))


def _failed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure rows of the files that could not be read."""
    rows = _read_tree(spark, sf_dir).where("error IS NOT NULL")
    files = rows.select(F.col("original_name").alias("file_id"), "original_name", F.lit(None).cast("string").alias("body"), "error")
    return scan.failed_files(files).where("analyzer = 'run'").select("original_name", "severity", "rule", "message", "line")


def _every_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two waves of files, each taken by a stream that starts anew and a reconciling run."""
    root = shared_folder(spark)
    found = BatchStore(spark, f"{root}/reports")
    files = part_files(spark, sf_dir)
    for wave in (0, 1):
        _landed_tree(files.where(F.col("file_id") % 2 == wave), f"{root}/in")
        stream = FileStream(spark, f"{root}/in", found, f"{root}/checkpoint")
        stream.start(available_now=True).awaitTermination()
        stream.reconcile()
        stream.reconcile()  # nothing is left
    return found.read("files").select("batch_id", "original_name", "status", *rollup.METRICS)


def _batch_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file what the committed batches hold: status, metrics, compliance, migration, size of the batch."""
    root = shared_folder(spark)
    found = BatchStore(spark, f"{root}/reports")
    write_batch_reports(_landed_parts(spark, sf_dir), found, f"{root}/checkpoint", available_now=True).awaitTermination()
    standards = found.read("compliance").groupBy("batch_id", "file_id").agg(
        F.count_if("compliant").alias("compliant_standards"), F.sum("issues_count").alias("standard_issues"))
    hints = found.read("migration").select("batch_id", "file_id", "total_suggestions", "complexity")
    listed = found.read("issues").groupBy("batch_id", "file_id").agg(F.count("*").alias("issue_rows"))
    out = found.read("files").drop("original_name")
    for part in (standards, hints, listed):
        out = out.join(part, ["batch_id", "file_id"], "left")
    return out.join(found.read("summary").select("batch_id", "total_files"), "batch_id")


def _in_order(operator) -> Query:
    return lambda spark, sf_dir: operator(with_ordinal(part_files(spark, sf_dir), "original_name"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for rule in all_rules(DEFAULT_PACKS):
        out[rule.query_name] = _rule_query(rule.number, rule.level == FALLBACK)
    out |= {
        # sources
        "scan_corpus": _over(part_files, _scan_corpus),
        "scan_corpus_documents": _over(document_files, _scan_corpus),
        "scan_lines": _over(document_files, _scan_lines),
        "read_tree": _read_tree,
        "failed_reads": _failed_reads,
        "file_ordinals": _in_order(lambda f: f.select("file_id", "original_name", "ordinal")),
        # gate
        "validate_files": _over(uploads, lambda up: gate.validate_files(up).select(
            "upload_id", "original_name", "status", "size", "error")),
        "rejected_files": _over(uploads, lambda up: gate.rejects(up).select(
            "upload_id", "original_name", "error")),
        "validate_client": _over(uploads, lambda up: gate.validate_client(up).select(
            "upload_id", "original_name")),
        "gate_batch": _over(uploads, lambda up: gate.gate_batch(up, "batch_id")),
        "gate_run": _over(uploads, gate.gate_batch),
        "manifest": _over(uploads, _manifest("strict")),
        "manifest_per_row": _over(uploads, _manifest("per_row")),
        # names and formatting
        "path_parts": _over(uploads, _path_parts),
        "stored_name": _over(uploads, _stored_name),
        "stored_names_unique": _over(uploads, _stored_names_unique),
        "format_size": _over(uploads, _format_size),
        "escape_html": _over(part_files, _escape_html),
        # issues
        "all_issues": _over(part_files, scan.issues),
        "all_issues_documents": _over(document_files, scan.issues),
        "all_issues_pages": _over(page_files, scan.issues),
        "all_issues_conversations": _over(conversation_files, scan.issues),
        "issues_in_order": _in_order(scan.issues),
        "overview_in_order": _in_order(rollup.file_overview),
        "issue_rows": _over(part_files, scan.issue_rows),
        "issue_rows_documents": _over(document_files, scan.issue_rows),
        "failed_files": _over(part_files, scan.failed_files),
        "migration_issues": _over(part_files, _migration_issues),
        "rewrite_preview": _over(part_files, _rewrite_preview),
        # roll-ups
        "psr_compliance": _over(part_files, rollup.psr_compliance),
        "file_metrics": _over(part_files, rollup.file_metrics),
        "file_metrics_documents": _over(document_files, rollup.file_metrics),
        "file_status": _over(part_files, rollup.file_status),
        "file_overview": _over(part_files, rollup.file_overview),
        "run_summary": _over(part_files, rollup.run_summary),
        "run_summary_documents": _over(document_files, rollup.run_summary),
        "migration_summary": _over(part_files, _migration_summary),
        "display_totals": _over(part_files, rollup.display_totals),
        "rule_counts": _over(part_files, rollup.rule_counts),
        "rule_counts_documents": _over(document_files, rollup.rule_counts),
        # filters
        "filter_severity": _over(part_files, lambda f: filters.filter_severity(scan.issues(f), "warning")),
        "filter_display": _over(part_files, lambda f: filters.filter_display(scan.issues(f), ACTIVE)),
        "visible_files": _over(part_files, lambda f: filters.visible_files(f, ACTIVE)),
        # reports and store
        "report_json": _over(part_files, report.report_json),
        "report_json_by_ranges": _over(part_files, lambda f: report.as_json(Assembly(f, chunk=rendered.READ_LIMIT).reports())),
        "issues_by_ranges_documents": _over(document_files, lambda f: Assembly(f).issues()),
        "report_lookup": _report_lookup("issues"),
        "report_lookup_summary": _report_lookup("summary"),
        "report_replaced": _report_replaced,
        "rule_pack": _over(part_files, _rule_pack),
        "purge_plan": _purge("uploads", False),
        "purge_plan_reports": _purge("reports", False),
        "purge_summary": _purge("uploads", True),
        "rule_statistics_stored": _stored_statistics,
        "retention_plan": _retention(False),
        "retention_done": _retention(True),
        # findings of external tools
        "normalize_fixer": _over(_findings(rendered.FIXER_FINDINGS), normalize.normalize_fixer),
        "normalize_stan": _over(_findings(rendered.STATIC_FINDINGS), normalize.normalize_static),
        "normalize_sniffer": _over(_findings(rendered.SNIFFER_FINDINGS), normalize.normalize_sniffer),
        "normalize_diff": _over(_findings(rendered.DIFF_FINDINGS), normalize.normalize_diff),
        # streams
        "stream_issues": _streamed(lint_stream.issue_stream),
        "stream_reports": _streamed(lint_stream.overview_stream),
        "stream_compliance": _streamed(lint_stream.compliance_stream),
        "stream_migration": _streamed(_migration_summary),
        "stream_batches": _batch_summaries,
        "stream_batch_reports": _batch_reports,
        "stream_every_file": _every_file,
        "stream_summary": _streamed(lint_stream.overview_stream, rollup.run_summary_of),
    }
    return out


def oracle_sql() -> dict[str, str]:
    parts = rendered.part_files("duckdb")
    docs, pages, turns = rendered.DOCUMENT_FILES, rendered.PAGE_FILES, rendered.CONVERSATION_FILES
    out = {r.query_name: oracles.one_rule(parts, r.number) for r in all_rules(DEFAULT_PACKS)}
    out |= {
        "scan_corpus": oracles.scan_corpus(parts),
        "scan_corpus_documents": oracles.scan_corpus(docs),
        "scan_lines": oracles.SCAN_LINES,
        "read_tree": oracles.read_tree(parts),
        "failed_reads": oracles.failed_reads(parts),
        "file_ordinals": oracles.file_ordinals(parts),
        "issues_in_order": oracles.in_order(parts, oracles.all_issues(parts)),
        "overview_in_order": oracles.in_order(parts, oracles.file_overview(parts)),
        "validate_files": oracles.VALIDATE,
        "rejected_files": oracles.REJECTS,
        "validate_client": oracles.CLIENT,
        "gate_batch": oracles.GATE,
        "gate_run": oracles.GATE_RUN,
        "manifest": oracles.manifest(True),
        "manifest_per_row": oracles.manifest(False),
        "path_parts": oracles.PATH_PARTS,
        "stored_name": oracles.STORED_NAME,
        "stored_names_unique": oracles.STORED_NAMES_UNIQUE,
        "format_size": oracles.FORMAT_SIZE,
        "escape_html": oracles.escape_html(parts),
        "all_issues": oracles.all_issues(parts),
        "all_issues_documents": oracles.all_issues(docs),
        "all_issues_pages": oracles.all_issues(pages),
        "all_issues_conversations": oracles.all_issues(turns),
        "issue_rows": oracles.issue_rows(parts),
        "issue_rows_documents": oracles.issue_rows(docs),
        "failed_files": oracles.failed_files(parts),
        "migration_issues": oracles.migration_issues(parts),
        "rewrite_preview": oracles.rewrite_preview(parts),
        "psr_compliance": oracles.psr_compliance(parts),
        "file_metrics": oracles.file_metrics(parts),
        "file_metrics_documents": oracles.file_metrics(docs),
        "file_status": oracles.file_status(parts),
        "file_overview": oracles.file_overview(parts),
        "run_summary": oracles.run_summary(parts),
        "run_summary_documents": oracles.run_summary(docs),
        "migration_summary": oracles.migration_summary(parts),
        "display_totals": oracles.display_totals(parts),
        "rule_counts": oracles.rule_counts(parts),
        "rule_counts_documents": oracles.rule_counts(docs),
        "filter_severity": oracles.filtered(parts, "severity = 'warning'"),
        "filter_display": oracles.filtered(parts, oracles.display_filter(ACTIVE)),
        "visible_files": oracles.visible_files(parts, ACTIVE),
        "report_json": oracles.report_json(parts),
        "report_json_by_ranges": oracles.report_json(parts),
        "issues_by_ranges_documents": oracles.all_issues(docs),
        "report_lookup": oracles.all_issues(parts),
        "report_lookup_summary": oracles.run_summary(parts),
        "report_replaced": oracles.report_replaced(parts),
        "rule_pack": oracles.rule_pack(parts),
        "purge_plan": oracles.purge_plan("uploads"),
        "purge_plan_reports": oracles.purge_plan("reports"),
        "purge_summary": oracles.purge_summary("uploads"),
        "rule_statistics_stored": oracles.rule_statistics(parts, docs),
        "retention_plan": oracles.retention(parts, RUN_TIME, DAY, False),
        "retention_done": oracles.retention(parts, RUN_TIME, DAY, True),
        "normalize_fixer": oracles.FIXER,
        "normalize_stan": oracles.STATIC,
        "normalize_sniffer": oracles.SNIFFER,
        "normalize_diff": oracles.DIFF,
        "stream_issues": oracles.all_issues(parts),
        "stream_reports": oracles.file_overview(parts),
        "stream_summary": oracles.run_summary(parts),
        "stream_compliance": oracles.psr_compliance(parts),
        "stream_migration": oracles.migration_summary(parts),
        "stream_batch_reports": oracles.batch_reports(parts),
        "stream_every_file": oracles.every_file(parts),
        "stream_batches": f"SELECT CAST(0 AS BIGINT) AS batch_id, * FROM ({oracles.run_summary(parts)})",
    }
    return out
