"""The same answers as SQL, for DuckDB to compute independently.

Every rule is written here a second time, as predicates of DuckDB's regex
dialect (no look-ahead, no back-references, no possessive quantifiers).
"""

from __future__ import annotations

from srclens.operators import gate, normalize
from srclens.operators.catalog import DEFAULT_PACKS
from srclens.operators.rules import fixed_values as fixed
from srclens.operators.rules.base import FALLBACK, FILE, split_template
from srclens.operators.scan import ISSUE_COLUMNS, UNREADABLE
from srclens.plans import rendered
from srclens.sources import tree

RULES = {r.number: r for p in DEFAULT_PACKS for r in p.rules}
ANALYZER = {r.number: p.name for p in DEFAULT_PACKS for r in p.rules}
_TRIM = "concat(' ', chr(9), chr(10), chr(11), chr(13))"


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _m(pattern: str, text: str = "l") -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def _x(pattern: str, group: int, text: str = "l") -> str:
    return f"regexp_extract({text}, {quoted(pattern)}, {group})"


def _n(pattern: str, text: str = "c") -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def _trim(expr: str) -> str:
    return f"trim({expr}, {_TRIM})"


_RTRIM = f"rtrim(l, {_TRIM})"
_CODE = "t NOT IN ('', '0')"
_P = fixed.CAPTURE_PATTERNS
_CLS = _x(_P[10], 1, "c")
_NS = _m(r"namespace\s+([^;]+);", "c")
_USES = r"regexp_extract_all(c, 'use\s+([^;]+);', 1)"
_R36 = r"substr\s*\(\s*([^,]+),\s*-strlen\s*\(\s*([^)]+)\s*\)\s*\)\s*===\s*(.*)$"
_R46 = r"(\w+)\s*\([^)]*,\s*[^)]*,\s*[^)]*\)"

# The rules of each severity and of each step of the report, written out here
# so that a slip in the catalog shows.
SEVERITIES = {
    "error": (1, 2, 3, 5, 8, 9, 10, 11, 13, 19, 20, 27, 29, 30, 31, 32),
    "warning": (4, 6, 12, 15, 17, 18, 24, 26, 28),
    "info": (7, 16, 21, 22, 23, 25, *range(33, 50)),
}
STEPS = {
    1: (1, 2, 3, 4), 2: (5, 6, 7), 3: (8,), 4: (9, 10), 5: (11, 12, 13), 6: (15, 16), 7: (17, 18), 8: (19, 20),
    9: (21, 22, 23, 24, 25), 10: (26, 27, 28, 29, 30, 31, 32), 11: tuple(range(33, 49)), 12: (49,),
}
SEVERITY = {n: severity for severity, numbers in SEVERITIES.items() for n in numbers}
STEP = {n: step for step, numbers in STEPS.items() for n in numbers}

# The patterns of the rules.
FILE_TESTS = {
    1: "NOT starts_with(c, '<?php')",
    2: f"{_n(r'<[?]')} > {_n(r'<[?](php|=)')}",
    3: "starts_with(c, '﻿')",
    4: "contains(c, 'echo') OR contains(c, 'print') OR contains(c, 'printf')",
    8: f"{_n(r'namespace\s+[^;]+;')} > {_n(r'namespace\s+[^;]+;\s*\n\s*\n')}",
    9: f"NOT {_NS}",
    10: f"{_NS} AND {_CLS} <> '' AND {_CLS} <> stem",
    11: f"NOT {_m(r'declare\s*\(\s*strict_types\s*=\s*1\s*\)', 'c')}",
    12: f"len({_USES}) > 1 AND list_sort({_USES}) <> {_USES}",
    13: (_m(r"(?:public|private|protected)\s+(?:static\s+)?\$\w+"
            r"|(?:public|private|protected)\s+(?:static\s+)?function", "c")
         + f" AND {_n(r'public\s+')} + {_n(r'private\s+')} + {_n(r'protected\s+')}"
         + f" < {_n(r'(?:function\s+\w+|\$\w+\s*[=;])')}"),
}
LINE_TESTS = {
    5: "starts_with(l, chr(9))",
    6: f"strlen({_RTRIM}) > 120",
    7: _m(r"\s+$"),
    15: _m(r"\$[a-zA-Z_][a-zA-Z0-9_]*") + " AND " + _m(r"echo\s+\$\w+|print\s+\$\w+"),
    16: _m(r"\$\w+->\w+"),
    17: (_m(r"function\s+\w+\s*\([^)]*\)\s*\{") + " AND NOT "
         + _m(r"function\s+\w+\s*\([^)]*\)\s*:\s*\w+")),
    18: (_m(r"function\s+\w+\s*\(\s*\$\w+") + " AND NOT "
         + _m(r"function\s+\w+\s*\(\s*\w+\s+\$\w+")),
    19: _m(r"create_function\s*\("),
    20: _m(r"each\s*\("),
    21: _m(r"\s+$") + f" AND {_CODE}",
    22: _m(r"^\t"),
    23: _m(r"\$\w+=[^=]") + " AND NOT " + _m(r"\$\w+\s*=\s*"),
    24: _m(r"array\s*\("),
    25: _m(r'"[^"\\$]*"') + " AND NOT " + _m(r'"[^"]*\$[^"]*"'),
    26: f"strlen({_RTRIM}) > 120",
    27: f"contains({_x(r'^(\s+)', 1)}, chr(9))",
    28: (f"{_x(r'^(\s+)', 1)} <> '' AND NOT contains({_x(r'^(\s+)', 1)}, chr(9)) "
         f"AND strlen({_x(r'^(\s+)', 1)}) % 4 <> 0 AND {_CODE}"),
    29: _m(r"\s+$") + f" AND {_CODE}",
    30: _m(r"^(class|interface|trait)\s+\w+.*\{$", "t"),
    31: _m(r"function\s+\w+.*\{$", "t"),
    32: _m(r"\$\w+\s*;") + " AND NOT " + _m(r"(public|private|protected)\s+"),
    33: _m(_P[33]),
    34: _m(_P[34]),
    35: _m(_P[35]),
    36: f"{_m(_R36)} AND starts_with({_x(_R36, 3)}, rtrim({_x(_R36, 2)}))",
    37: _m(_P[37]),
    38: _m(_P[38]) + " AND NOT contains(l, 'readonly')",
    39: f"contains({_x(_P[39], 1)}, '|')",
    40: _m(_P[40]),
    41: _m(_P[41]),
    42: _m(r"(?i)(curl_multi_|curl_exec.*curl_close|async|promise)"),
    43: _m(_P[43]),
    44: _m(_P[44]),
    45: _m(r"function\s+__construct\s*\([^)]*\$(\w+)[^)]*\)"),
    46: f"{_m(_R46)} AND {_x(_R46, 1)} NOT IN ('if', 'for', 'while', 'foreach', 'switch')",
    47: _m(r"list\s*\("),
    48: _m(_P[48]) + " AND NOT " + _m(r"readonly\s+class"),
}
_STUDLY = ("array_to_string([concat(upper(substr(x, 1, 1)), substr(x, 2)) "
           "for x in string_split(lower({0}), '_')], '')")
CAPTURES = {
    6: [f"CAST(strlen({_RTRIM}) AS VARCHAR)"],
    10: [_CLS, "stem"],
    26: [f"CAST(strlen({_RTRIM}) AS VARCHAR)"],
    33: [_x(_P[33], 1)],
    34: [_trim(_x(_P[34], 1)), _trim(_x(_P[34], 2))],
    35: [_trim(_x(_P[35], 1)), _trim(_x(_P[35], 2))],
    36: [_trim(_x(_R36, 1)), _trim(_x(_R36, 2))],
    37: [_trim(_x(_P[37], 1))],
    38: [_x(_P[38], 1), _x(_P[38], 2)],
    39: [_x(_P[39], 1), _x(_P[39], 2)],
    40: [_x(_P[40], 1), _x(_P[40], 2)],
    41: [_x(_P[41], 1), _x(_P[41], 2), _STUDLY.format(_x(_P[41], 1))],
    43: [_x(_P[43], 1), _x(_P[43], 2)],
    44: [_x(_P[44], 1), _x(_P[44], 2)],
    48: [_x(_P[48], 1)],
}
ALL_NUMBERS = tuple(sorted(RULES))
MIGRATION_NUMBERS = tuple(n for n in ALL_NUMBERS if ANALYZER[n] == "migration")


def corpus(files_sql: str, lines: bool = True) -> str:
    """CTEs ``corpus``, ``texts`` and ``lines`` over a files query."""
    out = f"""corpus AS MATERIALIZED ({files_sql}),
texts AS (SELECT file_id, src AS c, regexp_replace(stored_name, '\\.[^.]*$', '') AS stem
          FROM corpus WHERE src IS NOT NULL)"""
    if lines:
        out += f""",
cut AS (SELECT file_id, string_split(c, chr(10)) AS ls FROM texts),
plain AS (SELECT file_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS line FROM cut),
lines AS MATERIALIZED (SELECT file_id, line, l, {_trim('l')} AS t FROM plain)"""
    return out


def hits(numbers=ALL_NUMBERS, failures: bool = True) -> str:
    """CTE ``hits(file_id, step, line, number, c1, c2, c3)``."""
    selects = []
    for n in numbers:
        rule = RULES[n]
        if rule.level == FALLBACK:
            continue
        caps = (CAPTURES.get(n, []) + ["NULL"] * 3)[:3]
        cols = ", ".join(f"CAST({e} AS VARCHAR) AS c{i + 1}" for i, e in enumerate(caps))
        if rule.level == FILE:
            selects.append(f"SELECT file_id, {STEP[n]} AS step, 1 AS line, {n} AS number, {cols} "
                           f"FROM texts WHERE {FILE_TESTS[n]}")
        else:
            selects.append(f"SELECT file_id, {STEP[n]} AS step, line, {n} AS number, {cols} "
                           f"FROM lines WHERE {LINE_TESTS[n]}")
    body = "\nUNION ALL ".join(selects)
    out = f"found AS MATERIALIZED ({body})"
    more = []
    if 49 in numbers:
        more.append("SELECT file_id, 12, 1, 49, NULL, NULL, NULL FROM texts "
                    "WHERE file_id NOT IN (SELECT file_id FROM found WHERE number BETWEEN 33 AND 48)")
    if failures:
        more.append(f"SELECT file_id, 0, 0, 0, {quoted(UNREADABLE)}, NULL, NULL FROM corpus WHERE src IS NULL")
    return out + ",\nhits AS (SELECT * FROM found" + "".join(f"\nUNION ALL {m}" for m in more) + ")"


def _template(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS VARCHAR)"
    pieces, slots = split_template(text)
    parts = []
    for piece, slot in zip(pieces, slots):
        if piece:
            parts.append(quoted(piece))
        if slot:
            parts.append(f"c{slot}")
    return " || ".join(parts)


def _by_number(field: str, numbers) -> str:
    whens = []
    for n in numbers:
        if n == 0:
            severity, rule, message = fixed.ANALYSIS_ERROR
            value = {"severity": severity, "rule": rule, "message": message + "<1>"}.get(field)
        else:
            value = SEVERITY[n] if field == "severity" else getattr(RULES[n], field)
        if value is not None:
            whens.append(f"WHEN {n} THEN {_template(value)}")
    if not whens:
        return "CAST(NULL AS VARCHAR)"
    return f"CASE number {' '.join(whens)} END"


def issues(numbers=ALL_NUMBERS, failures: bool = True) -> str:
    """CTE ``issues`` with every issue column, ``seq`` and ``number``."""
    known = (0, *numbers) if failures else numbers
    fields = {"line": "CAST(line AS BIGINT)", "diff": "CAST(NULL AS VARCHAR)"}
    cols = ", ".join(f"{fields.get(f) or _by_number(f, known)} AS {f}" for f in ISSUE_COLUMNS)
    return (hits(numbers, failures) + ",\nissues AS (SELECT file_id, number, CAST(row_number() OVER "
            f"(PARTITION BY file_id ORDER BY step, line, number) AS INTEGER) AS seq, {cols} FROM hits)")


def all_issues(files_sql: str) -> str:
    return (f"WITH {corpus(files_sql)},\n{issues()}\n"
            f"SELECT file_id, seq, {', '.join(ISSUE_COLUMNS)} FROM issues")


def issue_rows(files_sql: str) -> str:
    steps = " ".join(f"WHEN {n} THEN {step}" for n, step in STEP.items())
    return (f"WITH {corpus(files_sql)},\n{issues()}\n"
            f"SELECT file_id, CAST(CASE number {steps} ELSE 0 END AS INTEGER) AS step, CAST(number AS INTEGER) AS number, "
            f"{', '.join(ISSUE_COLUMNS)} FROM issues")


def one_rule(files_sql: str, number: int) -> str:
    numbers = MIGRATION_NUMBERS if number == 49 else (number,)
    return (f"WITH {corpus(files_sql)},\n{issues(numbers, False)}\n"
            "SELECT file_id, line, severity, rule, message, suggestion, before_code, after_code "
            f"FROM issues WHERE number = {number}")


def _in(numbers) -> str:
    return "(" + ", ".join(map(str, numbers)) + ")"


ERRORS, WARNINGS, INFOS = (_in(SEVERITIES[s]) for s in ("error", "warning", "info"))
HINTS = _in(MIGRATION_NUMBERS)

# One row per file with its counts; null counts for an unreadable file.
COUNTS = f"""counts AS (
SELECT corpus.file_id, any_value(original_name) AS original_name, any_value(src) IS NULL AS failed,
       count(number) FILTER (number > 0) AS total_issues,
       count(*) FILTER (number IN {ERRORS}) AS errors,
       count(*) FILTER (number IN {WARNINGS}) AS warnings,
       count(*) FILTER (number IN {INFOS}) AS info,
       count(*) FILTER (number IN {HINTS}) AS migration_suggestions
FROM corpus LEFT JOIN hits ON hits.file_id = corpus.file_id GROUP BY corpus.file_id),
overview AS (SELECT *, CASE WHEN failed OR errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning'
                       ELSE 'success' END AS status FROM counts)"""
METRICS = ("total_issues", "errors", "warnings", "info", "migration_suggestions")


def _counted(files_sql: str) -> str:
    return f"WITH {corpus(files_sql)},\n{hits()},\n{COUNTS}\n"


_METRIC_COLUMNS = ", ".join(f"CASE WHEN NOT failed THEN {m} END AS {m}" for m in METRICS)


def file_metrics(files_sql: str) -> str:
    return _counted(files_sql) + f"SELECT file_id, {_METRIC_COLUMNS} FROM overview"


def file_status(files_sql: str) -> str:
    return _counted(files_sql) + "SELECT file_id, status FROM overview"


def file_overview(files_sql: str) -> str:
    return _counted(files_sql) + f"SELECT file_id, original_name, status, {_METRIC_COLUMNS} FROM overview"


def run_summary(files_sql: str) -> str:
    return _counted(files_sql) + (
        "SELECT count(*) FILTER (status = 'success') AS compliant, "
        "count(*) FILTER (status = 'warning') AS warnings, "
        "count(*) FILTER (status = 'error') AS errors, count(*) AS total_files FROM overview")


_STANDARDS = ", ".join(f"({i}, {quoted(s)})" for i, s in enumerate(fixed.STANDARDS))


def psr_compliance(files_sql: str) -> str:
    numbers = tuple(n for n in ALL_NUMBERS if ANALYZER[n] == "psr")
    return (f"WITH {corpus(files_sql)},\n{issues(numbers, False)},\n"
            f"standards(no, standard) AS (VALUES {_STANDARDS})\n"
            "SELECT texts.file_id, standard, count(number) = 0 AS compliant, count(number) AS issues_count "
            "FROM texts CROSS JOIN standards LEFT JOIN issues ON issues.file_id = texts.file_id "
            "AND starts_with(rule, standard || '.') GROUP BY texts.file_id, standard")


def migration_summary(files_sql: str) -> str:
    return (f"WITH {corpus(files_sql)},\n{hits(MIGRATION_NUMBERS, False)},\n"
            "n AS (SELECT file_id, count(*) AS total FROM hits GROUP BY file_id)\n"
            "SELECT file_id, total AS total_suggestions, "
            "'{\"migration\":' || total || '}' AS by_category, '{\"8.4\":' || total || '}' AS php_versions, "
            "CASE WHEN total > 20 THEN 'high' WHEN total > 5 THEN 'medium' ELSE 'low' END AS complexity FROM n")


_DISPLAY = "CASE WHEN category = 'migration' THEN 'migration' ELSE severity END"


def display_totals(files_sql: str) -> str:
    cols = ", ".join(f"count(*) FILTER ({_DISPLAY} = '{c}') AS {name}" for c, name in (
        ("error", "errors"), ("warning", "warnings"), ("info", "info"), ("migration", "migration")))
    return f"WITH {corpus(files_sql)},\n{issues()}\nSELECT {cols} FROM issues"


def rule_counts(files_sql: str) -> str:
    values = ", ".join(
        f"({n}, {quoted(ANALYZER[n])}, {quoted(r.rule)}, {quoted(SEVERITY[n])}, {str(r.reachable).lower()})"
        for n, r in RULES.items())
    return (f"WITH {corpus(files_sql)},\n{hits()},\ncatalog(number, analyzer, rule, severity, reachable) AS "
            f"(VALUES {values})\nSELECT catalog.number, analyzer, rule, severity, reachable, "
            "count(hits.file_id) AS hits FROM catalog LEFT JOIN hits ON hits.number = catalog.number "
            "GROUP BY ALL")


def filtered(files_sql: str, where: str) -> str:
    return (f"WITH {corpus(files_sql)},\n{issues()}\n"
            f"SELECT file_id, seq, {', '.join(ISSUE_COLUMNS)} FROM issues WHERE {where}")


def display_filter(active) -> str:
    return f"{_DISPLAY} IN ({', '.join(quoted(a) for a in active)})"


def visible_files(files_sql: str, active) -> str:
    def shown(c):
        return f"count(*) FILTER ({_DISPLAY} = '{c}')" if c in active else "CAST(0 AS BIGINT)"

    cols = ", ".join(f"{shown(c)} AS {c}_shown" for c in ("error", "warning", "info", "migration"))
    return (f"WITH {corpus(files_sql)},\n{issues()}\n"
            f"SELECT corpus.file_id, any_value(original_name) AS original_name, {cols} FROM corpus "
            f"JOIN issues ON issues.file_id = corpus.file_id WHERE {display_filter(active)} "
            "GROUP BY corpus.file_id")


def rewrite_preview(files_sql: str) -> str:
    return (f"WITH {corpus(files_sql)},\n{issues(MIGRATION_NUMBERS, False)}\n"
            "SELECT file_id, line, rule, before_code, after_code FROM issues WHERE before_code IS NOT NULL")


def escape_html(files_sql: str) -> str:
    def esc(c):
        return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

    return (f"WITH {corpus(files_sql)},\n{issues(MIGRATION_NUMBERS, False)}\n"
            f"SELECT file_id, line, rule, {esc('before_code')} AS before_html, {esc('after_code')} AS after_html "
            "FROM issues WHERE before_code IS NOT NULL")


def migration_issues(files_sql: str) -> str:
    return (f"WITH {corpus(files_sql)},\n{issues(MIGRATION_NUMBERS, False)}\n"
            f"SELECT file_id, {', '.join(ISSUE_COLUMNS)} FROM issues")


def failed_files(files_sql: str) -> str:
    severity, rule, message = fixed.ANALYSIS_ERROR
    rows = [("run", severity, message, 0, rule, None)]
    for name, (sev, code, line, text, suggestion) in fixed.ANALYZER_ERRORS.items():
        rows.append((name, sev, text, line, code, suggestion))
    values = ", ".join(
        f"({quoted(a)}, {quoted(s)}, {quoted(m + UNREADABLE if m.endswith(': ') else m)}, "
        f"CAST({n} AS BIGINT), {quoted(r)}, CAST({quoted(g)} AS VARCHAR))" for a, s, m, n, r, g in rows)
    return (f"WITH corpus AS ({files_sql}) SELECT file_id, original_name, v.* FROM corpus, "
            f"(VALUES {values}) v(analyzer, severity, message, line, rule, suggestion) WHERE src IS NULL")


def report_json(files_sql: str) -> str:
    def obj(fields: dict[str, str]) -> str:
        """JSON object text without the null fields."""
        parts = [f"CASE WHEN {e} IS NULL THEN NULL ELSE '\"{k}\":' || CAST(to_json({e}) AS VARCHAR) END"
                 for k, e in fields.items()]
        return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"

    issue = obj({f: f for f in ISSUE_COLUMNS})
    number_of = "(SELECT count(*) FROM h WHERE h.file_id = o.file_id AND {0})"
    return (
        f"WITH {corpus(files_sql)},\n{issues()},\n{COUNTS},\n"
        f"rows AS (SELECT file_id, seq, number, rule, {issue} AS issue FROM issues),\n"
        "per_file AS (SELECT file_id, string_agg(issue, ',' ORDER BY seq) AS all_issues,\n"
        + ",\n".join(
            f"  count(*) FILTER (number BETWEEN 1 AND 13 AND starts_with(rule, '{s}.')) AS n{i}"
            for i, s in enumerate(fixed.STANDARDS))
        + " FROM rows GROUP BY file_id)\n"
        "SELECT o.file_id, 0 AS part, 1 AS parts, '{\"name\":\"' || o.original_name || '\",\"path\":\"' || "
        "k.stored_name || '\",\"status\":\"' || o.status || '\",\"issues\":[' || p.all_issues || '],' || "
        "CASE WHEN o.failed THEN '\"psr_compliance\":[]' ELSE '\"psr_compliance\":[' || "
        + " || ',' || ".join(
            f"'{{\"standard\":\"{s}\",\"compliant\":' || CASE WHEN n{i} = 0 THEN 'true' ELSE 'false' END || "
            f"',\"issues_count\":' || n{i} || '}}'" for i, s in enumerate(fixed.STANDARDS))
        + " || '],\"migration_summary\":{\"total_suggestions\":' || migration_suggestions || "
        "',\"by_category\":{\"migration\":' || migration_suggestions || '},\"php_versions\":{\"8.4\":' || "
        "migration_suggestions || '},\"complexity\":\"' || CASE WHEN migration_suggestions > 20 THEN 'high' "
        "WHEN migration_suggestions > 5 THEN 'medium' ELSE 'low' END || '\"},\"metrics\":{' || "
        + " || ',' || ".join(f"'\"{m}\":' || {m}" for m in METRICS)
        + " || '}' END || '}' AS report FROM overview o JOIN per_file p ON p.file_id = o.file_id "
        "JOIN corpus k ON k.file_id = o.file_id")


# ----------------------------------------------------------- gate, names, findings

_STATUS = " ".join(f"WHEN status = {k} THEN {quoted(v)}" for k, v in gate.TRANSFER_ERRORS.items())
_BASE = "regexp_extract(original_name, '([^/]*)/*$', 1)"
_EXT = f"regexp_extract({_BASE}, '\\.([^.]*)$', 1)"
_ERROR = (f"CASE WHEN status <> 0 THEN CASE {_STATUS} ELSE {quoted(gate.UNKNOWN_TRANSFER_ERROR)} END "
          f"WHEN original_name IS NULL OR original_name IN ('', '0') THEN {quoted(gate.NAME_MISSING)} "
          f"WHEN lower({_EXT}) <> 'php' THEN {quoted(gate.BAD_EXTENSION)} "
          f"WHEN size > 5242880 THEN {quoted(gate.TOO_BIG)} END")
CHECKED = f"WITH up AS ({rendered.UPLOADS}), checked AS (SELECT *, {_ERROR} AS error FROM up) "
VALIDATE = CHECKED + "SELECT upload_id, original_name, status, size, error FROM checked"
REJECTS = CHECKED + "SELECT upload_id, original_name, error FROM checked WHERE error IS NOT NULL"
CLIENT = (f"WITH up AS ({rendered.UPLOADS}) SELECT upload_id, original_name FROM up "
          "WHERE original_name LIKE '%.php'")
GATE = (CHECKED + ", per AS (SELECT batch_id, count(*) AS total_files, count(error) AS rejected "
        "FROM checked GROUP BY batch_id) SELECT batch_id, (rejected = 0 AND total_files > 0) AS success, "
        f"CASE WHEN rejected > 0 THEN {quoted(gate.VALIDATION_FAILED[0])} END AS error_code, "
        f"CASE WHEN rejected > 0 THEN {quoted(gate.VALIDATION_FAILED[1])} END AS message, "
        "total_files - rejected AS accepted, rejected, total_files FROM per")
def _digest(*parts: str) -> str:
    shown = ", ".join(f"coalesce(length(CAST({p} AS VARCHAR)), -1) || ':' || coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"substr(sha256(concat_ws('|', {shown})), 1, 16)"


_HEX = _digest("original_name", "unix_time", "batch_id", "upload_id")
_STEM = f"regexp_replace({_BASE}, '\\.[^.]*$', '')"
_STORED = f"{_STEM} || '_' || unix_time || '_' || {_HEX} || '.' || {_EXT}"
STRICT = ("batch_id NOT IN (SELECT batch_id FROM checked WHERE error IS NOT NULL)")


def manifest(strict: bool) -> str:
    where = "error IS NULL" + (f" AND {STRICT}" if strict else "")
    return (CHECKED + f"SELECT upload_id, original_name, {_STORED} AS stored_name, "
            f"'uploads/' || {_STORED} AS path, size, mime_type FROM checked WHERE {where}")


GATE_RUN = (CHECKED + "SELECT (count(error) = 0 AND count(*) > 0) AS success, "
            f"CASE WHEN count(*) = 0 THEN {quoted(gate.NO_FILES[0])} WHEN count(error) > 0 THEN "
            f"{quoted(gate.VALIDATION_FAILED[0])} END AS error_code, "
            f"CASE WHEN count(*) = 0 THEN {quoted(gate.NO_FILES[1])} WHEN count(error) > 0 THEN "
            f"{quoted(gate.VALIDATION_FAILED[1])} END AS message, "
            "count(*) - count(error) AS accepted, count(error) AS rejected, count(*) AS total_files FROM checked")
PATH_PARTS = (f"WITH up AS ({rendered.UPLOADS}) SELECT upload_id, {_BASE} AS base_name, {_STEM} AS stem, "
              f"{_EXT} AS extension FROM up")
STORED_NAME = (f"WITH up AS ({rendered.UPLOADS}) SELECT upload_id, {_STORED} AS stored_name, "
               f"'report_' || unix_time || '_' || {_digest('upload_id', 'unix_time')} AS report_id FROM up")
STORED_NAMES_UNIQUE = (f"WITH up AS ({rendered.UPLOADS}) SELECT count(*) AS uploads, count(*) AS names "
                       "FROM up WHERE original_name IS NOT NULL")
_SIZE = ("CASE WHEN size < 1024 THEN size || ' Bytes' "
         "WHEN size < 1048576 THEN regexp_replace(CAST(round(size / 1024.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' KB' "
         "WHEN size < 1073741824 THEN regexp_replace(CAST(round(size / 1048576.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' MB' "
         "ELSE regexp_replace(CAST(round(size / 1073741824.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' GB' END")
FORMAT_SIZE = f"WITH up AS ({rendered.UPLOADS}) SELECT upload_id, size, {_SIZE} AS shown FROM up"

LISTING = f"""
SELECT CASE WHEN upload_id % 53 = 1 THEN concat('uploads/old/', CAST(upload_id AS STRING), '.php')
            WHEN upload_id % 53 = 2 THEN concat('uploads/.hidden', CAST(upload_id AS STRING))
            WHEN upload_id % 5 = 3 THEN concat('reports/report_', CAST(unix_time AS STRING), '.json')
            ELSE concat('uploads/f', CAST(upload_id AS STRING), '.php') END AS path, size
FROM ({rendered.UPLOADS}) up
"""


def purge_plan(target: str) -> str:
    return (f"SELECT '{target}' AS target, path, size FROM ({LISTING}) WHERE "
            f"regexp_matches(path, '^{target}/[^./][^/]*$')")


def purge_summary(target: str) -> str:
    return (f"SELECT {quoted(target)} AS target, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes "
            f"FROM ({purge_plan(target)})")



def _case(column: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


_F = "coalesce(fixer, '')"
# The options of the fixer rules that have some.
FIXER_OPTIONS = {
    "array_syntax": '{"syntax":"short"}',
    "blank_line_before_statement": '{"statements":["return"]}',
    "class_attributes_separation": '{"elements":{"method":"one"}}',
    "concat_space": '{"spacing":"one"}',
    "no_mixed_echo_print": '{"use":"echo"}',
}
FIXER = (
    f"SELECT finding_id, fixer, CASE WHEN {_F} IN ({', '.join(map(quoted, normalize.ERROR_FIXERS))}) "
    f"THEN 'error' WHEN {_F} IN ({', '.join(map(quoted, normalize.WARNING_FIXERS))}) THEN 'warning' "
    "ELSE 'info' END AS severity, "
    + _case(_F, {k: v[0] for k, v in normalize.FIXER_TEXTS.items()},
            f"{quoted(normalize.FIXER_MESSAGE)} || {_F}") + " AS message, "
    + _case(_F, {k: v[1] for k, v in normalize.FIXER_TEXTS.items()}, quoted(normalize.FIXER_SUGGESTION))
    + f" AS suggestion, {_F} IN ({', '.join(map(quoted, normalize.FIXER_RULES))}) AS enabled, "
    + _case(_F, FIXER_OPTIONS, "NULL") + " AS options "
    f"FROM ({rendered.FIXER_FINDINGS})"
)


def _words(text: str, words, glue: str) -> str:
    return "(" + f" {glue} ".join(f"{text} LIKE '%{w}%'" for w in words) + ")"


_S = "lower(coalesce(message, ''))"
STATIC = (
    f"SELECT finding_id, message, CASE WHEN coalesce(ignorable, false) THEN 'warning' "
    f"WHEN {_words(_S, normalize.STATIC_ERROR_WORDS, 'OR')} THEN 'error' "
    f"WHEN {_words(_S, normalize.STATIC_WARNING_WORDS, 'OR')} THEN 'warning' ELSE 'error' END AS severity, CASE "
    + " ".join(f"WHEN {_words(_S, w, 'AND')} THEN {quoted(t)}" for w, t in normalize.STATIC_SUGGESTIONS)
    + f" END AS suggestion FROM ({rendered.STATIC_FINDINGS})"
)
SNIFFER = (
    "SELECT finding_id, source, message, CASE "
    + " ".join(f"WHEN coalesce(source, '') LIKE '%{p}%' OR {_S} LIKE '%{w}%' THEN {quoted(t)}"
               for p, w, t in normalize.SNIFFER_SUGGESTIONS)
    + f" ELSE {quoted(normalize.SNIFFER_DEFAULT)} END AS suggestion FROM ({rendered.SNIFFER_FINDINGS})"
)
DIFF = f"""WITH f AS ({rendered.DIFF_FINDINGS}),
cut AS (SELECT finding_id, string_split(diff, chr(10)) AS ls FROM f),
x AS (SELECT finding_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS line_no FROM cut)
SELECT finding_id, CAST(line_no AS INTEGER) AS line_no,
       CASE WHEN l LIKE '-%' THEN '{normalize.DIFF_REMOVED[0]}' ELSE '{normalize.DIFF_ADDED[0]}' END AS rule,
       CASE WHEN l LIKE '-%' THEN '{normalize.DIFF_REMOVED[1]}' ELSE '{normalize.DIFF_ADDED[1]}' END AS message,
       CASE WHEN l LIKE '-%' THEN '{normalize.DIFF_REMOVED[2]}' ELSE '{normalize.DIFF_ADDED[2]}' END
           || {_trim(r"regexp_extract(l, '^[-+]\s*(.+)$', 1)")} AS suggestion,
       l AS diff
FROM x WHERE regexp_matches(l, '^[-+]\\s*(.+)$') AND NOT contains(l, '--- Original') AND NOT contains(l, '+++ New')
"""

SCAN_LINES = f"""WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM cut)
SELECT doc_id AS file_id, CAST(n AS INTEGER) AS line_no, l AS line, CAST(strlen(l) AS INTEGER) AS bytes,
       CAST(strlen({_RTRIM}) AS INTEGER) AS trimmed_bytes FROM x"""


def scan_corpus(files_sql: str) -> str:
    return (f"WITH corpus AS ({files_sql}) SELECT file_id, original_name, stored_name, "
            "CAST(strlen(src) AS BIGINT) AS size, CAST(len(string_split(src, chr(10))) AS INTEGER) AS n_lines "
            "FROM corpus")


def rule_pack(files_sql: str) -> str:
    """The user's pack of ``queries.USER_PACK``, written out."""
    return (f"WITH {corpus(files_sql)}\nSELECT file_id, CAST(line AS BIGINT) AS line, 'info' AS severity, 'team.output' AS rule, "
            f"'Output of ' || {_x(r'(echo|print)\s', 1)} AS message, 'Use the logger' AS suggestion, "
            "CAST(NULL AS VARCHAR) AS before_code, CAST(NULL AS VARCHAR) AS after_code "
            f"FROM lines WHERE {_m(r'(echo|print)\s')}")


def report_replaced(files_sql: str) -> str:
    return f"SELECT * FROM ({all_issues(files_sql)}) WHERE file_id % 2 = 0"


_HIDDEN = "CASE file_id % 10 WHEN 1 THEN '_' WHEN 2 THEN '.' ELSE '' END"


def read_tree(files_sql: str) -> str:
    """Files of the landed tree: every seventh is gone before it is read, large ones are not opened."""
    return (f"WITH corpus AS ({files_sql}), landed AS (SELECT {_HIDDEN} || original_name AS original_name, file_id, src, "
            "CAST(strlen(src) AS BIGINT) AS size FROM corpus WHERE src IS NOT NULL), judged AS (SELECT *, "
            f"CASE WHEN size > {rendered.READ_LIMIT} THEN {quoted(gate.TOO_BIG)} WHEN file_id % 7 = 3 THEN "
            f"{quoted(tree.GONE)} END AS error FROM landed) SELECT original_name, size, error, "
            "CASE WHEN error IS NULL THEN CAST(len(string_split(src, chr(10))) AS INTEGER) END AS n_lines FROM judged")


def failed_reads(files_sql: str) -> str:
    severity, rule, message = fixed.ANALYSIS_ERROR
    return (f"SELECT original_name, {quoted(severity)} AS severity, {quoted(rule)} AS rule, {quoted(message)} || error AS message, "
            f"CAST(0 AS BIGINT) AS line FROM ({read_tree(files_sql)}) WHERE error IS NOT NULL")


def file_ordinals(files_sql: str) -> str:
    return (f"SELECT file_id, original_name, row_number() OVER (ORDER BY original_name, file_id) AS ordinal "
            f"FROM ({files_sql})")


def in_order(files_sql: str, rows_sql: str) -> str:
    """Rows of files with the place of their file by name."""
    return (f"SELECT r.*, o.ordinal FROM ({rows_sql}) r "
            f"JOIN (SELECT file_id, ordinal FROM ({file_ordinals(files_sql)})) o ON r.file_id = o.file_id")


def every_file(files_sql: str) -> str:
    """Who brings each file: hidden names and directories and empty files come by reconciling."""
    metrics = "total_issues, errors, warnings, info, migration_suggestions"
    return (f"WITH own AS ({files_sql}), landed AS (SELECT file_id, {_HIDDEN} AS hidden, src FROM own WHERE src IS NOT NULL), "
            "renamed AS (SELECT o.file_id, l.hidden || o.original_name AS original_name, l.hidden || o.original_name AS stored_name, "
            "o.src FROM own o JOIN landed l ON o.file_id = l.file_id) "
            "SELECT CASE WHEN l.hidden <> '' OR l.file_id % 9 = 0 OR l.src = '' THEN 'r-' ELSE 's-' END || (l.file_id % 2) AS batch_id, "
            f"x.original_name, x.status, {', '.join('x.' + m.strip() for m in metrics.split(','))} "
            f"FROM ({file_overview('SELECT * FROM renamed')}) x JOIN landed l ON x.file_id = l.file_id")


def batch_reports(files_sql: str) -> str:
    """One batch: per file its status and metrics, standards, migration grade and number of issue rows."""
    return (f"SELECT 's-0' AS batch_id, f.* EXCLUDE (original_name), c.compliant_standards, c.standard_issues, "
            "m.total_suggestions, m.complexity, i.issue_rows, s.total_files "
            f"FROM ({file_overview(files_sql)}) f "
            "LEFT JOIN (SELECT file_id, CAST(count_if(compliant) AS BIGINT) AS compliant_standards, CAST(sum(issues_count) AS BIGINT) AS standard_issues "
            f"FROM ({psr_compliance(files_sql)}) GROUP BY file_id) c ON f.file_id = c.file_id "
            f"LEFT JOIN ({migration_summary(files_sql)}) m ON f.file_id = m.file_id "
            f"LEFT JOIN (SELECT file_id, count(*) AS issue_rows FROM ({all_issues(files_sql)}) GROUP BY file_id) i ON f.file_id = i.file_id "
            f"CROSS JOIN ({run_summary(files_sql)}) s")


def rule_statistics(*corpora: str) -> str:
    """Rule frequencies of several corpora, with the files each rule hits and the number of runs."""
    rows = " UNION ALL ".join(f"SELECT * FROM ({rule_counts(c)})" for c in corpora)
    named = " UNION ALL ".join(
        f"SELECT {i} AS run, number, file_id FROM (WITH {corpus(c)},\n{hits()}\nSELECT DISTINCT number, file_id FROM hits)"
        for i, c in enumerate(corpora))
    return (f"WITH counted AS ({rows}), held AS (SELECT number, count(*) AS files FROM ({named}) GROUP BY number) "
            "SELECT counted.number, analyzer, rule, severity, reachable, CAST(sum(hits) AS BIGINT) AS hits, "
            "CAST(max(coalesce(files, 0)) AS BIGINT) AS files, "
            f"CAST({len(corpora)} AS BIGINT) AS runs FROM counted LEFT JOIN held ON held.number = counted.number "
            "GROUP BY ALL")


def retention(files_sql: str, first: int, day: int, done: bool) -> str:
    """Four daily runs; the oldest is beyond the last three and older than 60 hours."""
    runs = (f"SELECT CAST({first} + d * {day} AS BIGINT) AS unix_time, "
            f"count(f.file_id) AS total_files, CAST(4 - d AS BIGINT) AS place, d = 0 AS remove "
            f"FROM range(4) r(d) LEFT JOIN ({files_sql}) f ON f.file_id % 4 = d GROUP BY d")
    if not done:
        return runs
    return f"SELECT unix_time, total_files, 0 AS failures FROM ({runs}) WHERE NOT remove"
