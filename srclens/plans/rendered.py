"""Corpora rendered from the given tables, as SQL text that Spark and DuckDB share.

``part`` has one row per part; each row is rendered as one PHP file whose lines
depend on the row.  ``orders`` gives upload metadata and ``events`` gives raw
tool findings.  The same SQL string runs unchanged in both engines, so a query
and its oracle start from identical text.
"""

from __future__ import annotations

import re

# Characters that SQL literals of the two engines treat differently.
_SPECIAL = {"\n": "chr(10)", "\t": "chr(9)", "\r": "chr(13)", "'": "chr(39)", "\\": "chr(92)"}


def sql_text(text: str) -> str:
    """Python text -> SQL expression; ``«expr»`` inserts an SQL expression."""
    parts = []
    for i, piece in enumerate(re.split(r"«(.*?)»", text, flags=re.S)):
        if i % 2:
            parts.append(f"CAST({piece} AS STRING)")
            continue
        for token in re.split(r"([\n\t\r'\\]|\$(?=\{))", piece):
            if token in _SPECIAL:
                parts.append(_SPECIAL[token])
            elif token:
                parts.append(f"'{token}'")
    return "concat(" + ", ".join(parts or ["''"]) + ")"


# (condition or None, lines): the file is the concatenation of the lines whose
# condition holds.  k = p_partkey.
_K = "p_partkey"
_LINES: list[tuple[str | None, str]] = [
    ("k % 11 = 4", "\n"),
    ("k % 13 = 1", "\ufeff"),
    ("k % 19 <> 5", "<?php\n"),
    ("k % 19 = 5", "<? // short tag «p_name»\n"),
    ("k % 7 = 2", "// declare ( strict_types = 1 ) only in a comment\n"),
    ("k % 7 > 2", "declare(strict_types=1);\n\n"),
    ("k % 9 <> 3 AND k % 5 = 1", "namespace Parts\\P«p_size»;\nuse Shared\\Base;\n"),
    ("k % 9 <> 3 AND k % 5 <> 1", "namespace Parts\\P«p_size»;\n\n"),
    ("k % 4 = 0", "use Alpha\\One;\nuse Beta\\Two;\n\n"),
    ("k % 4 = 1", "use Zeta\\Last;\nuse Alpha\\«replace(p_name, ' ', '')»;\n\n"),
    ("k % 4 = 2", "use Only\\«replace(p_brand, '#', '')»;\n\n"),
    ("p_type = 'PROMO'", "/**\n * «p_name» (é à ü) for «p_brand»\n */\n"),
    ("k % 3 = 0", "class Part«k»\n{\n"),
    ("k % 3 = 1", "class Part«k» {\n"),
    ("k % 3 = 2 AND p_size % 2 = 0", "final class Part«k» {\n"),
    ("k % 3 = 2 AND p_size % 2 = 1", "readonly class Part«k»\n{\n"),
    ("p_size < 10", "\tvar $tabbed«p_size»;\n"),
    ("p_size BETWEEN 10 AND 14", "  \t  $mixed = 1;\n"),
    ("k % 6 = 1", "    private int $count;\n    protected ?string $label ;\n"),
    ("k % 6 = 2", "    private readonly int $count;\n    public $open = 'x';\n"),
    ("k % 6 = 3", "    var $legacy;\n    public static $shared;\n"),
    ("p_type = 'SMALL'", "    const MAX_SIZE = 'v«p_size»';\n    const A1 = 'x';\n    const LIMIT = 5;\n"),
    ("p_type = 'LARGE'", "    const _IS__«upper(substr(p_name, 1, 3))» = \"«p_brand»\";\n"),
    ("p_size % 5 = 0", "    /**\n     * @param int|string $id\n     * @param «replace(p_name, ' ', '_')»|null $other\n     * @param int $plain\n     */\n"),
    ("k % 8 = 0", "    public function __construct($name, private int $size)\n    {\n"),
    ("k % 8 = 1", "    public function __construct(\n        $name\n    ) {\n"),
    ("k % 8 = 2", "    function run($a) {\n"),
    ("k % 8 = 3", "    public function run(int $a): int {\n"),
    ("k % 8 = 4", "    protected function run(array $a) { // opens\n"),
    ("k % 8 > 4", "    public function run«k»(int $a): void\n    {\n"),
    ("p_size % 7 = 1", "        echo $a;\n        print $this->count;\n        echo \"x\";\n        echo $1;\n"),
    ("p_size % 7 = 2", "        $p = blueprint();\n"),
    ("p_size % 7 = 3", "        $text = <<<XML\n<?xml version='1.0'?>\nXML;\n"),
    ("k % 10 = 0", "        $this->total = $item->price * «p_retailprice»;\n        Helper::call($b);\n"),
    ("k % 10 = 1", "        foreach ($rows as $row) {\n            each ($row);\n        }\n"),
    ("k % 10 = 2", "        $f = create_function ('$x', 'return $x;');\n        createFunction(); each_item($a);\n"),
    ("k % 10 = 3", "        if (is_array($a) && in_array('«p_brand»', array(1, 2, 3))) {\n            return $a;\n        }\n"),
    ("k % 10 = 4", "        $s = \"plain\"; $t = 'single';\n        $u = \"with $var\";\n        $v = \"a\\b\";\n"),
    ("k % 10 = 5", "        $a=1;\n        $b ==2;\n        return $a ;\n"),
    ("k % 10 = 6", "        return array_keys($«substr(p_name, 1, 3)») === range(0, 1);\n        $n = array_keys($a) == range(0, 1);\n"),
    ("k % 10 = 7", "        if (strpos( $a , '«p_name»' ) !== false) { }\n        if (strpos($é, 'ü') === 0) { }\n        if (strpos($a, 'b') != false) { }\n"),
    ("k % 10 = 8", "        if (substr($a, -strlen($b)) === $b) { }\n        if (substr($a, -strlen($b)) === $c) { }\n        if (substr( $h , -strlen( $n ) ) === $n) { }\n"),
    ("k % 10 = 9", "        switch ( $kind ) {\n            case «p_size»:\n                return $kind;\n        }\n        $m = match ($a) { default => 0 };\n"),
    ("p_size % 6 = 0", "        // ASYNC «p_name»\n        curl_multi_init();\n        curl_exec($c);\n        CURL_EXEC($c); curl_close($c);\n        $q = Promise::all();\n"),
    ("p_size % 6 = 1", "        $cb = array($this, 'do«p_size»');\n        $cc = array(Part::class , \"make\");\n        $cd = array($o, $m);\n"),
    ("p_size % 6 = 2", "        call_user_func(array($obj, 'go'));\n        call_user_func( array ($obj,  \"stop\" ), 1);\n        call_user_func(array($obj, $m));\n"),
    ("p_size % 6 = 3", "        $r = build(1, «p_retailprice», 'x');\n        if (check(1, 2, 3)) { }\n        if (a(1) && f(1, 2)) { }\n        for (g(1), h(2), 3;;) { }\n"),
    ("p_size % 6 = 4", "        list($x, $y) = $pair;\n        [$x, $y] = $pair;\n        if (array_is_list($z)) { }\n"),
    ("p_size % 12 = 5", "        // first-class callable\n        $k = new class (1) { };\n"),
    ("p_size > 44", "«repeat(concat('        $h', CAST(p_size AS STRING), ' = strpos($a, $b) !== false;', chr(10)), p_size - 30)»"),
    ("k % 15 = 2", "        // «repeat('abcdefghij', 12)»\n"),
    ("k % 15 = 3", "«repeat('é', 60)»     \n«repeat('é', 61)»\n"),
    ("k % 15 = 4", "        $long = '«repeat(p_name, 12)»';   \n"),
    ("k % 15 = 5", "    \n   $three = 3;\n0 \n     \n   \n"),
    ("k % 15 = 6", "        $pad = 1; \n        $tab = 2;\t\n"),
    (None, "    }\n}\n"),
    ("k % 6 = 0", "// end of «p_name»"),
]


def _piece(condition: str | None, lines: str) -> str:
    text = sql_text(re.sub(r"«k»", f"«{_K}»", lines))
    if condition is None:
        return text
    where = re.sub(r"\bk\b", _K, condition)
    return f"CASE WHEN {where} THEN {text} ELSE '' END"


_BODY = "concat(" + ",\n    ".join(_piece(c, t) for c, t in _LINES) + ")"

# Files of the rendered tree that are larger are not opened.
READ_LIMIT = 1200

_CLEAN = "<?php\n\ndeclare(strict_types=1);\n\nnamespace Parts\\Clean;\n\n// «p_name», «p_brand»\nreturn [];\n"
_TALKS = _CLEAN + "// echo «p_retailprice»\n"

# file_id, original_name, stored_name, unix_time, src.  Some files are clean, some
# only warn, some are empty, some unreadable (null), some use CRLF.
PART_FILES = f"""
SELECT p_partkey AS file_id,
       concat('Part', CAST(p_partkey AS STRING), '.php') AS original_name,
       CASE WHEN p_partkey % 2 = 0 THEN concat('Part', CAST(p_partkey AS STRING), '.php')
            ELSE concat('part_', CAST(1700000000 + p_partkey AS STRING), '_', substr(sha2_hex, 1, 16), '.php')
       END AS stored_name,
       1700000000 + p_partkey AS unix_time,
       CASE WHEN p_size = 50 AND p_type = 'LARGE' THEN ''
            WHEN p_size = 49 AND p_type = 'SMALL' THEN NULL
            WHEN p_size = 20 THEN {sql_text(_CLEAN)}
            WHEN p_size = 21 THEN {sql_text(_TALKS)}
            WHEN p_size = 33 THEN replace(src, chr(10), concat(chr(13), chr(10)))
            ELSE src END AS src
FROM (SELECT *, {_BODY} AS src, {{sha256}} AS sha2_hex FROM part) rendered_part
"""

# The text tables as corpora: every row is a file, its whole text is scanned.
DOCUMENT_FILES = """
SELECT doc_id AS file_id, concat('doc_', CAST(doc_id AS STRING), '.php') AS original_name,
       concat('doc_', CAST(doc_id AS STRING), '.php') AS stored_name, text AS src
FROM documents
"""
PAGE_FILES = """
SELECT page_id AS file_id, concat('page_', CAST(page_id AS STRING), '.php') AS original_name,
       concat('page_', CAST(page_id AS STRING), '.php') AS stored_name, html AS src
FROM pages
"""
CONVERSATION_FILES = """
SELECT concat(CAST(conv_id AS STRING), '/', CAST(turn AS STRING)) AS file_id,
       concat('turn_', CAST(conv_id AS STRING), '_', CAST(turn AS STRING), '.php') AS original_name,
       concat(role, '.php') AS stored_name, text AS src
FROM conversations
"""

# Upload metadata: one row per order; the customer is the batch.
UPLOADS = """
SELECT o_orderkey AS upload_id, o_custkey AS batch_id, o_orderstatus, o_totalprice,
       CASE WHEN o_orderkey % 97 = 0 THEN CAST(o_orderkey % 9 AS INT) ELSE 0 END AS status,
       CASE WHEN o_orderkey % 211 = 1 THEN ''
            WHEN o_orderkey % 211 = 2 THEN '0'
            WHEN o_orderkey % 211 = 3 THEN NULL
            WHEN o_orderkey % 13 = 10 THEN 'a/index.php'
            WHEN o_orderkey % 101 = 4 THEN concat('Order', CAST(o_orderkey AS STRING), '.inc')
            WHEN o_orderkey % 103 = 5 THEN concat('Order', CAST(o_orderkey AS STRING))
            WHEN o_orderkey % 107 = 6 THEN concat('dir.php/Order', CAST(o_orderkey AS STRING), '.php.txt')
            WHEN o_orderkey % 3 = 0 THEN concat('src/Order.', CAST(o_orderkey AS STRING), '.PHP')
            ELSE concat('Order', CAST(o_orderkey AS STRING), '.php') END AS original_name,
       CAST(CASE WHEN o_orderkey % 13 = 10 THEN 1000
                 WHEN o_orderkey % 59 = 7 THEN 5242880 + o_orderkey % 2
                 WHEN o_orderkey % 61 = 8 THEN floor(o_totalprice * 37)
                 WHEN o_orderkey % 67 = 9 THEN floor(o_totalprice / 1500)
                 ELSE floor(o_totalprice) END AS BIGINT) AS size,
       'application/x-php' AS mime_type,
       CASE WHEN o_orderkey % 13 = 10 THEN 1700000000 ELSE 1700000000 + o_orderkey END AS unix_time
FROM orders
"""

# Raw findings of external tools, one per event, with several finding shapes.
FIXER_FINDINGS = """
SELECT event_id AS finding_id,
       CASE CAST(event_id % 19 AS INT)
            WHEN 0 THEN 'declare_strict_types' WHEN 1 THEN 'no_unused_imports'
            WHEN 2 THEN 'no_empty_statement' WHEN 3 THEN 'php_unit_fqcn_annotation'
            WHEN 4 THEN 'array_syntax' WHEN 5 THEN 'single_quote'
            WHEN 6 THEN 'trailing_comma_in_multiline' WHEN 7 THEN 'ordered_imports'
            WHEN 8 THEN 'binary_operator_spaces' WHEN 9 THEN 'concat_space'
            WHEN 10 THEN 'method_argument_space' WHEN 11 THEN 'no_whitespace_in_blank_line'
            WHEN 12 THEN 'phpdoc_align' WHEN 13 THEN 'return_type_declaration'
            WHEN 14 THEN 'class_attributes_separation' WHEN 15 THEN concat('custom_', event_type)
            WHEN 16 THEN 'blank_line_before_statement' WHEN 17 THEN 'no_mixed_echo_print'
            ELSE NULL END AS fixer
FROM events
"""
STATIC_FINDINGS = """
SELECT event_id AS finding_id,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id % 11 = 3 END AS ignorable,
       CASE CAST(event_id % 14 AS INT)
            WHEN 0 THEN concat('Undefined variable: $', event_type)
            WHEN 1 THEN concat('Call to an UNDEFINED METHOD ', event_type, '::run()')
            WHEN 2 THEN 'Access to an undefined property Part::$x'
            WHEN 3 THEN concat('Parameter #1 of type int expects string, ', event_type, ' given')
            WHEN 4 THEN 'Method should return int but return type is missing'
            WHEN 5 THEN 'Call to deprecated function each()'
            WHEN 6 THEN 'PHPDoc tag has invalid value in doc comment'
            WHEN 7 THEN concat('Class ', event_type, ' not found')
            WHEN 8 THEN 'Property does not exist'
            WHEN 9 THEN concat('Value ', CAST(value AS STRING), ' is never read')
            WHEN 10 THEN NULL
            WHEN 11 THEN 'You should not use this'
            WHEN 12 THEN 'Function expects return type'
            ELSE 'Undefined offset of type array expects int' END AS message
FROM events
"""
SNIFFER_FINDINGS = """
SELECT event_id AS finding_id,
       CASE CAST(event_id % 13 AS INT)
            WHEN 0 THEN 'Generic.WhiteSpace.ScopeIndentation' WHEN 1 THEN 'Generic.Files.LineLength.TooLong'
            WHEN 2 THEN 'Squiz.WhiteSpace.TrailingWhitespace' WHEN 3 THEN 'PSR2.Classes.OpeningBrace'
            WHEN 4 THEN 'PSR12.BlankLine.Missing' WHEN 5 THEN 'PSR2.Methods.Visibility'
            WHEN 6 THEN 'PSR2.Namespaces.UseDeclaration' WHEN 7 THEN 'Squiz.Operators.SpaceAround'
            WHEN 8 THEN 'Squiz.Commenting.ClassComment' WHEN 9 THEN 'PSR12.Files.Declare'
            WHEN 10 THEN 'generic.indentation.lower' ELSE NULL END AS source,
       CASE CAST(event_id % 15 AS INT)
            WHEN 0 THEN 'Wrong INDENT found' WHEN 1 THEN 'The line is too wide'
            WHEN 2 THEN 'Extra whitespace' WHEN 3 THEN 'Brace misplaced'
            WHEN 4 THEN 'One blank needed' WHEN 5 THEN 'No visibility'
            WHEN 6 THEN concat('Bad use in ', event_type) WHEN 7 THEN 'Missing SPACE'
            WHEN 8 THEN 'Bad comment' WHEN 9 THEN 'Please declare it'
            WHEN 10 THEN NULL ELSE concat('Other ', event_type) END AS message
FROM events
"""
DIFF_FINDINGS = f"""
SELECT event_id AS finding_id, {sql_text(
    "--- Original" + chr(10) + "+++ New" + chr(10) + "@@ -1 +1 @@" + chr(10)
    + "- list($a, $«event_type») = $b;  " + chr(10) + "+  [$a, $«event_type»] = $b;" + chr(10)
    + " context" + chr(10) + "-" + chr(10) + "+   " + chr(10) + "-old «value»" + chr(10) + "+++ New again" + chr(10) + "--x"
)} AS diff
FROM events
"""


def part_files(engine: str) -> str:
    """The rendered corpus for ``spark`` or ``duckdb`` (the digest function is spelled differently)."""
    key = "CAST(p_partkey AS STRING)"
    digest = {"spark": f"sha2({key}, 256)", "duckdb": f"sha256({key})"}[engine]
    return PART_FILES.replace("{sha256}", digest)
