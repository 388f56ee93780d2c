"""Raw findings of external tools -> the common issue columns.

Every tool log is a table with a ``finding_id``; the first matching test wins.
All texts are constants, so the lookups are literal maps and CASE chains
inside the projection: no join, no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.functions.text import has, trimmed

# Severity classes of fixer names; any other name is info.
ERROR_FIXERS = (
    "declare_strict_types", "no_unused_imports", "no_empty_statement", "php_unit_fqcn_annotation",
)
WARNING_FIXERS = (
    "array_syntax", "single_quote", "trailing_comma_in_multiline", "ordered_imports",
)

# Fixer name -> message, suggestion.
FIXER_TEXTS = {
    "declare_strict_types": ("Déclaration strict_types manquante",
                             "Ajoutez declare(strict_types=1); après <?php"),
    "array_syntax": ("Utilisation de la syntaxe array() au lieu de []",
                     "Remplacez array() par []"),
    "single_quote": ("Utilisation de guillemets doubles inutiles",
                     "Utilisez des guillemets simples quand possible"),
    "no_unused_imports": ("Imports inutilisés détectés",
                          "Supprimez les déclarations use inutilisées"),
    "ordered_imports": ("Les imports ne sont pas triés",
                        "Triez les imports par ordre alphabétique"),
    "trailing_comma_in_multiline": ("Virgule finale manquante dans les tableaux multilignes",
                                    "Ajoutez une virgule après le dernier élément"),
    "binary_operator_spaces": ("Espaces incorrects autour des opérateurs binaires",
                               "Ajoutez des espaces autour des opérateurs"),
    "concat_space": ("Espaces incorrects autour de l'opérateur de concaténation",
                     "Ajoutez un espace avant et après le point de concaténation"),
    "method_argument_space": ("Espaces incorrects dans les arguments de méthode",
                              "Vérifiez les espaces dans les paramètres de méthode"),
    "no_whitespace_in_blank_line": ("Espaces dans les lignes vides",
                                    "Supprimez les espaces des lignes vides"),
    "phpdoc_align": ("Alignement PHPDoc incorrect",
                     "Alignez correctement les commentaires PHPDoc"),
    "return_type_declaration": ("Espaces incorrects dans la déclaration de type de retour",
                                "Vérifiez les espaces autour du type de retour"),
}
FIXER_MESSAGE = "Problème de formatage détecté par "
FIXER_SUGGESTION = "Exécutez php-cs-fixer pour corriger automatiquement"

# Fixer name -> its options, or True where it is plainly on.
FIXER_RULES = {
    "@PSR12": True,
    "@PHP84Migration": True,
    "array_syntax": {"syntax": "short"},
    "binary_operator_spaces": True,
    "blank_line_after_opening_tag": True,
    "blank_line_before_statement": {"statements": ["return"]},
    "cast_spaces": True,
    "class_attributes_separation": {"elements": {"method": "one"}},
    "concat_space": {"spacing": "one"},
    "declare_strict_types": True,
    "function_typehint_space": True,
    "include": True,
    "lowercase_cast": True,
    "magic_constant_casing": True,
    "method_argument_space": True,
    "native_function_casing": True,
    "new_with_braces": True,
    "no_blank_lines_after_class_opening": True,
    "no_blank_lines_after_phpdoc": True,
    "no_empty_statement": True,
    "no_extra_blank_lines": True,
    "no_leading_import_slash": True,
    "no_leading_namespace_whitespace": True,
    "no_mixed_echo_print": {"use": "echo"},
    "no_multiline_whitespace_around_double_arrow": True,
    "no_short_bool_cast": True,
    "no_singleline_whitespace_before_semicolons": True,
    "no_spaces_around_offset": True,
    "no_trailing_comma_in_list_call": True,
    "no_trailing_comma_in_singleline_array": True,
    "no_unneeded_control_parentheses": True,
    "no_unused_imports": True,
    "no_whitespace_before_comma_in_array": True,
    "no_whitespace_in_blank_line": True,
    "normalize_index_brace": True,
    "object_operator_without_whitespace": True,
    "ordered_imports": True,
    "php_unit_fqcn_annotation": True,
    "phpdoc_align": True,
    "phpdoc_annotation_without_dot": True,
    "phpdoc_indent": True,
    "phpdoc_inline_tag": True,
    "phpdoc_no_access": True,
    "phpdoc_no_alias_tag": True,
    "phpdoc_no_empty_return": True,
    "phpdoc_no_package": True,
    "phpdoc_scalar": True,
    "phpdoc_separation": True,
    "phpdoc_single_line_var_spacing": True,
    "phpdoc_summary": True,
    "phpdoc_to_comment": True,
    "phpdoc_trim": True,
    "phpdoc_types": True,
    "phpdoc_var_without_name": True,
    "return_type_declaration": True,
    "semicolon_after_instruction": True,
    "short_scalar_cast": True,
    "single_blank_line_before_namespace": True,
    "single_class_element_per_statement": True,
    "single_line_comment_style": True,
    "single_quote": True,
    "space_after_semicolon": True,
    "standardize_not_equals": True,
    "ternary_operator_spaces": True,
    "trailing_comma_in_multiline": True,
    "trim_array_spaces": True,
    "unary_operator_spaces": True,
    "whitespace_after_comma_in_array": True,
}

FIXER_OPTIONS = {name: json.dumps(o, separators=(",", ":")) for name, o in FIXER_RULES.items() if o is not True}

# Words (lower case) that decide the severity of a static finding.
STATIC_ERROR_WORDS = ("undefined", "not found", "does not exist")
STATIC_WARNING_WORDS = ("deprecated", "should")
# Words that must all occur -> suggestion, in order.
STATIC_SUGGESTIONS = (
    (("undefined variable",), "Vérifiez que la variable est bien définie avant utilisation"),
    (("undefined method",), "Vérifiez que la méthode existe ou ajoutez-la à la classe"),
    (("undefined property",), "Vérifiez que la propriété existe ou déclarez-la dans la classe"),
    (("type", "expects"), "Vérifiez les types des paramètres passés à la fonction/méthode"),
    (("return", "type"), "Vérifiez que la valeur retournée correspond au type déclaré"),
    (("deprecated",), "Remplacez par une alternative moderne recommandée"),
    (("doc comment",), "Ajoutez ou corrigez la documentation PHPDoc"),
)

# Part of the source name, or word of the message -> suggestion, in order.
SNIFFER_SUGGESTIONS = (
    ("Indentation", "indent", "Utilisez 4 espaces pour l'indentation"),
    ("LineLength", "line", "Divisez la ligne en plusieurs lignes plus courtes"),
    ("TrailingWhitespace", "whitespace", "Supprimez les espaces en fin de ligne"),
    ("OpeningBrace", "brace", "Vérifiez la position des accolades selon PSR-12"),
    ("BlankLine", "blank", "Ajustez les lignes vides selon les conventions PSR"),
    ("Visibility", "visibility",
     "Ajoutez la visibilité (public, private, protected) à la propriété/méthode"),
    ("Use", "use", "Vérifiez l'ordre et la syntaxe des déclarations use"),
    ("Space", "space", "Ajustez les espaces selon les conventions PSR-12"),
    ("Comment", "comment", "Vérifiez le format et la syntaxe des commentaires"),
    ("Declare", "declare", "Ajoutez declare(strict_types=1); après l'ouverture PHP"),
)
SNIFFER_DEFAULT = "Consultez la documentation PSR-12 pour plus de détails"

# Headers that are not part of a diff, and texts of its two kinds of line.
DIFF_HEADERS = ("--- Original", "+++ New")
DIFF_REMOVED = ("deprecated_code", "Code obsolète détecté", "Moderniser selon PHP 8.4: ")
DIFF_ADDED = ("modernization", "Amélioration suggérée pour PHP 8.4", "Code moderne: ")


def _constant(table: dict[str, str], key: Column, default: Column) -> Column:
    lookup = F.create_map(*[c for k, v in table.items() for c in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(lookup, key), default)


def fixer_rules(spark: SparkSession) -> DataFrame:
    """The fixer rule set: name, enabled, options as JSON (null: none)."""
    rows = [(name, True, FIXER_OPTIONS.get(name)) for name in FIXER_RULES]
    return spark.createDataFrame(rows, "name STRING, enabled BOOLEAN, options STRING")


def normalize_fixer(findings: DataFrame) -> DataFrame:
    """``finding_id, fixer`` -> severity, message, suggestion, whether the rule is enabled, and its options."""
    name = F.coalesce(F.col("fixer"), F.lit(""))
    severity = F.when(name.isin(*ERROR_FIXERS), "error").when(
        name.isin(*WARNING_FIXERS), "warning").otherwise("info")
    messages = {k: v[0] for k, v in FIXER_TEXTS.items()}
    suggestions = {k: v[1] for k, v in FIXER_TEXTS.items()}
    return findings.select(
        "finding_id", "fixer", severity.alias("severity"),
        _constant(messages, name, F.concat(F.lit(FIXER_MESSAGE), name)).alias("message"),
        _constant(suggestions, name, F.lit(FIXER_SUGGESTION)).alias("suggestion"),
        name.isin(*FIXER_RULES).alias("enabled"),
        _constant(FIXER_OPTIONS, name, F.lit(None).cast("string")).alias("options"))


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    test = has(text, words[0])
    for w in words[1:]:
        test = test | has(text, w)
    return test


def normalize_static(findings: DataFrame) -> DataFrame:
    """``finding_id, message, ignorable`` -> severity and suggestion (null = none)."""
    text = F.lower(F.coalesce(F.col("message"), F.lit("")))
    severity = (
        F.when(F.coalesce(F.col("ignorable"), F.lit(False)), "warning")
        .when(_any_word(text, STATIC_ERROR_WORDS), "error")
        .when(_any_word(text, STATIC_WARNING_WORDS), "warning")
        .otherwise("error")
    )
    suggestion = F.lit(None).cast("string")
    for words, advice in reversed(STATIC_SUGGESTIONS):
        test = has(text, words[0])
        for w in words[1:]:
            test = test & has(text, w)
        suggestion = F.when(test, advice).otherwise(suggestion)
    return findings.select("finding_id", "message", severity.alias("severity"),
                           suggestion.alias("suggestion"))


def normalize_sniffer(findings: DataFrame) -> DataFrame:
    """``finding_id, source, message`` -> suggestion; the source is matched case-sensitively."""
    source = F.coalesce(F.col("source"), F.lit(""))
    text = F.lower(F.coalesce(F.col("message"), F.lit("")))
    suggestion = F.lit(SNIFFER_DEFAULT)
    for part, word, advice in reversed(SNIFFER_SUGGESTIONS):
        suggestion = F.when(has(source, part) | has(text, word), advice).otherwise(suggestion)
    return findings.select("finding_id", "source", "message", suggestion.alias("suggestion"))


def normalize_diff(findings: DataFrame) -> DataFrame:
    """``finding_id, diff`` -> one suggestion per removed or added line of the dry run."""
    lines = findings.select(
        "finding_id", F.posexplode(F.split(F.col("diff"), "\n", -1)).alias("pos", "line"))
    line = F.col("line")
    body = F.regexp_extract(line, r"(?d)^[-+]\s*(.+)$", 1)
    header = has(line, DIFF_HEADERS[0]) | has(line, DIFF_HEADERS[1])

    def pick(i: int) -> Column:
        return F.when(F.startswith(line, F.lit("-")), DIFF_REMOVED[i]).otherwise(F.lit(DIFF_ADDED[i]))

    return lines.where(~header & (body != "")).select(
        "finding_id", (F.col("pos") + 1).alias("line_no"), pick(0).alias("rule"),
        pick(1).alias("message"), F.concat(pick(2), trimmed(body)).alias("suggestion"),
        line.alias("diff"))
