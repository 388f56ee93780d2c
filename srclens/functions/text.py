"""Byte-exact text helpers, all plain Column expressions.

Rules see a file as bytes.  Decoding those bytes as ISO-8859-1 gives a string
with exactly one character per byte, so Java regexes and ``length`` behave
byte-wise and no byte sequence is ever invalid.  ``to_utf8`` turns captured
pieces of that view back into readable text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN1 = "ISO-8859-1"

# The six bytes that trim/rtrim strip (space, tab, LF, CR, NUL, VT).
TRIM_CHARS = " \t\n\r\x00\x0b"
# The whitespace class of the rule patterns (space, tab, LF, VT, FF, CR).
SPACE_CHARS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def byte_view(content: Column) -> Column:
    """Binary (or UTF-8 string) column -> one-character-per-byte string."""
    return F.decode(content.cast("binary"), LATIN1)


def to_utf8(view: Column) -> Column:
    """Piece of a byte view -> UTF-8 text; stray bytes become U+FFFD."""
    return F.make_valid_utf8(F.encode(view, LATIN1).cast("string"))


def rx(pattern: str) -> Column:
    """Pattern literal with LF as the only line terminator."""
    return F.lit("(?d)" + pattern)


def has(text: Column, literal: str) -> Column:
    return F.contains(text, F.lit(literal))


def rtrimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(TRIM_CHARS))


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(TRIM_CHARS))


def up_to_last(text: Column, literal: str) -> Column:
    """Text up to and including the last ``literal``, '' without one.

    A pattern that has to end in it finds the same first match there, and a long
    tail without it can no longer make the search quadratic.
    """
    tail = F.substring_index(text, literal, -1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(tail))


def is_blank(text: Column) -> Column:
    """Empty in the loose sense: '' and '0' both count as nothing."""
    return text.isin("", "0")


def ends_in_space(text: Column) -> Column:
    test = F.endswith(text, F.lit(SPACE_CHARS[0]))
    for ch in SPACE_CHARS[1:]:
        test = test | F.endswith(text, F.lit(ch))
    return test


def base_name(path: Column) -> Column:
    """Last path component."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Text after the last dot of the base name, '' without a dot."""
    return F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def studly(name: Column) -> Column:
    """MAX_SIZE -> MaxSize."""
    words = F.replace(F.lower(name), F.lit("_"), F.lit(" "))
    return F.replace(F.initcap(words), F.lit(" "), F.lit(""))


def human_size(size: Column) -> Column:
    """Byte count -> '0 Bytes', '1.5 KB', ... (base 1024, at most two decimals)."""
    n = size.cast("double")

    def shown(divisor: int, unit: str) -> Column:
        number = F.round(n / F.lit(float(divisor)), 2).cast("string")
        return F.concat(F.regexp_replace(number, r"\.0$", ""), F.lit(" " + unit))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" Bytes")))
        .when(size < 1024**2, shown(1024, "KB"))
        .when(size < 1024**3, shown(1024**2, "MB"))
        .otherwise(shown(1024**3, "GB"))
    )


def escape_html(text: Column) -> Column:
    """Escape & < > (quotes stay as they are)."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def stored_name(original: Column, unix_time: Column, *key: Column) -> Column:
    """``<stem>_<unix time>_<16 hex>.<ext>``.

    The hex part is a digest of the upload's ``key``, which names it among all
    uploads (batch and number, say): names differ, and a retry gives the same one.
    """
    return F.concat(
        file_stem(original), F.lit("_"), unix_time.cast("string"), F.lit("_"),
        hex16(original, unix_time, *key), F.lit("."), extension(original),
    )


def report_id(unix_time: Column, *parts: Column) -> Column:
    """``report_<unix time>_<16 hex>`` from run parameters."""
    return F.concat(
        F.lit("report_"), unix_time.cast("string"), F.lit("_"), hex16(*parts, unix_time)
    )


def hex16(*parts: Column) -> Column:
    # A null and a text are told apart, and so are parts that hold the separator.
    joined = F.concat_ws("|", *[F.concat(F.coalesce(F.length(p.cast("string")), F.lit(-1)).cast("string"), F.lit(":"),
                                         F.coalesce(p.cast("string"), F.lit(""))) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def report_time(report: Column) -> Column:
    """Timestamp inside a report id, null when the id has none."""
    seconds = F.nullif(F.regexp_extract(report, r"_(\d+)_", 1), F.lit(""))
    return F.timestamp_seconds(seconds.cast("long"))
