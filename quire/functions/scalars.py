"""Scalar decoders of the object syntax as built-in column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.syntax import PDFDOC_FROM, PDFDOC_TO


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pdfdoc_decode(data: Column | str) -> Column:
    """Bytes of the document encoding as text."""
    return F.translate(F.decode(col(data), "ISO-8859-1"), PDFDOC_FROM, PDFDOC_TO)


def pdfdoc_encode(text: Column | str) -> Column:
    """Text as bytes of the document encoding, which it must be in."""
    return F.encode(F.translate(col(text), PDFDOC_TO, PDFDOC_FROM), "ISO-8859-1")


def string_text(data: Column | str) -> Column:
    """A string's text: UTF-16BE after its byte order mark, else the document encoding."""
    data = col(data)
    return F.when(F.hex(F.substring(data, 1, 2)) == "FEFF", F.decode(F.substring(data, 3, 2147483647), "UTF-16BE")).otherwise(pdfdoc_decode(data))


def hex_string(digits: Column | str) -> Column:
    """Bytes of a hexadecimal string's inside: white space goes, and an odd digit is followed by 0."""
    digits = F.regexp_replace(col(digits), r"[\x00\t\n\x0c\r ]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def name_text(token: Column | str) -> Column:
    """A name's text without its slash and with #XX as characters; null if what follows a # is not hexadecimal."""
    token = F.regexp_replace(col(token), "^/", "")
    return F.try_url_decode(F.replace(F.replace(F.replace(token, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B")), F.lit("#"), F.lit("%")))


def is_number(token: Column | str) -> Column:
    return col(token).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")


def integer_literal(token: Column | str) -> Column:
    """An integer token's value; null for any other token, and for one beyond 64 bits."""
    token = col(token)
    return F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast("bigint"))


def number_literal(token: Column | str) -> Column:
    """A number token's value as a double; null for any other token."""
    token = col(token)
    return F.when(is_number(token), token.try_cast("double"))


def boolean_literal(token: Column | str) -> Column:
    return F.when(col(token) == "true", True).when(col(token) == "false", False)


def comment_text(token: Column | str) -> Column:
    """What a comment says, up to its line's end; null for any other token."""
    return F.when(col(token).startswith("%"), F.regexp_extract(col(token), r"^%([^\r\n]*)", 1))


def int_from_bytes(data: Column | str) -> Column:
    """A big-endian unsigned integer of at most 7 bytes."""
    return F.conv(F.hex(col(data)), 16, 10).cast("bigint")


def header_version(content: Column | str) -> Column:
    """The version in a file's first line, in either of its two shapes."""
    head = F.decode(F.substring(col(content), 1, 64), "ISO-8859-1")
    return F.regexp_extract(head, r"^(?:%PDF-|%!PS-Adobe-\d\.\d PDF-)(\d\.\d)", 1).try_cast("decimal(3,1)")


def last_startxref(content: Column | str) -> Column:
    """The offset before the last %%EOF of a file's last 1,024 bytes."""
    tail = F.decode(F.substring(col(content), -1024, 1024), "ISO-8859-1")
    found = F.regexp_extract_all(tail, F.lit(r"startxref\s+(\d+)\s+%%EOF"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("bigint")


def xref_fields(line: Column | str) -> Column:
    """struct<position, generation, in_use> of a cross-reference line; null fields if it is malformed."""
    line, pattern = col(line), r"^(\d{10}) (\d{5}) ([nf])"
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    return F.struct(part(1).cast("bigint").alias("position"), part(2).cast("int").alias("generation"), (part(3) == "n").alias("in_use"))


# --- writing --------------------------------------------------------------------------------------------


def encode_array(items: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(col(items), " "), F.lit("]"))


def encode_dict(entries: Column | str) -> Column:
    """<<...>> of a map of names to encoded values."""
    pairs = F.transform(F.map_entries(col(entries)), lambda e: F.concat(F.lit("/"), e["key"], F.lit(" "), e["value"]))
    return F.concat(F.lit("<<"), F.array_join(pairs, " "), F.lit(">>"))


def encode_ref(number: Column | str, generation: Column | str) -> Column:
    return F.format_string("%d %d R", col(number), col(generation))


def encode_hex(data: Column | str) -> Column:
    return F.concat(F.lit("<"), F.hex(col(data)), F.lit(">"))


def encode_comment(text: Column | str) -> Column:
    """%... of text, line ends in it as spaces, and a line end."""
    return F.concat(F.lit("%"), F.regexp_replace(col(text), r"[\r\n]+", " "), F.lit("\n"))


def encode_literal(text: Column | str) -> Column:
    """(...) of text, with backslashes, parentheses and line ends escaped."""
    text = F.regexp_replace(col(text), r"([\\()])", r"\\$1")
    text = F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("("), text, F.lit(")"))


def encode_xref(position: Column | str, generation: Column | str, in_use: Column | str) -> Column:
    return F.format_string("%010d %05d %s\r\n", col(position), col(generation), F.when(col(in_use), "n").otherwise("f"))


def encode_boolean(value: Column | str) -> Column:
    """true, false, or null for null."""
    return F.coalesce(col(value).cast("string"), F.lit("null"))


def encode_real(value: Column | str) -> Column:
    """A number with at most six places and no zeros at the end; null for null."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", col(value).cast("double")), "0+$", ""), "[.]$", ""), F.lit("null"))
