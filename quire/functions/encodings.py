"""Character encodings and glyph names, built from Python's codecs and Unicode's character names where these tell them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.syntax import PDFDOC_FROM, PDFDOC_TO

#: Glyph names of characters that are neither letters with at most one mark nor digits, by code point.
SIGNS = {
    " ": "space", "!": "exclam", '"': "quotedbl", "#": "numbersign", "$": "dollar", "%": "percent", "&": "ampersand", "'": "quotesingle", "(": "parenleft", ")": "parenright", "*": "asterisk",
    "+": "plus", ",": "comma", "-": "hyphen", ".": "period", "/": "slash", ":": "colon", ";": "semicolon", "<": "less", "=": "equal", ">": "greater", "?": "question", "@": "at",
    "[": "bracketleft", "\\": "backslash", "]": "bracketright", "^": "asciicircum", "_": "underscore", "`": "grave", "{": "braceleft", "|": "bar", "}": "braceright", "~": "asciitilde",
    "¡": "exclamdown", "¢": "cent", "£": "sterling", "¤": "currency", "¥": "yen", "¦": "brokenbar", "§": "section", "¨": "dieresis", "©": "copyright",
    "ª": "ordfeminine", "«": "guillemotleft", "¬": "logicalnot", "®": "registered", "¯": "macron", "°": "degree", "±": "plusminus", "²": "twosuperior",
    "³": "threesuperior", "´": "acute", "µ": "mu", "¶": "paragraph", "·": "periodcentered", "¸": "cedilla", "¹": "onesuperior", "º": "ordmasculine",
    "»": "guillemotright", "¼": "onequarter", "½": "onehalf", "¾": "threequarters", "¿": "questiondown", "Æ": "AE", "Ð": "Eth", "×": "multiply", "Ø": "Oslash",
    "Þ": "Thorn", "ß": "germandbls", "æ": "ae", "ð": "eth", "÷": "divide", "ø": "oslash", "þ": "thorn", "ı": "dotlessi", "Ł": "Lslash", "ł": "lslash",
    "Œ": "OE", "œ": "oe", "ƒ": "florin", "ˆ": "circumflex", "ˇ": "caron", "˘": "breve", "˙": "dotaccent", "˚": "ring", "˛": "ogonek", "˜": "tilde",
    "˝": "hungarumlaut", "–": "endash", "—": "emdash", "‘": "quoteleft", "’": "quoteright", "‚": "quotesinglbase", "“": "quotedblleft", "”": "quotedblright",
    "„": "quotedblbase", "†": "dagger", "‡": "daggerdbl", "•": "bullet", "…": "ellipsis", "‰": "perthousand", "‹": "guilsinglleft", "›": "guilsinglright",
    "⁄": "fraction", "€": "Euro", "™": "trademark", "−": "minus", "ﬁ": "fi", "ﬂ": "fl",
}
#: Unicode's words for the marks of letters that glyph names write otherwise or alike.
MARKS = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron"}
DIGITS = "zero one two three four five six seven eight nine".split()
#: The glyphs of StandardEncoding from code 0xA1 on, a dot where it has none.
STANDARD_HIGH = """
exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl
. endash dagger daggerdbl periodcentered . paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand . questiondown
. grave acute circumflex tilde macron breve dotaccent dieresis . ring cedilla . hungarumlaut ogonek caron
emdash . . . . . . . . . . . . . . .
. AE . ordfeminine . . . . Lslash Oslash OE ordmasculine . . . .
. ae . . . dotlessi . . lslash oslash oe germandbls . . . .
""".split()
#: Characters of the Macintosh character set that its PDF encoding leaves out.
NOT_MAC = " ≠∞≤≥∂∑∏π∫Ω√≈∆◊"


def glyph_name(char: str) -> str | None:
    """The glyph name of a character, or None if it has none here."""
    if char in SIGNS:
        return SIGNS[char]
    if char.isascii():
        return DIGITS[int(char)] if char.isdigit() else char if char.isalpha() else None
    words = unicodedata.name(char, "").split(" WITH ")
    if len(words) != 2 or not words[0].startswith("LATIN ") or words[1] not in MARKS:
        return None
    letter = words[0].rpartition(" ")[2]
    return (letter if "CAPITAL" in words[0] else letter.lower()) + MARKS[words[1]]


@lru_cache(maxsize=1)
def tables() -> dict[str, dict[int, str]]:
    """Encoding name -> code -> character."""
    plain = {i: chr(i) for i in range(32, 127)}
    by_name = {glyph_name(chr(c)): chr(c) for c in [*range(32, 0x180)]} | {n: c for c, n in SIGNS.items()}
    standard = plain | {0x27: "’", 0x60: "‘"} | {0xA1 + i: by_name[n] for i, n in enumerate(STANDARD_HIGH) if n != "."}
    mac = plain | {i: c for i in range(128, 256) if (c := bytes([i]).decode("mac_roman")) not in NOT_MAC}
    mac[0xDB] = "¤"
    win = plain | {i: c for i in range(128, 256) if (c := bytes([i]).decode("cp1252", "ignore")) and i not in (0xA0, 0xAD)}
    doc = plain | {i: chr(i) for i in range(161, 256) if i != 0xAD} | {ord(a): b for a, b in zip(PDFDOC_FROM, PDFDOC_TO, strict=True)}
    return {"StandardEncoding": standard, "MacRomanEncoding": mac, "WinAnsiEncoding": win, "PDFDocEncoding": doc}


def base_encodings(spark: SparkSession) -> DataFrame:
    """encoding, code, glyph and text of the four base encodings: under 1,000 rows."""
    return spark.createDataFrame([(e, c, glyph_name(t), t) for e, table in tables().items() for c, t in sorted(table.items())], "encoding string, code int, glyph string, text string")


def glyph_list(spark: SparkSession) -> DataFrame:
    """glyph and text of every glyph that a base encoding has."""
    return spark.createDataFrame(sorted({(glyph_name(t), t) for table in tables().values() for t in table.values()}), "glyph string, text string")


def base_tables(spark: SparkSession) -> DataFrame:
    """encoding, and glyphs and texts as arrays of 256 by code: four rows."""
    by_code = lambda table, of: [of(table[c]) if c in table else None for c in range(256)]
    return spark.createDataFrame([(e, by_code(t, glyph_name), by_code(t, str)) for e, t in tables().items()], "encoding string, glyphs array<string>, texts array<string>")


def read_glyph_list(spark: SparkSession, path: str) -> DataFrame:
    """glyph and text of the glyph list files at path, see glyph_lines."""
    return glyph_lines(spark.read.text(path).select(F.col("value").alias("line")))


def glyph_lines(lines: DataFrame) -> DataFrame:
    """glyph and text of lines (line) such as `Aacute;00C1` or `lamvav;05DC 05D5`: a name and UTF-16 units of four hex digits. Lines that start with # are comments, others that do not fit are left out; of a name's texts the least counts."""
    units = F.replace(F.regexp_extract("line", r"^[^#;][^;]*;\s*((?:[0-9A-Fa-f]{4}\s*)+)$", 1), F.lit(" "), F.lit(""))
    rows = lines.select(F.trim(F.substring_index("line", ";", 1)).alias("glyph"), F.regexp_replace(units, r"\s", "").alias("units")).where("units <> ''")
    return rows.groupBy("glyph").agg(F.min(F.decode(F.unhex("units"), "UTF-16BE")).alias("text"))


def numbered_glyph(glyph: Column) -> Column:
    """The text of a glyph that is named by number: `uni` and UTF-16 units of four hex digits, or `u` and a code point of four to six; null if neither."""
    units, point = F.regexp_extract(glyph, "^uni((?:[0-9A-F]{4})+)$", 1), F.regexp_extract(glyph, "^u([0-9A-F]{4,6})$", 1)
    wide = F.lpad(point, 8, "0")
    return F.when(units != "", F.decode(F.unhex(units), "UTF-16BE")).when((point != "") & (wide <= "0010FFFF"), F.decode(F.unhex(wide), "UTF-32"))


def glyph_texts(rows: DataFrame, by: list[str], listed: DataFrame) -> DataFrame:
    """rows (by, one row each, and glyph) with text: what the glyph's name says.

    What follows the first dot is a variant's mark; the rest are names joined by `_`, each looked up in listed (glyph,
    text), else read as a number. The texts are joined; text is null if no part has one.
    """
    names = F.split(F.regexp_extract("glyph", r"^[^.]*", 0), "_")
    parts = rows.select(*by, F.posexplode(names).alias("_at", "_name")).join(listed.select(F.col("glyph").alias("_name"), F.col("text").alias("_listed")), "_name", "left")
    said = parts.withColumn("_text", F.coalesce("_listed", numbered_glyph(F.col("_name")))).where("_text is not null")
    texts = said.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda p: p["_text"]), "").alias("text"))
    return rows.join(texts, by, "left")


def char_codes(encoded: DataFrame) -> DataFrame:
    """encoding, glyph and code: the other way round, the lowest code of each glyph of rows (encoding, code, glyph)."""
    return encoded.groupBy("encoding", "glyph").agg(F.min("code").alias("code"))
