"""Font metrics files, key-value lines and a line for each glyph, as a dimension of standard fonts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """font and line of the metrics files at path, one font a file."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.afm$", 1)
    return spark.read.text(path).select(name.alias("font"), F.col("value").alias("line"))


def glyph_metrics(lines: DataFrame) -> DataFrame:
    """font, code (null if the glyph has none), width and glyph of lines such as `C 32 ; WX 600 ; N space ; B 0 0 0 0 ;`."""
    part = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    code = part(r"^C (-?\d+) ;").cast("int")
    return lines.where(F.col("line").rlike(r"^C -?\d+ ;")).select("font", F.when(code >= 0, code).alias("code"), part(r"; WX (-?[\d.]+) ;").cast("double").alias("width"), part(r"; N (\S+) ").alias("glyph"))


def kern_pairs(lines: DataFrame) -> DataFrame:
    """font, left, right and move of lines such as `KPX A y -40`."""
    part = lambda i: F.regexp_extract("line", r"^KPX (\S+) (\S+) (-?[\d.]+)", i)
    return lines.where(F.col("line").startswith("KPX ")).select("font", part(1).alias("left"), part(2).alias("right"), part(3).try_cast("double").alias("move"))


#: Families that stand for a standard one, and the standard fonts' names by weight and slope.
FAMILIES = {"Arial": "Helvetica", "CourierNew": "Courier", "TimesNewRoman": "Times"}
STYLES = {"Helvetica": ("", "-Bold", "-Oblique", "-BoldOblique"), "Courier": ("", "-Bold", "-Oblique", "-BoldOblique"), "Times": ("-Roman", "-Bold", "-Italic", "-BoldItalic")}


def standard_name(font: Column) -> Column:
    """The standard font that a name stands for: without the mark of a subset (`ABCDEF+`), family names as FAMILIES has them, with any of `,`, `-`, `PS` and `MT` before or after the style. Other names stay as they are."""
    bare = F.regexp_replace(font, "^[A-Z]{6}[+]", "")
    family = F.regexp_extract(bare, "^(Arial|CourierNew|TimesNewRoman|Helvetica|Courier|Times)(PS)?(MT)?([,-]?(Bold)?(Italic|Oblique|Roman)?)(MT)?$", 1)
    family = F.coalesce(F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))[family], family)
    style = F.when(bare.contains("Bold"), 1).otherwise(0) + F.when(bare.rlike("Italic|Oblique"), 2).otherwise(0)
    styles = F.create_map(*(x for f, s in STYLES.items() for x in (F.lit(f), F.array(*map(F.lit, s)))))
    return F.when(family == "", bare).otherwise(F.concat(family, F.get(styles[family], style)))


def font_metrics(lines: DataFrame) -> DataFrame:
    """A row for each font of lines (font, line), as a font and its descriptor would have it.

    font, first_char, last_char, widths (from first to last, 0 where no glyph has the code), char_set (glyph names, in
    order), family, weight, flags, bbox, italic_angle, ascent, descent, cap_height, x_height, stem_v and stem_h.
    """
    glyphs = glyph_metrics(lines)
    names = glyphs.groupBy("font").agg(F.array_sort(F.collect_set("glyph")).alias("char_set"))
    coded = glyphs.where("code is not null").groupBy("font").agg(F.min("code").alias("first_char"), F.max("code").alias("last_char"), F.map_from_entries(F.collect_list(F.struct("code", "width"))).alias("by_code"))
    widths = F.transform(F.sequence("first_char", "last_char"), lambda c: F.coalesce(F.try_element_at("by_code", c), F.lit(0.0)))
    key = lambda k: F.max(F.when(F.col("line").startswith(k + " "), F.trim(F.expr(f"substring(line, {len(k) + 2})"))))
    number = lambda k: key(k).try_cast("double")
    special = F.coalesce(key("CharacterSet") == "Special", F.lit(False))
    flags = F.when(key("IsFixedPitch") == "true", 1).otherwise(0) + F.when(special, 4).otherwise(32) + F.when(F.coalesce(number("ItalicAngle"), F.lit(0.0)) != 0, 64).otherwise(0)
    bbox = F.transform(F.split(key("FontBBox"), r"\s+"), lambda x: x.try_cast("double"))
    heads = lines.groupBy("font").agg(
        key("FamilyName").alias("family"), key("Weight").alias("weight"), flags.alias("flags"), bbox.alias("bbox"), number("ItalicAngle").alias("italic_angle"), number("Ascender").alias("ascent"), number("Descender").alias("descent"),
        number("CapHeight").alias("cap_height"), number("XHeight").alias("x_height"), number("StdVW").alias("stem_v"), number("StdHW").alias("stem_h"),
    )
    return coded.select("font", "first_char", "last_char", widths.alias("widths")).join(names, "font").join(heads, "font", "left")
