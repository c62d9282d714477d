"""Whole plans: from files to text."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..operators.pages import font_codes, font_tables, fonts, page_contents, page_fonts, page_streams, pages, with_metrics
from ..operators.tree import held
from ..sources.files import Scanned, objects, scan_files

PAGE = ["path", "page_index"]


def pages_of(scanned: Scanned) -> DataFrame:
    """Pages (operators.pages.pages) of scanned files, worked out once however often they are asked for."""
    if "pages" not in scanned.made:
        scanned.made["pages"] = pages(scanned, objects(scanned))
    return scanned.made["pages"]


def contents(scanned: Scanned) -> tuple[DataFrame, DataFrame]:
    """Pages of scanned files and their content (page_contents), worked out once however often they are asked for."""
    found = pages_of(scanned)
    if "contents" not in scanned.made:
        scanned.made["contents"] = held(page_contents(found, objects(scanned)), StorageLevel.MEMORY_AND_DISK)
    return found, scanned.made["contents"]


def page_runs(files: DataFrame | Scanned, fixed_width: bool = True, metrics: DataFrame | None = None, glyphs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages and placed strings of files (path, content), or of what scan_files made of them.

    metrics: of fonts that give no widths, see sources.metrics.font_metrics; without them, Courier has its own width and
    others half an em for each glyph. glyphs: a glyph list (functions.encodings.read_glyph_list) for names beyond the base encodings.
    """
    scanned = scan_files(files)
    all_pages, streams = contents(scanned)
    found = objects(scanned)
    known = fonts(found) if metrics is None else with_metrics(fonts(found), metrics)
    usable = page_fonts(all_pages, found).join(font_tables(known, glyphs), ["path", "font_obj"])
    return all_pages, layout.runs(layout.content_ops(streams.select(*PAGE, "content"), *PAGE), usable, PAGE, fixed_width)


def simple_text(files: DataFrame | Scanned) -> DataFrame:
    """path, page_index and text: decoded strings in the order they are painted. Pages without text are left out."""
    scanned = scan_files(files)
    all_pages, found = pages_of(scanned), objects(scanned)
    usable = page_fonts(all_pages, found).join(font_codes(found), ["path", "font_obj"])
    usable = usable.groupBy(*PAGE).agg(F.collect_list(F.struct("name", "encoding", "own")).alias("fonts"))
    return layout.simple_text(page_streams(all_pages, found, usable), PAGE)


def problems(files: DataFrame | Scanned) -> DataFrame:
    """path, page_index (null: the whole file), part (`file`, `object`, `font`, `stream` or `operations`) and error of what the text plans leave out, or cannot read in full."""
    scanned = scan_files(files)
    streams = contents(scanned)[1]
    ops = layout.content_ops(streams.select(*PAGE, "content"), *PAGE)
    said = lambda rows, index, part: rows.where("error is not null").select("path", index.cast("int").alias("page_index"), F.lit(part).alias("part"), "error")
    none, index = F.lit(None), F.col("page_index")
    odd = fonts(objects(scanned)).where("not supported").select("path", F.concat(F.lit("a font is decoded by its base encoding alone: "), F.coalesce("subtype", F.lit("no subtype"))).alias("error"))
    return said(scanned.files, none, "file").unionByName(said(objects(scanned), none, "object")).unionByName(said(odd, none, "font")).unionByName(said(streams, index, "stream")).unionByName(said(ops, index, "operations"))


def layout_text(files: DataFrame | Scanned, fixed_width: bool = True, tab_width: float | None = None, metrics: DataFrame | None = None, glyphs: DataFrame | None = None) -> DataFrame:
    """path, page_index and text as laid out: lines from the top down, gaps as spaces. Pages without text are left out.

    fixed_width: text at the columns of a fixed-width page, measured by a font's average width; else gaps measured by the
    width of a space. tab_width: columns from which a gap is a tab. metrics, glyphs: see page_runs; problems() tells what could not be read.
    """
    all_pages, parts = page_runs(files, fixed_width, metrics, glyphs)
    line, order = [*PAGE, "slope", "intercept"], ["op_idx", "sub_idx"]
    found = layout.blocks(parts, PAGE, tab_width)
    if fixed_width:
        left = all_pages.select(*PAGE, F.coalesce(F.get("cropbox", F.lit(0)), F.lit(0.0)).alias("left"))
        lines = layout.join_fixed(found.join(left, PAGE), line, order)
    else:
        lines = layout.join_flow(found, line, order, tab_width)
    return layout.page_text(lines, PAGE)
