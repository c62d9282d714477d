"""Writes files in the format that the scan reads: fixtures for tests and queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codecs import flate_encode
from .syntax import encode_value, escape, string_value


def ref(number: int) -> dict:
    return {"t": "ref", "n": number, "g": 0}


def string(data: bytes) -> dict:
    return string_value(data)


def xref_line(position: int, generation: int, in_use: bool) -> bytes:
    return b"%010d %05d %s\r\n" % (position, generation, b"n" if in_use else b"f")


def object_bytes(number: int, value: object, stream: bytes | None = None) -> bytes:
    body = encode_value(value if stream is None else {**value, "Length": len(stream)})
    tail = b"" if stream is None else b"\nstream\n" + stream + b"\nendstream"
    return b"%d 0 obj\n%s%s\nendobj\n" % (number, body, tail)


def file_bytes(objects: dict[int, object], root: int = 1, info: int | None = None, version: str = "1.4", before: bytes = b"", as_stream: bool = False, trailer: dict | None = None) -> bytes:
    """A file of objects: number -> value or (dictionary, stream data). before: a file that this one revises.

    as_stream: a cross-reference stream, and all but streams in an object stream. trailer: more entries of it.
    """
    out = bytearray(before or b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode())
    places: dict[int, tuple[int, int, int]] = {}
    packed = [n for n, v in objects.items() if as_stream and not isinstance(v, tuple)]
    for n, v in objects.items():
        if n not in packed:
            places[n] = 1, len(out), 0
            out += object_bytes(n, *(v if isinstance(v, tuple) else (v,)))
    top = max([*objects, 0]) + 1
    trailer = {"Size": top, "Root": ref(root)} | ({"Info": ref(info)} if info else {}) | (trailer or {})
    if before:
        trailer["Prev"] = int(before.rpartition(b"startxref")[2].split()[0])
    start = len(out)
    if not as_stream:
        out += b"xref\n"
        if not before:
            out += b"0 1\n" + xref_line(0, 65535, False)
        for n in sorted(places):
            out += b"%d 1\n" % n + xref_line(places[n][1], 0, True)
        out += b"trailer\n" + encode_value(trailer) + b"\n"
    else:
        bodies = [encode_value(objects[n]) for n in packed]
        starts = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
        head = b" ".join(b"%d %d" % (n, s) for n, s in zip(packed, starts, strict=True)) + b"\n"
        places[top] = 1, len(out), 0
        out += object_bytes(top, {"Type": "ObjStm", "N": len(packed), "First": len(head), "Filter": "FlateDecode"}, flate_encode(head + b" ".join(bodies)))
        places |= {n: (2, top, i) for i, n in enumerate(packed)}
        places[top + 1] = 1, len(out), 0
        start = len(out)
        rows = b"".join(k.to_bytes(1, "big") + a.to_bytes(4, "big") + b.to_bytes(2, "big") for _, (k, a, b) in sorted(places.items()))
        numbers = sorted(places)
        index = [x for n in numbers for x in (n, 1)]
        settings = {"Predictor": 12, "Columns": 7}
        out += object_bytes(top + 1, {**trailer, "Size": top + 2, "Type": "XRef", "W": [1, 4, 2], "Index": index, "Filter": "FlateDecode", "DecodeParms": settings}, flate_encode(rows, settings))
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start


#: The font of fixtures: every glyph is 600 wide.
COURIER = {"Type": "Font", "Subtype": "Type1", "BaseFont": "Courier", "Encoding": "WinAnsiEncoding", "FirstChar": 0, "LastChar": 255, "Widths": [600] * 256}


def pages_file(contents: list[bytes], font: dict | None = None, deflate: bool = True, **how: object) -> bytes:
    """One page for each content stream, all with font F1 and the media box of the page tree's root."""
    objects: dict[int, object] = {1: {"Type": "Catalog", "Pages": ref(2)}, 3: font or COURIER}
    objects[2] = {"Type": "Pages", "Kids": [ref(4 + 2 * i) for i in range(len(contents))], "Count": len(contents), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": ref(3)}}}
    for i, content in enumerate(contents):
        objects[4 + 2 * i] = {"Type": "Page", "Parent": ref(2), "Contents": ref(5 + 2 * i)}
        objects[5 + 2 * i] = ({"Filter": "FlateDecode"}, flate_encode(content)) if deflate else ({}, content)
    return file_bytes(objects, **how)


def paint_lines(text: str, size: int = 12, ends: bool = True) -> bytes:
    """A content stream that shows a text's lines one below the other. ends: each line's string holds its line end."""
    lines = text.split("\n")
    shown = [line + "\n" * (ends and i + 1 < len(lines)) for i, line in enumerate(lines)]
    body = b"".join(b"(" + escape(s.encode("cp1252", "replace")) + b") Tj T*\n" if s else b"T*\n" for s in shown)
    return b"BT /F1 %d Tf %d TL 36 720 Td\n" % (size, size + 2) + body + b"ET\n"


def files_of(texts: Column, paint: Callable[[str], bytes] = paint_lines, font: dict | None = None) -> Column:
    """The bytes of a file with a page for each of texts (array of strings)."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda pages: None if pages is None else pages_file([paint(t or "") for t in pages], font))

    return run(texts)
