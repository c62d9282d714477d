"""The document source, in two steps: cross-references first, then objects by byte range.

Step one reads a file's cross-references and cuts its bytes into pieces that begin and end between objects. Which objects
count, the newest of each number, is an aggregation over the cross-reference rows of all files. Step two joins those
with the pieces and parses every piece in a task of its own, so that a large file spreads over the cluster; members of
object streams come from a join of their numbers with the decoded streams. A file or object that cannot be read gives
a row with an error, never a failed job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, values
from ..functions.codecs import FilterError, decode, decode_streams
from ..operators.tree import computed, cut, held
from .syntax import SyntaxFault, statements, value_at

#: Largest file that is scanned.
MAX_FILE = 1 << 30
#: A piece starts at the first object of each stretch of so many bytes.
PIECE = 1 << 20
#: Cross-references in one row.
ENTRIES = 20_000
_START = re.compile(rb"startxref[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+%%EOF")
_VERSION = re.compile(rb"%PDF-(\d\.\d)|%!PS-Adobe-\d\.\d PDF-(\d\.\d)")
_SECTION = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[ \t]+(\d+)[ \t]*[\r\n]+")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{10}) (\d{5}) ([nf])")
_TRAILER = re.compile(rb"[\x00\t\n\x0c\r ]*trailer")
_OBJECT_START = re.compile(rb"[\x00\t\n\x0c\r ]*\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj")
_ENDSTREAM = re.compile(rb"[\x00\t\n\x0c\r ]*endstream")
_FAULTS = (SyntaxFault, FilterError, ValueError, KeyError, TypeError, IndexError, RecursionError)

_ENTRY_TYPE = pa.struct([("seq", pa.int32()), ("obj_no", pa.int32()), ("generation", pa.int32()), ("position", pa.int64()), ("in_use", pa.bool_()), ("container", pa.int32())])
_STRUCTURE = pa.schema([
    ("path", pa.string()), ("version", pa.string()), ("startxref", pa.int64()), ("error", pa.string()), ("revision", pa.int32()), ("trailer", pa.string()), ("readable", pa.bool_()),
    ("entries", pa.list_(_ENTRY_TYPE)), ("piece", pa.int64()), ("base", pa.int64()), ("data", pa.binary()),
])
STRUCTURE = (
    "path string, version string, startxref long, error string, revision int, trailer string, readable boolean, "
    "entries array<struct<seq: int, obj_no: int, generation: int, position: bigint, in_use: boolean, container: int>>, piece long, base long, data binary"
)
_OBJECT = pa.schema([
    ("path", pa.string()), ("obj_no", pa.int32()), ("generation", pa.int32()), ("position", pa.int64()), ("type", pa.string()), ("subtype", pa.string()), ("json", pa.string()), ("stream", pa.binary()),
    ("filters", pa.list_(pa.string())), ("params", pa.string()), ("error", pa.string()), ("length_obj", pa.int32()), ("up_to_end", pa.int64()),
])
OBJECT = "path string, obj_no int, generation int, position long, type string, subtype string, json string, stream binary, filters array<string>, params string, error string, length_obj int, up_to_end long"


def name_of(value: object) -> str | None:
    return value["v"] if isinstance(value, dict) and value.get("t") == "name" else None


# --- step one -------------------------------------------------------------------------------------------


@dataclass
class Entries:
    """Columns of cross-references."""

    obj_no: np.ndarray
    generation: np.ndarray
    position: np.ndarray
    in_use: np.ndarray
    container: np.ndarray  # -1: none

    def arrow(self, first: int, last: int) -> pa.Array:
        cut = slice(first, last)
        container = pa.array(self.container[cut].astype(np.int32), mask=self.container[cut] < 0)
        columns = [pa.array(x.astype(t)) for x, t in ((np.arange(first, min(last, len(self.obj_no))), np.int32), (self.obj_no[cut], np.int32), (self.generation[cut], np.int32), (self.position[cut], np.int64), (self.in_use[cut], bool))]
        return pa.StructArray.from_arrays([*columns, container], fields=list(_ENTRY_TYPE))


def table(content: bytes, at: int) -> tuple[Entries, dict]:
    """The cross-reference table at a place, and its trailer."""
    at += 4
    rows: list[tuple] = []
    while m := _SECTION.match(content, at):
        at, first, n = m.end(), int(m[1]), int(m[2])
        for i in range(n):
            if not (m := _ENTRY.match(content, at)):
                raise SyntaxFault("a cross-reference line is malformed")
            at = m.end()
            rows.append((first + i, int(m[2]), int(m[1]), m[3] == b"n", -1))
    m = _TRAILER.match(content, at)
    trailer = value_at(content, m.end()) if m else {}
    return Entries(*np.array(rows, np.int64).reshape(-1, 5).T), trailer if isinstance(trailer, dict) else {}


def table_stream(content: bytes, at: int, known: dict) -> tuple[Entries, dict]:
    """The cross-reference stream at a place; its dictionary is its trailer."""
    _, _, head, data, _ = indirect(content, at)
    if not isinstance(head, dict) or name_of(head.get("Type")) != "XRef" or data is None:
        raise SyntaxFault("startxref points at no cross-references")
    data = decode(data, *chain(head), known)
    widths, pairs = head["W"], head.get("Index") or [0, head.get("Size", 0)]
    size = max(1, sum(widths))
    cells = np.frombuffer(data[: len(data) // size * size], np.uint8).reshape(-1, size).astype(np.int64)
    edges, fields = np.cumsum([0, *widths]), []
    for a, b in zip(edges, edges[1:], strict=False):
        fields.append(sum((cells[:, i] << (8 * (b - 1 - i)) for i in range(a, b)), np.zeros(len(cells), np.int64)))
    kind = fields[0] if widths[0] else np.ones(len(cells), np.int64)
    numbers = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + min(n, len(cells))) for a, n in zip(pairs[::2], pairs[1::2], strict=False))])[: len(cells)]
    n, packed = len(numbers), kind[: len(numbers)] == 2
    entries = Entries(numbers, np.where(packed, 0, fields[2][:n]), np.where(packed, fields[2][:n], fields[1][:n]), (kind[:n] == 1) | packed, np.where(packed, fields[1][:n], -1))
    return entries, {k: v for k, v in head.items() if k not in ("Length", "Filter", "DecodeParms", "W", "Index", "Type")}


def revisions(content: bytes, known: dict) -> tuple[int, list[tuple[Entries, dict]]]:
    """Where the newest cross-references start, and entries and trailer of all revisions, the newest first."""
    found = _START.findall(content[-1024:]) or _START.findall(content)
    if not found:
        raise SyntaxFault("no startxref")
    start = int(found[-1])
    ahead, seen, out = [start], set(), []
    while ahead:
        at = ahead.pop(0)
        if at in seen or not 0 <= at < len(content):  # a revision that points back at a later one
            continue
        seen.add(at)
        out.append(table(content, at) if content.startswith(b"xref", at) else table_stream(content, at, known))
        ahead = [x for k in ("XRefStm", "Prev") if type(x := out[-1][1].get(k)) is int] + ahead
    return start, out


def structure(path: str, content: bytes | None, known: dict) -> Iterator[dict]:
    """Rows of a file: itself, its revisions' cross-references, and the pieces with its objects."""
    file = {"path": path, "version": None, "startxref": None, "error": None}
    if content is None or len(content) > MAX_FILE:
        yield file | {"error": "no content" if content is None else "the file is too large"}
        return
    head = _VERSION.search(content[:1024])
    file["version"] = (head[1] or head[2]).decode() if head else None
    try:
        file["startxref"], sections = revisions(content, known)
    except _FAULTS as e:
        yield file | {"error": str(e)[:200] or type(e).__name__}
        return
    encrypted = any("Encrypt" in trailer for _, trailer in sections)
    yield file | {"error": "encrypted" if encrypted else None}
    for i, (entries, trailer) in enumerate(sections):
        said = json.dumps(trailer)
        for first in range(0, max(len(entries.obj_no), 1), ENTRIES):
            yield {"path": path, "revision": i, "trailer": said, "readable": not encrypted, "entries": entries.arrow(first, first + ENTRIES)}
    if encrypted:
        return
    places = np.unique(np.concatenate([np.zeros(0, np.int64), *(e.position[(e.in_use != 0) & (e.container < 0)] for e, _ in sections)]))
    places = np.array([p for p in places if 0 <= p < len(content) and _OBJECT_START.match(content, p)], np.int64)
    numbers, first = np.unique(places // PIECE, return_index=True)
    edges = [*places[first], len(content)]
    for number, a, b in zip(numbers, edges, edges[1:], strict=False):
        yield {"path": path, "piece": int(number), "base": int(a), "data": content[a:b]}


def _structure_batch(rows: list[dict]) -> pa.RecordBatch:
    none = pa.array([], _ENTRY_TYPE)
    parts = [r.get("entries", none) for r in rows]
    offsets = pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32))
    columns = [pa.array([r.get(f.name) for r in rows], f.type) if f.name != "entries" else pa.ListArray.from_arrays(offsets, pa.concat_arrays([none, *parts])) for f in _STRUCTURE]
    return pa.RecordBatch.from_arrays(columns, schema=_STRUCTURE)


def _batched(rows: Iterator[dict], size_of, make, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most 1,000, and of bytes not far over most."""
    held_rows, size = [], 0
    for row in rows:
        held_rows.append(row)
        size += size_of(row)
        if size > most or len(held_rows) >= 1000:
            yield make(held_rows)
            held_rows, size = [], 0
    if held_rows:
        yield make(held_rows)


# --- step two -------------------------------------------------------------------------------------------


def indirect(data: bytes, at: int) -> tuple[int, int, object, bytes | None, tuple[int, int] | None]:
    """number, generation, value and stream data of the object at a place. If its length is in another object: that one's number, and how many bytes there are up to the first word that may end the stream; the data then go on beyond."""
    reader = statements(data, at)
    operands, key, _ = next(reader, ([], None, 0))
    if key != "obj" or len(operands) < 2 or not all(type(x) is int for x in operands[-2:]):
        raise SyntaxFault(f"no object at {at}")
    number, generation = operands[-2:]
    operands, key, at = next(reader, ([], None, 0))
    value = operands[0] if operands else None
    if key != "stream":
        return number, generation, value, None, None
    at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] in (b"\n", b"\r")
    size = value.get("Length") if isinstance(value, dict) else None
    if type(size) is int and _ENDSTREAM.match(data, at + size):
        return number, generation, value, data[at : at + size], None
    end = data.find(b"endstream", at)
    if end < 0:
        raise SyntaxFault("a stream has no end")
    up_to = len(data[at:end].removesuffix(b"\n").removesuffix(b"\r"))
    if isinstance(size, dict) and size.get("t") == "ref":
        return number, generation, value, data[at:], (size["n"], up_to)
    return number, generation, value, data[at : at + up_to], None  # a wrong length: up to the word


def chain(head: dict) -> tuple[list[str], list[dict | None]]:
    """Names and parameters of a stream's filters."""
    names, params = head.get("Filter"), head.get("DecodeParms")
    names = [n for n in map(name_of, names if isinstance(names, list) else [names]) if n]
    return names, [p if isinstance(p, dict) else None for p in (params if isinstance(params, list) else [params])]


def described(value: object) -> dict:
    kind = value if isinstance(value, dict) else {}
    return {"type": name_of(kind.get("Type")), "subtype": name_of(kind.get("Subtype")), "json": json.dumps(value)}


def parse_piece(path: str, base: int | None, data: bytes | None, wanted: list[dict]) -> Iterator[dict]:
    """The wanted (position, obj_no, generation) objects of a piece."""
    wanted = sorted(wanted, key=lambda w: w["position"])
    for w, after in zip(wanted, [*wanted[1:], None], strict=True):
        out = {"path": path} | w
        try:
            at = w["position"] - (base or 0)
            if data is None or not 0 <= at < len(data):
                raise SyntaxFault(f"no object at {w['position']}")
            number, _, value, stream, length = indirect(data, at)
            if number != w["obj_no"]:
                raise SyntaxFault(f"object {number} stands in its place")
            if length:  # the other object says how much of it
                out |= {"length_obj": length[0], "up_to_end": length[1]}
                if after:
                    stream = stream[: max(length[1], len(stream) - (len(data) - (after["position"] - base)))]
            if stream is not None and isinstance(value, dict):
                names, params = chain(value)
                out |= {"stream": stream, "filters": names, "params": json.dumps(params)}
                if "F" in value:  # never opened: the name comes from the file being read
                    out["error"] = "its data are in another file"
            yield out | described(value)
        except _FAULTS as e:
            yield out | {"error": str(e)[:200]}


def members(path: str, head: str | None, data: bytes | None, wanted: list[dict], error: str | None) -> Iterator[dict]:
    """The wanted objects of an object stream, of which head is the dictionary and data what it holds."""
    places: dict[int, int] = {}
    try:
        if data is None:
            raise SyntaxFault(error or "there is no such object stream")
        settings = json.loads(head)
        numbers = next(statements(data), ([], None, 0))[0][: 2 * settings["N"]] if settings["N"] else []
        places = {n: settings["First"] + at for n, at in zip(numbers[::2], numbers[1::2], strict=False)}
    except _FAULTS as e:
        error = str(e)[:200]
    for w in wanted:
        out = {"path": path} | w
        try:
            if w["obj_no"] not in places:
                raise SyntaxFault(error or "its object stream lacks it")
            yield out | described(value_at(data, places[w["obj_no"]]))
        except _FAULTS as e:
            yield out | {"error": str(e)[:200]}


def _object_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _OBJECT], schema=_OBJECT)


def _object_size(row: dict) -> int:
    return len(row.get("stream") or b"") + len(row.get("json") or "")


@dataclass
class Scanned:
    """Files after step one; the objects are parsed when they are first asked for, and then the rows of step one, with the files' bytes, are given back."""

    structure: DataFrame
    listed: DataFrame  # of structure, what is not a piece: rows without the files' bytes
    made: dict[str, DataFrame] = field(default_factory=dict)  # what plans have worked out of it

    @property
    def files(self) -> DataFrame:
        """path, version, startxref and error of each file."""
        return self.listed.where("revision is null").select("path", "version", "startxref", "error")

    @property
    def trailers(self) -> DataFrame:
        """path, revision and trailer (a variant)."""
        return self.listed.where("revision is not null and coalesce(get(entries, 0).seq, 0) = 0").select("path", "revision", F.try_parse_json("trailer").alias("trailer"))

    @property
    def entries(self) -> DataFrame:
        return self.listed.where("revision is not null").select("path", "revision", "readable", F.inline("entries"))

    @property
    def newest(self) -> DataFrame:
        """path, obj_no, generation, position, in_use, container: the newest cross-reference of each object of a readable file."""
        return newest_entries(self.entries.where("readable"))

    @property
    def objects(self) -> DataFrame:
        if "objects" not in self.made:
            self.made["objects"] = settled(parsed_objects(self))
            self.structure.unpersist()
        return self.made["objects"]


def newest_entries(entries: DataFrame) -> DataFrame:
    """path, obj_no, generation, position, in_use and container of each object: of its cross-references (with revision, 0 the newest, and seq, their order in it) the first."""
    best = entries.groupBy("path", "obj_no").agg(F.min_by(F.struct("generation", "position", "in_use", "container"), F.struct("revision", "seq")).alias("e"))
    return best.select("path", "obj_no", "e.*")


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path and content of the files below a folder. Content is null, and not read, if it is longer than MAX_FILE: the scan gives such a file a row with the error `no content`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return sized(files)


def sized(files: DataFrame) -> DataFrame:
    """path and content of binary files; the content of those over MAX_FILE is null, and only their names are read."""
    fit = F.col("length") <= MAX_FILE
    return files.where(fit).select("path", "content").unionByName(files.where(~fit).select("path", F.lit(None).cast("binary").alias("content")))


def scan_files(files: DataFrame | Scanned) -> Scanned:
    """Step one over files (path, content), where a path stands once; what is scanned already stays as it is. Its rows are held on disk, as the cross-references and the pieces are read apart."""
    if isinstance(files, Scanned):
        return files
    known = dict(codecs.FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for path, content in zip(batch.column(0), batch.column(1), strict=True) for row in structure(path.as_py(), content.as_py(), known))
        yield from _batched(rows, lambda r: len(r.get("data") or b"") + 32 * len(r.get("entries", ())), _structure_batch)

    whole = computed(files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, STRUCTURE))
    return Scanned(whole, computed(whole.where("piece is null").drop("piece", "base", "data")))


def parsed_objects(scanned: Scanned) -> DataFrame:
    """path, obj_no, generation, position, type, subtype, value (a variant, see quire.sources.syntax), stream, filters, params and error of the newest objects."""
    live = scanned.newest.where("in_use")
    wanted = F.collect_list(F.struct("position", "obj_no", "generation")).alias("wanted")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(batch.num_rows) for row in parse_piece(*(c[i].as_py() for c in batch.columns)))
        yield from _batched(rows, _object_size, _object_batch)

    located = live.where("container is null").groupBy("path", F.expr(f"position div {PIECE}").alias("piece")).agg(wanted)  # as many as fit into a piece
    pieces = scanned.structure.where("piece is not null").select("path", "piece", "base", "data")
    parsed = located.join(pieces, ["path", "piece"], "left").select("path", "base", "data", "wanted").mapInArrow(parse, OBJECT)
    kept = ["path", "obj_no", "generation", "position", "type", "subtype", F.try_parse_json("json").alias("value"), "stream", "filters", "params", "error"]
    direct = computed(parsed.select(*kept, "length_obj", "up_to_end"))
    kept[6] = "value"
    out = [direct.where("length_obj is null").select(kept)]

    # Streams whose length is an object of its own: cut where it says, if the end follows there, else before the first word that may be the end.
    if direct.agg(F.count("length_obj")).first()[0]:
        number = F.to_json("value")
        lengths = direct.where("stream is null").where(number.rlike("^[0-9]{1,9}$")).select("path", F.col("obj_no").alias("length_obj"), number.cast("int").alias("_n"))
        open_ended = direct.where("length_obj is not null").join(lengths.hint("merge"), ["path", "length_obj"], "left")
        follows = F.decode(F.expr("substring(stream, _n + 1, 32)"), "ISO-8859-1").rlike(r"^[\x00\t\n\x0c\r ]*endstream")
        ended = F.when(follows, F.expr("substring(stream, 1, _n)")).otherwise(F.expr("substring(stream, 1, cast(up_to_end as int))"))
        out.append(computed(open_ended.withColumn("stream", ended).select(kept)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(batch.num_rows) for row in members(*(c[i].as_py() for c in batch.columns)))
        yield from _batched(rows, _object_size, _object_batch)

    if not scanned.entries.where("container is not null").isEmpty():
        inside = live.where("container is not null").groupBy("path", "container").agg(wanted)
        holders = reduce(DataFrame.unionByName, out).where("stream is not null").select("path", F.col("obj_no").alias("container"), F.to_json("value").alias("json"), decode_streams(F.col("stream"), F.col("filters"), F.col("params")).alias("d"))
        found = inside.join(holders.hint("merge"), ["path", "container"], "left").select("path", "json", "d.data", "wanted", "d.error").mapInArrow(split, OBJECT)
        out.append(computed(found.withColumn("value", F.try_parse_json("json")).select(kept)))
    return reduce(DataFrame.unionByName, out)


# --- references -----------------------------------------------------------------------------------------


def settled(objects: DataFrame) -> DataFrame:
    """objects, where one whose value is a reference has the value that the chain of references ends at: null if it ends at nothing or in itself.

    Pointer jumping: a round doubles the hops that each reference spans, and ends when no reference got further. Files have few
    such objects or none; then nothing is joined. A round's rows are a checkpoint, so that its plan does not hold all rounds before,
    and held on top: a checkpoint's estimated size is the product of what was joined for it, a number whose digits would double
    with each round and fill the driver's memory; of held rows the true size is known.
    """
    number = values.ref_number("value")
    edges = computed(cut(objects.where(number.isNotNull()).select("path", "obj_no", number.alias("to"))))
    left = edges.count()
    if not left:
        edges.unpersist()
        return objects
    while left:  # at most as many rounds as the longest chain has binary digits; what is in a circle stays in it and is given up
        onward = edges.select("path", F.col("obj_no").alias("to"), F.col("to").alias("further")).hint("merge")
        further = edges.join(onward, ["path", "to"], "left").select("path", "obj_no", F.coalesce("further", "to").alias("to"), (F.coalesce("further", "to") != F.col("to")).alias("moved"))
        before, edges = edges, computed(cut(further))
        left = left >> 1 if edges.agg(F.bool_or("moved")).first()[0] else 0
        before.unpersist()
    ends = edges.select("path", "obj_no", "to").join(objects.select("path", F.col("obj_no").alias("to"), F.col("value").alias("_end")), ["path", "to"], "left")
    ends = ends.select("path", "obj_no", F.when(values.ref_number("_end").isNull(), F.col("_end")).alias("_end"), F.lit(True).alias("_was"))
    joined = objects.join(ends.hint("merge"), ["path", "obj_no"], "left")
    settled = cut(joined.withColumn("value", F.when(F.col("_was"), F.col("_end")).otherwise(F.col("value"))).select(objects.columns))
    edges.unpersist()
    return settled


def resolve(rows: DataFrame, reference: str, targets: DataFrame, out: str, by: str = "path") -> DataFrame:
    """rows with `out`: the value of the object of the same path that the variant in `reference` points at.

    What is not a reference stays as it is, as `value` of targets then must be a variant too; a reference to nothing gives null.
    """
    number = values.ref_number(reference)
    found = targets.select(F.col(by).alias("_path"), F.col("obj_no").alias("_obj"), F.col("value").alias("_value"))
    joined = rows.join(found, (F.col(by) == F.col("_path")) & (number == F.col("_obj")), "left")
    kept = F.col(reference) if str(targets.schema["value"].dataType) == "VariantType()" else F.lit(None)
    return joined.withColumn(out, F.when(number.isNotNull(), F.col("_value")).otherwise(kept)).drop("_path", "_obj", "_value")


def resolve_inside(rows: DataFrame, by: list[str], columns: dict[str, str | None], objects: DataFrame) -> DataFrame:
    """rows, one for each of by (path among them), where the variants in columns have no references outside, and inside none one level down.

    columns: each with the type that it has where nothing is to be looked up, None where there may always be something. A column that is a reference becomes its
    object's value. If that is of the column's type, it stands in `<column>_plain`; if not, items of arrays and entries of dictionaries that are references
    become their objects' values, null for those that point at nothing: arrays are array<variant> in
    `<column>_items`, dictionaries map<string, variant> in `<column>_entries`. Only references are exploded and joined, those of all columns at once.
    """
    targets = objects.select("path", F.col("obj_no").alias("_to"), F.col("value").alias("_found")).hint("merge")  # as held rows without their values are estimated far too small
    no_points = F.array().cast("array<struct<_name: string, _to: int>>")

    def looked_up(points: Column) -> DataFrame:
        refs = rows.select(*by, F.inline(F.filter(points, lambda p: p["_to"].isNotNull())))
        found = refs.hint("merge").join(targets, ["path", "_to"]).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_found"))).alias("_given"))
        return rows.join(found, by, "left")

    pointer = lambda name, value: F.struct(name.alias("_name"), values.ref_number(value).alias("_to"))
    given = lambda name, value: F.when(values.ref_number(value).isNotNull(), F.try_element_at("_given", name)).otherwise(value)
    rows = looked_up(F.array(*(pointer(F.lit(c), F.col(c)) for c in columns)))
    rows = rows.withColumns({c: given(F.lit(c), F.col(c)) for c in columns}).drop("_given")
    rows = rows.withColumns({f"{c}_plain": F.try_variant_get(c, "$", kind) if kind else F.lit(None).cast("string") for c, kind in columns.items()})
    # An item that is not of the type is null by now, and so may be one to look up.
    arrays = [f"{c}_plain" for c, kind in columns.items() if kind and kind.startswith("array")]
    rows = held(rows.withColumns({c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c)) for c in arrays}), StorageLevel.MEMORY_AND_DISK)
    rows = rows.withColumns({f"{c}_{x}": F.when(F.col(f"{c}_plain").isNull(), F.try_variant_get(c, "$", kind)) for c in columns for x, kind in (("items", "array<variant>"), ("entries", "map<string, variant>"))})
    points, patched = [], {}
    for c in columns:
        place = lambda key, c=c: F.concat(F.lit(f"{c}/"), key.cast("string"))
        items, entries = f"{c}_items", f"{c}_entries"
        points.append(F.coalesce(F.transform(items, lambda x, i: pointer(place(i), x)), no_points))  # noqa: B023
        points.append(F.coalesce(F.transform(F.map_entries(entries), lambda e: pointer(place(e["key"]), e["value"])), no_points))  # noqa: B023
        patched[items] = F.transform(items, lambda x, i: given(place(i), x))  # noqa: B023
        patched[entries] = F.transform_values(entries, lambda k, v: given(place(k), v))  # noqa: B023
    rows = looked_up(F.flatten(F.array(*points)))
    return rows.withColumns(patched).drop("_given")


# --- tables ---------------------------------------------------------------------------------------------


def documents(scanned: Scanned) -> DataFrame:
    """path, version (the catalog's, if it has one), size, root_obj, info, file_id (variants), encrypted, n_objects, n_revisions and error of each file. Of the revisions' trailers, the newest that has a key counts."""
    newest = lambda key, kind: F.min_by(F.try_variant_get("trailer", f"$.{key}", kind), F.when(F.try_variant_get("trailer", f"$.{key}", "variant").isNotNull(), F.col("revision")))
    heads = scanned.trailers.groupBy("path").agg(
        newest("Size", "int").alias("size"), newest("Root.n", "int").alias("root_obj"), newest("Info.n", "int").alias("_info"), newest("ID", "variant").alias("file_id"),
        F.max(F.try_variant_get("trailer", "$.Encrypt", "variant").isNotNull()).alias("encrypted"), (F.max("revision") + 1).alias("n_revisions"),
    )
    counts = scanned.newest.groupBy("path").agg(F.sum(F.col("in_use").cast("int")).alias("n_objects"))
    rows = scanned.files.join(heads, "path", "left").join(counts, "path", "left")
    for key, out in (("root_obj", "_catalog"), ("_info", "info")):
        found = scanned.objects.where("stream is null").select("path", F.col("obj_no").alias(key), F.col("value").alias(out))
        rows = rows.join(found, ["path", key], "left")
    version = F.coalesce(F.try_variant_get("_catalog", "$.Version.v", "string"), F.col("version"))
    return rows.select("path", version.cast("decimal(3,1)").alias("version"), "size", "root_obj", "info", "file_id", F.coalesce("encrypted", F.lit(False)).alias("encrypted"), F.coalesce("n_objects", F.lit(0)).cast("int").alias("n_objects"), F.coalesce("n_revisions", F.lit(0)).alias("n_revisions"), "error")


def catalogs(scanned: Scanned, objects: DataFrame) -> DataFrame:
    """path and catalog (a variant) of each file."""
    root = F.min_by(F.try_variant_get("trailer", "$.Root.n", "int"), F.when(F.try_variant_get("trailer", "$.Root.n", "int").isNotNull(), F.col("revision")))
    return scanned.trailers.groupBy("path").agg(root.alias("obj_no")).join(objects.where("stream is null").select("path", "obj_no", F.col("value").alias("catalog")), ["path", "obj_no"]).select("path", "catalog")


def xref(scanned: Scanned) -> DataFrame:
    """path, revision (0 is the newest), obj_no, generation, position, in_use and container of each cross-reference."""
    return scanned.entries.select("path", "revision", "obj_no", "generation", "position", "in_use", "container")


def objects(scanned: Scanned) -> DataFrame:
    """The objects of each file as its newest revisions have them; value is a variant, see quire.sources.syntax. Chains of references are followed."""
    return scanned.objects
