"""From ops to text: content streams tokenised, strings placed, blocks joined to lines and lines to pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.codecs import FILTERS, FilterError, decode
from ..functions.encodings import tables
from ..sources.syntax import SyntaxFault, statements
from .state import advance, apply_matrix, multiply, number_advance, so_far, text_cursor

#: Kinds of opcodes, and the opcodes of each. All others count as `other` and do nothing.
OPCODES = {
    "text object": ("BT", "ET"),
    "text positioning": ("Td", "TD", "Tm", "T*"),
    "text showing": ("Tj", "TJ", "'", '"'),
    "text state": ("Tc", "Tw", "Tz", "TL", "Tf", "Tr", "Ts"),
    "graphics state": ("cm", "q", "Q", "w", "J", "j", "M", "d", "ri", "i"),
}
#: The text state's defaults, as the ops that would set them.
_DEFAULTS = {"Tc": [0], "Tw": [0], "Tz": [100], "TL": [0], "Tr": [0], "Ts": [0]}
_OPS = pa.schema(
    [("op_idx", pa.int32()), ("sub_idx", pa.int32()), ("opcode", pa.string()), ("nums", pa.list_(pa.float64())), ("name", pa.string())]
    + [("parts", pa.list_(pa.struct([("hex", pa.string()), ("move", pa.float64())]))), ("operands", pa.string()), ("ctm", pa.list_(pa.float64())), ("error", pa.string())]
)
OPS = "op_idx int, sub_idx int, opcode string, nums array<double>, name string, parts array<struct<hex: string, move: double>>, operands string, ctm array<double>, error string"


#: Opcodes that a user has registered: the kind, and the opcode as which plans treat it, if any.
_registered: dict[str, tuple[str, str | None]] = {}


def register_opcode(opcode: str, kind: str = "other", acts_as: str | None = None) -> None:
    """From now on plans know opcode: optype() gives its kind, and with acts_as it does what that opcode does. A second call replaces the first."""
    _registered[opcode] = kind, acts_as


def optype(opcode: Column, more: dict[str, str] | None = None) -> Column:
    """An opcode's kind, `other` if it has none. more: kinds of opcodes for this plan alone, before those that are registered."""
    out = F.when(F.lit(False), F.lit(""))
    for code, kind in {**{code: kind for code, (kind, _) in _registered.items()}, **(more or {})}.items():
        out = out.when(opcode == code, kind)
    for kind, codes in OPCODES.items():
        out = out.when(opcode.isin(*codes), kind)
    return out.otherwise("other")


def content_steps(content: bytes | None) -> Iterator[tuple[int, int, str, list, list[float], str | None]]:
    """op_idx, sub_idx, opcode, operands, ctm and error of the ops of a content stream. A Q is followed by ops that set the text state again as it was at its q; ctm is what cm has made."""
    ctm, state, stack = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], dict(_DEFAULTS), []
    i = 0
    try:
        for i, (operands, key, _) in enumerate(statements(content or b"", images=True)):
            if key is None:
                continue
            if key == "cm" and len(operands) == 6 and all(type(x) in (int, float) for x in operands):
                a, b, c, d, e, f = operands
                p, q, r, s, t, u = ctm
                ctm = [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]
            elif key == "q":
                stack.append((ctm, dict(state)))
            elif key in state or key == "Tf":
                state[key] = operands
            if key != "Q" or not stack:
                yield i, 0, key, operands, ctm, None
                continue
            now = state
            ctm, state = stack.pop()
            yield i, 0, key, operands, ctm, None
            for sub, (k, v) in enumerate(sorted(state.items()), 1):
                if now.get(k) != v:
                    yield i, sub, k, v, ctm, None
    except SyntaxFault as e:
        yield i + 1, 0, "", [], ctm, str(e)[:200]


def first_name(operands: list) -> str | None:
    return next((x["v"] for x in operands if isinstance(x, dict) and x.get("t") == "name"), None)


def shown(key: str, operands: list) -> list:
    """What a text-showing op has to show: the items of a TJ's array, else its operands."""
    return operands[0] if key == "TJ" and operands and isinstance(operands[0], list) else operands


def is_string(value: object) -> bool:
    return isinstance(value, dict) and value.get("t") == "str"


def content_rows(content: bytes | None) -> Iterator[dict]:
    """The ops of a content stream (see content_steps) as rows."""
    for i, sub, key, operands, ctm, error in content_steps(content):
        nums = [float(x) for x in operands if type(x) in (int, float)]
        parts = [{"hex": x["hex"], "move": None} if isinstance(x, dict) else {"hex": None, "move": float(x)} for x in shown(key, operands) if is_string(x) or key == "TJ" and type(x) in (int, float)]
        yield {"op_idx": i, "sub_idx": sub, "opcode": key, "nums": nums, "name": first_name(operands), "parts": parts, "operands": json.dumps(operands), "ctm": ctm, "error": error}


def content_ops(contents: DataFrame, *keys: str) -> DataFrame:
    """The ops of contents (keys and content, binary), in order of op_idx and sub_idx. A malformed stream ends with a row that has an error."""
    schema = ", ".join(f"`{k}` {contents.schema[k].dataType.simpleString()}" for k in keys)
    contents_schema = to_arrow_schema(contents.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.schema([*contents_schema, *_OPS])
        rows: list[dict] = []
        for batch in batches:
            for j in range(batch.num_rows):
                same = {k: batch.column(i)[j].as_py() for i, k in enumerate(keys)}
                for row in content_rows(batch.column(len(keys))[j].as_py()):
                    rows.append(same | row)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, whole)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, whole)

    ops = contents.select(*keys, F.col("content").cast("binary")).mapInArrow(run, f"{schema}, {OPS}")
    acting = [(code, other) for code, (_, other) in _registered.items() if other]
    for code, other in acting:
        ops = ops.withColumn("opcode", F.when(F.col("opcode") == code, other).otherwise(F.col("opcode")))
    return ops


def register_sql(spark: SparkSession) -> None:
    """Makes content_ops callable from SQL, as a table function of a content stream: `select * from content_ops(x'...')` or `lateral content_ops(t.content)`. Opcodes registered by now come as what they act as."""
    acting = {code: other for code, (_, other) in _registered.items() if other}

    class ContentOps:
        def eval(self, content: bytes) -> Iterator[tuple]:
            for row in content_rows(None if content is None else bytes(content)):
                parts = [(p["hex"], p["move"]) for p in row["parts"]]
                yield row["op_idx"], row["sub_idx"], acting.get(row["opcode"], row["opcode"]), row["nums"], row["name"], parts, row["operands"], row["ctm"], row["error"]

    spark.udtf.register("content_ops", F.udtf(ContentOps, returnType=OPS))


def expand_ops(ops: DataFrame) -> DataFrame:
    """ops with `'` as T* and Tj, `"` as Tw, Tc, T* and Tj, and TD as TL and Td; sub_idx orders what one op has become."""
    none, no_parts = F.array().cast("array<double>"), F.array().cast("array<struct<hex: string, move: double>>")
    new = lambda op, nums=none, parts=no_parts: F.struct(F.lit(op).alias("opcode"), nums.alias("nums"), parts.alias("parts"))
    num = lambda i: F.array(F.get("nums", F.lit(i)))
    shown = new("Tj", none, F.col("parts"))
    became = (
        F.when(F.col("opcode") == "'", F.array(new("T*"), shown))
        .when(F.col("opcode") == '"', F.array(new("Tw", num(0)), new("Tc", num(1)), new("T*"), shown))
        .when(F.col("opcode") == "TD", F.array(new("TL", F.array(-F.get("nums", F.lit(1)))), new("Td", F.col("nums"))))
        .otherwise(F.array(F.struct("opcode", "nums", "parts")))
    )
    rest = [c for c in ops.columns if c not in ("opcode", "nums", "parts", "sub_idx")]
    return ops.select(*rest, "sub_idx", F.posexplode(became).alias("at", "op")).select(*rest, (F.col("sub_idx") * 8 + F.col("at")).alias("sub_idx"), "op.*")


def codes_of(hexa: Column) -> Column:
    """Byte values of hexadecimal digits."""
    letters = F.split(F.decode(F.unhex(hexa), "ISO-8859-1"), "")
    return F.when(F.length(hexa) > 0, F.transform(letters, lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def runs(ops: DataFrame, fonts: DataFrame, by: list[str], fixed_width: bool = True) -> DataFrame:
    """The parts of text-showing ops: by, op_idx, sub_idx, part_idx, text, x0, x1, y, slope, intercept and basis (width of a column).

    ops as of content_ops; fonts: by, name, texts and widths (arrays by code), avg_width, space_width, cap_height.
    A font that is not there decodes as Latin-1 with no widths.
    """
    order = ["op_idx", "sub_idx"]
    placed = text_cursor(expand_ops(ops), by, order).where(F.col("opcode").isin("Tj", "TJ"))
    known = fonts.select(*by, F.col("name").alias("font"), "texts", "widths", "avg_width", "space_width", "cap_height")
    placed = placed.join(known, [*by, "font"], "left")
    names = ["texts", "widths", "avg_width", "space_width", "cap_height", "tc", "tw", "th", "tl", "fs", "rise", "a", "b", "c", "d", "lm_e", "lm_f", "line_segment", "ctm"]
    parts = placed.select(*by, *order, *names, F.posexplode("parts").alias("part_idx", "part"))
    parts = parts.withColumn("codes", F.when(F.col("part.hex").isNotNull(), codes_of(F.col("part.hex"))))
    no_widths = F.array().cast("array<double>")
    moved = F.when(F.col("codes").isNotNull(), advance(F.coalesce("widths", no_widths), F.col("codes"), F.col("fs"), F.col("tc"), F.col("tw"), F.col("th"))).otherwise(number_advance(F.col("part.move"), F.col("fs"), F.col("th")))
    text = F.array_join(F.transform("codes", lambda c: F.coalesce(F.get("texts", c), F.char(c))), "")
    parts = parts.select("*", moved.alias("adv"), text.alias("text")).drop("texts", "widths", "part", "codes")  # the window sorts rows without a font's tables
    end = F.sum("adv").over(so_far([*by, "line_segment"], [*order, "part_idx"]))
    user = multiply([F.col(c) for c in ("a", "b", "c", "d", "lm_e", "lm_f")], [F.get("ctm", F.lit(i)) for i in range(6)])
    parts = parts.withColumn("end", end).withColumn("m", F.array(*user))
    m = [F.get("m", F.lit(i)) for i in range(6)]
    x0, y = apply_matrix(m, F.col("end") - F.col("adv"), F.lit(0.0))
    x1, _ = apply_matrix(m, F.col("end"), F.lit(0.0))
    slope = F.when(m[0] != 0, m[1] / m[0]).otherwise(0.0)
    lowered = off_line(F.col("rise"), F.col("tl"), F.col("cap_height"))
    parts = parts.select("*", x0.alias("x0"), x1.alias("x1"), y.alias("y"), slope.alias("slope"))
    basis = F.col("avg_width" if fixed_width else "space_width") / 1000 * F.col("fs") * F.col("th") * m[0]
    slope, intercept = line_ids(F.col("slope"), F.col("x0"), F.col("y"), lowered)
    return parts.where("text is not null").select(*by, *order, "part_idx", "text", "x0", "x1", "y", slope.alias("slope"), intercept.alias("intercept"), basis.alias("basis"))


def off_line(rise: Column, leading: Column, cap_height: Column) -> Column:
    """How far a rise moves a block off its line: all of it if it goes down by a line's height (the leading, or without one the capitals' height) or more, else not at all."""
    height = F.when(leading != 0, leading).otherwise(F.coalesce(cap_height, F.lit(0.0)))
    return F.when(rise <= -height, rise).otherwise(0.0)


def line_ids(slope: Column, x: Column, y: Column, lowered: Column | float = 0.0) -> tuple[Column, Column]:
    """What blocks of one line share: slope and intercept, to one place; lowered: how far a rise moves the block off its line."""
    return F.round(slope, 1), F.round(y - lowered - slope * x, 1)


def spacing(gap: Column, basis: Column, tab_width: float | None = None) -> Column:
    """What fills a gap: a tab if it is tab_width columns or more, else its whole columns in spaces; nothing without a basis."""
    n = gap / F.nullif(basis, F.lit(0.0))
    spaces = F.repeat(F.lit(" "), F.greatest(F.coalesce(n, F.lit(0.0)), F.lit(0.0)).cast("int"))
    return spaces if tab_width is None else F.when(n >= tab_width, "\t").otherwise(spaces)


def blocks(parts: DataFrame, by: list[str], tab_width: float | None = None) -> DataFrame:
    """runs joined to one block for each op: by, op_idx, sub_idx, text, x0, x1, basis, slope, intercept."""
    op = [*by, "op_idx", "sub_idx"]
    w = Window.partitionBy(*op).orderBy("part_idx")
    padded = parts.withColumn("pad", F.coalesce(spacing(F.col("x0") - F.lag("x1").over(w), F.first("basis").over(w), tab_width), F.lit("")))
    return padded.groupBy(*op).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_idx", F.concat("pad", "text").alias("text")))), lambda p: p["text"]), "").alias("text"),
        F.min_by("x0", "part_idx").alias("x0"), F.max_by("x1", "part_idx").alias("x1"), F.min_by("basis", "part_idx").alias("basis"), F.min_by("slope", "part_idx").alias("slope"), F.min_by("intercept", "part_idx").alias("intercept"),
    )


def join_fixed(joined: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Lines by (by): blocks (x0, left, basis, text) at their columns. A line starts with one space and a block with as many as it lacks to column int((x0 - left) / basis).

    In closed form: with before = the length of earlier blocks, a block stands at the greatest of 1 and column - before
    of all blocks up to it, plus before.
    """
    w = Window.partitionBy(*by).orderBy("x0", *order)
    column = F.coalesce(((F.col("x0") - F.col("left")) / F.nullif(F.col("basis"), F.lit(0.0))).cast("int"), F.lit(0))
    rows = joined.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("pads", F.greatest(F.lit(1), F.max(column - F.col("before")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("pad", (F.col("pads") - F.coalesce(F.lag("pads").over(w), F.lit(0))).cast("int"))
    return _joined(rows.withColumn("piece", F.concat(F.repeat(F.lit(" "), F.col("pad")), "text")), by, order)


def join_flow(joined: DataFrame, by: list[str], order: list[str], tab_width: float | None = None) -> DataFrame:
    """Lines by (by): blocks (x0, x1, basis, text) with the gap before each filled by the columns of the block before it."""
    w = Window.partitionBy(*by).orderBy("x0", *order)
    pad = F.coalesce(spacing(F.col("x0") - F.lag("x1").over(w), F.lag("basis").over(w), tab_width), F.lit(""))
    return _joined(joined.withColumn("piece", F.concat(pad, "text")), by, order)


def _joined(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct("x0", *order, "piece")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("line"))


def page_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """Pages by (by): lines (slope, intercept, line) from the highest intercept down, joined by newlines."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("intercept")).alias("down"), "slope", "line")))
    return lines.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def painted(content: bytes, fonts: dict[str, dict[int, str]], acting: list[tuple[str, str]]) -> str | None:
    """The text of a content stream's strings in the order they are painted, None if it shows none. fonts: texts by code of each font's name; what is not there is Latin-1."""
    out, texts = [], {}
    for _, _, opcode, operands, _, _ in content_steps(content):
        key = opcode
        for code, other in acting:
            key = other if key == code else key
        if key == "Tf":
            name = first_name(operands)
            texts = texts if name is None else fonts.get(name, {})
        elif key in OPCODES["text showing"]:
            out += [bytes.fromhex(x["hex"]).decode("latin-1").translate(texts) for x in shown(opcode, operands) if is_string(x)]
    return "".join(out) if out else None


def simple_text(contents: DataFrame, by: list[str]) -> DataFrame:
    """by and text of pages: their strings in the order they are painted; pages without any are left out.

    contents: by, streams (stream, filters and params of each) and fonts (name, encoding, own: code and text). A page is one row from its
    streams to its text: ops, places and tables of fonts are neither made into rows nor dealt.
    """
    acting = [(code, other) for code, (_, other) in _registered.items() if other]
    known, base = dict(FILTERS), tables()
    kinds = to_arrow_schema(contents.select(*by).schema)
    whole = pa.schema([*kinds, ("text", pa.string())])

    def decoded(s: dict | None) -> bytes:
        try:
            return decode(s["stream"], s["filters"] or [], json.loads(s["params"]) if s["params"] else None, known) if s and s["stream"] is not None else b""
        except (FilterError, ValueError, IndexError):
            return b""

    def texts(font: dict) -> dict[int, str]:
        own = {o["code"]: chr(o["code"]) if o["text"] is None else o["text"] for o in font["own"] or ()}
        return base[font["encoding"]] | own if own else base[font["encoding"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                *keys, streams, fonts = (c[i].as_py() for c in batch.columns)
                text = painted(b"\n".join(map(decoded, streams)), {f["name"]: texts(f) for f in fonts or ()}, acting)
                if text is not None:
                    rows.append((*keys, text))
                    size += len(text)
                if size > 1 << 23 or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), whole, strict=True)], schema=whole)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), whole, strict=True)], schema=whole)

    schema = ", ".join(f"`{k}` {contents.schema[k].dataType.simpleString()}" for k in by)
    return contents.select(*by, "streams", "fonts").mapInArrow(run, f"{schema}, text string")
