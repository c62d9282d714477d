"""Each registered query against its SQL, and whole plans against hand-made pages."""

import glob
import hashlib
import os
import shutil
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from quire.operators import layout, pages, state, tree
from quire.plans import text as plans
from quire.plans.queries import ORACLES, QUERIES
from quire.sources import files, metrics, writer
from quire.streaming import ingest


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        return None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) else str(v)

    return sorted((tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, data, sql, name):
    got = registry.queries()[name](spark, data).toPandas()
    want = sql.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert registry.entry(spark).columns == ["doc_id", "text"]


TABLE = b"BT /F1 10 Tf 12 TL 72 700 Td (Name) Tj 200 0 Td (Qty) Tj -200 -12 Td (Bolt) Tj 200 0 Td [(1) -600 (2)] TJ ET"
STACK = b"BT /F1 10 Tf 0 700 Td q 5 Tc (ab) Tj Q (c) Tj ET q 1 0 0 1 0 -50 cm BT /F1 10 Tf 36 700 Td (low) Tj ET Q"


def test_layout(spark):
    content = writer.pages_file([TABLE, writer.paint_lines("a\n\nb c", ends=False), STACK, b""])
    made = spark.createDataFrame([("x", bytearray(content)), ("bad", bytearray(b"junk"))], "path string, content binary")
    fixed = {r.page_index: r.text for r in plans.layout_text(made).collect()}
    flow = {r.page_index: r.text for r in plans.layout_text(made, fixed_width=False).collect()}
    assert fixed[0] == " " * 12 + "Name" + " " * 29 + "Qty\n" + " " * 12 + "Bolt" + " " * 29 + "1 2"
    assert flow[0] == "Name" + " " * 29 + "Qty\nBolt" + " " * 29 + "1 2"
    assert flow[1] == "a\nb c" and 3 not in flow
    assert flow[2].split("\n") == ["abc", "low"]  # Q gives the spacing back; cm moves the second text down


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pdf").write_bytes(writer.pages_file([writer.paint_lines(f"file {i}\nline", ends=False)]))
    query = ingest.ingest_text(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())
    shutil.rmtree(tmp_path / "out")
    assert got == sorted(" " * 5 + f"file {i}\n" + " " * 5 + "line" for i in range(3))


def test_graphics_state_comes_back(spark):
    """Q gives back all that its q saw, through empty and nested frames; a Q without a q changes nothing."""
    ops = ["Q", "5 w", "q", "2 w", "1 J", "q", "q", "3 1 7 d", "Q", "/X ri", "Q", "Q", "9 M", "Q"]
    rows = []
    for i, x in enumerate(ops):
        *operands, op = x.split()
        rows.append((1, i, op, [float(v) for v in operands if v[0] != "/"], next((v[1:] for v in operands if v[0] == "/"), None)))
    made = spark.createDataFrame(rows, "page int, at int, opcode string, nums array<double>, name string")
    got = {r["at"]: r for r in state.graphics_state(made, ["page"], ["at"]).collect()}
    assert [got[i].line_width for i in range(14)] == [1, 5, 5, 2, 2, 2, 2, 2, 2, 2, 2, 5, 5, 5]
    assert [got[i].depth for i in range(14)] == [0, 0, 1, 1, 1, 2, 3, 3, 2, 2, 1, 0, 0, 0]
    assert (got[7].dash_array, got[7].dash_phase, got[8].dash_array, got[8].dash_phase) == ([3.0, 1.0], 7.0, [], 0.0)
    assert (got[9].intent, got[10].intent, got[11].line_cap, got[13].miter_limit, got[12].opcode) == ("X", "RelativeColorimetric", 0.0, 9.0, "M")


def test_attributes_in_objects_of_their_own(spark):
    page = {"Type": "Page", "Parent": writer.ref(2), "CropBox": writer.ref(6), "Rotate": writer.ref(7)}
    content = writer.file_bytes({1: {"Type": "Catalog", "Pages": writer.ref(2)}, 2: {"Type": "Pages", "Kids": [writer.ref(3)], "Count": 1, "MediaBox": writer.ref(5)}, 3: page, 5: [0, 0, 300, 400], 6: [10, 10, 200, 200], 7: 90})
    scanned = files.scan_files(spark.createDataFrame([("x", bytearray(content))], "path string, content binary"))
    got = pages.pages(scanned, files.objects(scanned)).first()
    assert (got.mediabox, got.cropbox, got.rotate) == ([0, 0, 300, 400], [10, 10, 200, 200], 90)


def test_trees_of_any_depth(spark):
    nodes = [("t", i, [i + 1]) for i in range(40)] + [("t", 40, None)]
    made = spark.createDataFrame(nodes, "tree string, node int, kids array<int>")
    got = tree.flatten(made, spark.createDataFrame([("t", 0)], "tree string, node int")).collect()
    assert [(r.node, len(r.place)) for r in got] == [(40, 40)]


def test_deep_and_broken_trees(spark, monkeypatch):
    """200 levels in eight rounds; a node of two parents stands twice; circles and branches without a root come to an end."""
    rounds = []
    monkeypatch.setattr(tree, "cut", lambda df, real=tree.cut: rounds.append(1) or real(df))
    nodes = [("deep", i, [i + 1], None) for i in range(200)] + [("deep", 200, None, None)]
    nodes += [("dag", 0, [1, 2, 1], 5), ("dag", 1, [3], 6), ("dag", 2, [3, 0, 9], None), ("dag", 3, None, None), ("dag", 7, [8], 1), ("dag", 8, [7, 3], None)]
    made = spark.createDataFrame(nodes, "tree string, node int, kids array<int>, box int")
    got = tree.flatten(made, spark.createDataFrame([("deep", 0), ("dag", 0), ("none", 1)], "tree string, node int"), ("box",))
    rows = sorted((r.tree, r.node, tuple(r.place), r.box) for r in got.collect())
    assert rows == [("dag", 3, (0, 0), 6), ("dag", 3, (1, 0), 5), ("dag", 3, (2, 0), 6), ("deep", 200, (0,) * 200, None)] and len(rounds) <= 10


def test_frames_of_hostile_depth(spark):
    """100,000 q without a Q, with a width set at every thousandth, and as many of both by turns, take seconds."""
    deep = spark.range(100_000).selectExpr("'deep' page", "id at", "if(id % 1000 = 1, 'w', 'q') opcode", "array(double(id)) nums", "cast(null as string) name")
    turns = spark.range(100_000).selectExpr("cast(null as string) page", "id at", "array('q', 'w', 'Q', 'J')[id % 4] opcode", "array(double(id)) nums", "cast(null as string) name")
    began = time.time()
    got = state.graphics_state(deep.union(turns), ["page"], ["at"])
    want = F.when(F.col("page").isNull(), F.when(F.col("at") % 4 == 1, F.col("at")).otherwise(1)).otherwise(F.when(F.col("at") < 1, 1).otherwise(F.expr("(at - 1) div 1000 * 1000 + 1")))
    assert got.where(F.col("line_width") != want).count() == 0 and got.count() == 200_000
    assert got.agg(F.max("depth")).first()[0] == 99_900 and time.time() - began < 120


def test_fonts_without_widths(spark):
    lines = spark.createDataFrame([("Helvetica", x) for x in ("CapHeight 718", "C 65 ; WX 667 ; N A ; B 0 0 0 0 ;", "C 66 ; WX 660 ; N B ; B 0 0 0 0 ;")], "font string, line string")
    plain = ("x", 1, "Type1", "Helvetica", None, None, None, None, None, None, "StandardEncoding", None, True)
    fonts = spark.createDataFrame([plain, ("x", 2, "Type1", "Other", *plain[4:])], "path string, font_obj int, subtype string, base_font string, first_char int, last_char int, widths array<double>, missing_width double, cap_height double, char_set array<string>, base_encoding string, differences array<string>, supported boolean")
    got = {r.font_obj: r for r in pages.font_tables(pages.with_metrics(fonts, metrics.font_metrics(lines))).collect()}
    assert (got[1].widths[65], got[1].widths[66], got[1].cap_height, got[2].widths[65]) == (667.0, 660.0, 718.0, pages.PLAIN_WIDTH)


def test_what_cannot_be_read_is_told(spark, tmp_path, monkeypatch):
    good = writer.pages_file([TABLE])
    for name, content in (("good", good), ("bad", b"junk"), ("ops", writer.pages_file([b"BT (open Tj"])), ("odd", writer.pages_file([TABLE], font={"Type": "Font", "Subtype": "Type3"})), ("lost", good.replace(b"5 0 obj", b"6 0 obj"))):
        (tmp_path / f"{name}.pdf").write_bytes(content)
    (tmp_path / "big.pdf").write_bytes(good + b" " * 5000)
    monkeypatch.setattr(files, "MAX_FILE", len(good) + 1000)
    scanned = files.scan_files(files.read_files(spark, str(tmp_path)))
    got = {os.path.basename(r.path): (r.part, r.page_index) for r in plans.problems(scanned).collect()}
    assert got == {"bad.pdf": ("file", None), "big.pdf": ("file", None), "ops.pdf": ("operations", 0), "odd.pdf": ("font", None), "lost.pdf": ("object", None)}
    assert {os.path.basename(r.path) for r in plans.simple_text(scanned).collect()} == {"good.pdf", "odd.pdf"}  # of the same scan


def test_batches_of_a_stream_keep_no_cache(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(writer.pages_file([writer.paint_lines("a", ends=False)]))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for _ in range(2):
        with tree.released():
            assert plans.layout_text(files.read_files(spark, str(tmp_path))).count() == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_registered_opcodes(spark, monkeypatch):
    monkeypatch.setattr(layout, "_registered", {})
    layout.register_opcode("Show", "text showing", acts_as="Tj")
    layout.register_opcode("Do", "objects")
    kinds = spark.createDataFrame([("Show",), ("Do",), ("Tf",), ("x",)], "opcode string").select(layout.optype(F.col("opcode"))).collect()
    assert [k[0] for k in kinds] == ["text showing", "objects", "text state", "other"]
    made = spark.createDataFrame([("x", bytearray(writer.pages_file([b"BT /F1 10 Tf 0 700 Td (ab) Show ET"])))], "path string, content binary")
    assert plans.simple_text(made).first().text == "ab"
    layout.register_sql(spark)
    rows = spark.sql("select op_idx, opcode, name, nums, get(parts, 0).hex shown from content_ops(cast('BT /F1 10 Tf (ab) Show' as binary)) order by op_idx").collect()
    assert [tuple(r) for r in rows] == [(0, "BT", None, [], None), (1, "Tf", "F1", [10.0], None), (2, "Tj", None, [], "6162")]


def shuffled(spark) -> int:
    """Bytes that this session's tasks have dealt out so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    listed = context.statusStore().executorList(False)
    return sum(listed.apply(i).totalShuffleWrite() for i in range(listed.size()))


def test_strings_are_not_dealt_as_ops(spark):
    """Painted text is read where its page's streams are: what is dealt out stays near the files' size, and no copy is left as a checkpoint."""
    noise = ["".join(hashlib.sha512(b"%d %d" % (i, j)).hexdigest() for j in range(200)) for i in range(100)]
    made = [(str(i), bytearray(writer.pages_file([writer.paint_lines(text)]))) for i, text in enumerate(noise)]
    held_before = shuffled(spark)
    with tree.released():
        got = {r.path: r.text for r in plans.simple_text(spark.createDataFrame(made, "path string, content binary")).collect()}
    assert got == {str(i): text for i, text in enumerate(noise)}
    assert shuffled(spark) - held_before < 3 * sum(len(content) for _, content in made)


def test_strings_of_several_streams_and_fonts(spark):
    """Streams of a page are one text, a missing one counts as empty; differences, unknown fonts, Q, and the ops that a TJ, ' and " stand for."""
    own = {"Type": "Font", "Subtype": "Type1", "BaseFont": "X", "Encoding": {"Type": "Encoding", "BaseEncoding": "WinAnsiEncoding", "Differences": [65, "fi", "uni0416", "nothing", 300, "B"]}}
    pages_made = {
        4: ([writer.ref(10), writer.ref(99), writer.ref(11)], {}),
        5: (writer.ref(12), {}),
        6: (writer.ref(13), {}),
        7: (None, {}),
    }
    made = {1: {"Type": "Catalog", "Pages": writer.ref(2)}, 2: {"Type": "Pages", "Kids": [writer.ref(i) for i in pages_made], "Resources": {"Font": {"F1": writer.ref(3), "F2": writer.ref(20)}}}, 3: own, 20: writer.COURIER}
    made |= {i: {"Type": "Page", "Parent": writer.ref(2)} | ({"Contents": c} if c else {}) for i, (c, _) in pages_made.items()}
    made |= {10: ({}, b"BT /F2 9 Tf (ab"), 11: ({}, b"c) Tj ET"), 12: ({}, b"BT /F1 9 Tf [(ABC) -200 (D)] TJ q /F2 9 Tf (A) ' Q 1 2 (B) \" /None 9 Tf (\\200) Tj ET"), 13: ({}, b"BT () Tj ET")}
    content = writer.file_bytes(made)
    got = {r.page_index: r.text for r in plans.simple_text(spark.createDataFrame([("x", bytearray(content))], "path string, content binary")).collect()}
    assert got == {0: "ab\n\nc", 1: "\ufb01\u0416CDA\u0416\x80", 2: ""}


def test_estimates_stay_small(spark):
    """A thousand references are followed in as many rounds as they need, and the plan's estimated size is a number of few digits, not one whose digits double with each round."""
    made = spark.range(2000).selectExpr("'x' path", "cast(id as int) obj_no", "parse_json(if(id < 1000, concat('{\"t\":\"ref\",\"n\":', if(id < 8, id + 1, id + 1000), '}'), string(id))) value")
    got = files.settled(made)
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 1000
    want = {i: 1008 if i < 9 else i + 1000 if i < 1000 else i for i in range(2000)}
    assert {r.obj_no: int(r.v) for r in got.selectExpr("obj_no", "try_variant_get(value, '$', 'string') v").collect()} == want
