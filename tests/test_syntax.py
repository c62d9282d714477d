"""Literal vectors and hostile input for the scalar decoders, the filters and the file scan."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import codecs, encodings, scalars
from quire.functions.encodings import tables
from quire.operators import pages
from quire.sources import files, metrics, syntax, writer


@pytest.mark.parametrize(("token", "value"), [(b"-10", -10), (b"10", 10), (b"-10.123", -10.123), (b"10.123", 10.123), (b"-123.55", -123.55), (b"true", True), (b"false", False), (b"null", None)])
def test_literals(token, value):
    assert syntax.literal(token) == value


@pytest.mark.parametrize("token", [b"slfkj", b"none", b"True", b"False", b"12..54", b"123,456", b"1_000", b"nan", b"1e5"])
def test_what_is_no_literal(token):
    with pytest.raises(syntax.SyntaxFault):
        syntax.literal(token)


@pytest.mark.parametrize(
    ("source", "text"),
    [(b"(simple string)", "simple string"), (b"(simple (string))", "simple (string)"), (rb"(simple \((string))", "simple ((string)"), (rb"(simple (string\)))", "simple (string))"), (rb"(a\\b\
c\101\7z)", "a\\bcA\x07z"), (b"<feff00e90041>", "éA"), (b"<41 4>", "A@")],
)
def test_strings(source, text):
    assert syntax.value_at(source)["text"] == text


def test_hex_and_names():
    assert syntax.value_at(b"<deadbeef>")["hex"] == "deadbeef"
    assert syntax.value_at(b"/Bob#20Smith") == {"t": "name", "v": "Bob Smith"}
    with pytest.raises(syntax.SyntaxFault):
        syntax.value_at(b"(no end")
    with pytest.raises(syntax.SyntaxFault):
        syntax.value_at(b"[" * 1000)


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_filters_give_back_what_they_get(data):
    for decoder, encoder in codecs.FILTERS.values():
        assert decoder(encoder(data)) == data
    for predictor in (2, 10, 11, 12, 13, 14, 15):
        params = {"Predictor": predictor, "Columns": 7, "Colors": 2}
        assert codecs.flate_decode(codecs.flate_encode(data, params), params) == data


@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.binary(max_size=20).map(syntax.string_value), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abc #/(é", min_size=1, max_size=5), x, max_size=3), max_leaves=10))
@settings(max_examples=80, deadline=None)
def test_values_come_back(value):
    tagged = {"t", "v", "hex", "text", "n", "g"}
    if not (isinstance(value, dict) and set(value) & tagged and value.get("t") != "str"):
        assert syntax.value_at(syntax.encode_value(value)) == value


def test_encodings_have_their_sizes():
    assert {k: len(v) for k, v in tables().items()} == {"StandardEncoding": 149, "MacRomanEncoding": 207, "WinAnsiEncoding": 216, "PDFDocEncoding": 229}


def test_columns_agree_with_helpers(spark):
    rows = spark.createDataFrame([(bytes(range(24, 160)), "/A#42+%", "4 1 4", "-.5")], "raw binary, name string, digits string, number string")
    got = rows.select(scalars.pdfdoc_decode("raw"), scalars.name_text("name"), F.hex(scalars.hex_string("digits")), scalars.number_literal("number"), scalars.integer_literal("number"), scalars.name_text(F.lit("/A#4"))).first()
    assert list(got) == [syntax.text_of(bytes(range(24, 160))), "AB+%", "4140", -0.5, None, None]


def test_corrupt_streams_give_errors_not_failures(spark):
    rows = spark.createDataFrame([(1, b"junk", ["FlateDecode"]), (2, b"4142>", ["ASCIIHexDecode"]), (3, None, ["LZWDecode"]), (4, b"kept", ["JPXDecode"]), (5, b"zz", ["AHx"])], "id int, raw binary, filters array<string>")
    got = {r.id: (r.d.data, r.d.error) for r in rows.select("id", codecs.decode_streams(F.col("raw"), F.col("filters")).alias("d")).collect()}
    assert got[1][0] is None and "Flate" in got[1][1]
    assert bytes(got[2][0]) == b"AB" and got[3] == (None, None) and bytes(got[4][0]) == b"kept" and got[5][1]


def scan(spark, *contents):
    """Files named 0, 1, ... after step one."""
    return files.scan_files(spark.createDataFrame([(str(i), None if c is None else bytearray(c)) for i, c in enumerate(contents)], "path string, content binary"))


def objects_of(scanned, *columns):
    return {(int(r.path), r.obj_no): r[2] if len(columns) == 1 else tuple(r[2:]) for r in files.objects(scanned).selectExpr("path", "obj_no", *columns).collect()}


JSON = "to_json(value)"


def test_hostile_files(spark):
    good = writer.pages_file([b"BT ET"])
    start = int(good.rpartition(b"startxref")[2].split()[0])
    loop, locked = good.replace(b"/Size 6", b"/Prev %d" % start), good.replace(b"/Size 6", b"/Encrypt 9")
    elsewhere = writer.file_bytes({1: {"Type": "Catalog"}, 2: ({"F": b"/etc/passwd"}, b"")})
    cuts = [good[:cut] for cut in range(0, len(good), 97)]
    scanned = scan(spark, good, loop, locked, b"", None, elsewhere, *cuts)
    errors = {int(r.path): r.error for r in scanned.files.collect()}
    assert [errors[i] for i in (0, 1, 2, 4, 5)] == [None, None, "encrypted", "no content", None] and errors[3] == "no startxref" and len(errors) == 6 + len(cuts)
    found = objects_of(scanned, "error")
    assert {k: v for k, v in found.items() if k[0] < 6} == {**{(f, n): None for f in (0, 1) for n in range(1, 6)}, (5, 1): None, (5, 2): "its data are in another file"}
    assert {r.path: r.n_revisions for r in files.documents(scanned).where("path in ('1', '2', '4')").collect()} == {"1": 1, "2": 1, "4": 0}


def test_newest_revision_wins(spark):
    made = [writer.file_bytes({2: [2]}, before=writer.file_bytes({1: {"Type": "Catalog"}, 2: [1]}, as_stream=s)) for s in (False, True)]
    scanned = scan(spark, *made)
    found = objects_of(scanned, JSON)
    assert (found[0, 2], found[1, 2]) == ("[2]", "[2]")
    assert {r[0] for r in files.xref(scanned).groupBy("path").agg(F.max("revision").alias("m")).select("m").collect()} == {1}


def by_hand(parts, tail=b"/Size 9", first=b"%PDF-1.4\n"):
    """A file of objects in order, from bytes that the writer did not make."""
    body, places = first, []
    for part in parts:
        places.append(len(body))
        body += part
    table = b"xref\n1 %d\n" % len(parts) + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer\n<</Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF" % (tail, len(body))
    return body + table


CATALOG = b"1 0 obj\n<</Type /Catalog>>\nendobj\n"


def test_lengths_that_are_references(spark):
    """A length that is right, one that is too long, one that points at nothing, and one that points at a name; each before another object."""
    stream = lambda n, ref: b"%d 0 obj\n<</Length %d 0 R>>\nstream\nendstream inside\nendstream\nendobj\n" % (n, ref)
    made = by_hand([CATALOG, stream(2, 3), b"3 0 obj\n16\nendobj\n", stream(4, 5), b"5 0 obj 1600 endobj\n", stream(6, 99), stream(7, 8), b"8 0 obj /x endobj\n"])
    found = objects_of(scan(spark, made), "stream")
    assert found[0, 2] == b"endstream inside" and found[0, 4] == found[0, 6] == found[0, 7] == b""


def test_bytes_that_the_writer_did_not_make(spark):
    """Carriage returns, comments and odd spaces, a table in two sections with free entries, a wrong place, and an object in no section."""
    parts = [b"1 0 obj % the root\r<< /Type/Catalog%x\r\n /A#42 [ 1 -.5 (a\\\r\nb) <4 1> true null ]>>\rendobj\r", b"2\r0\robj(two)endobj\r", b"7 0 obj /seven endobj "]
    body, places = b"%!PS-Adobe-3.0 PDF-1.3\r", []
    for part in parts:
        places.append(len(body))
        body += part
    lines = [b"0 3", b"0000000000 65535 f", b"%010d 00000 n" % places[0], b"%010d 00002 n" % places[1], b"6 3", b"0000000003 00001 f", b"%010d 00000 n" % places[2], b"%010d 00000 n" % (places[2] + 3)]
    made = body + b"xref\r" + b"".join(x + (b"\r" if b" 6" not in x[:4] and len(x) < 8 else b" \r") for x in lines) + b"trailer <</Size 9/Root 1 0 R>>\rstartxref\r%d\r%%%%EOF\r" % len(body)
    scanned = scan(spark, made)
    found = objects_of(scanned, JSON, "error")
    assert found[0, 1][0] == '{"AB":[1,-0.5,{"hex":"6162","t":"str","text":"ab"},{"hex":"41","t":"str","text":"A"},true,null],"Type":{"t":"name","v":"Catalog"}}'
    assert found[0, 2][0] == '{"hex":"74776f","t":"str","text":"two"}' and found[0, 7][0] == '{"t":"name","v":"seven"}' and found[0, 8][1] and set(found) == {(0, 1), (0, 2), (0, 7), (0, 8)}
    row = files.documents(scanned).first()
    assert (str(row.version), row.size, row.root_obj, row.n_objects, row.error) == ("1.3", 9, 1, 4, None)


def test_a_large_file_spreads(spark):
    """200,000 objects: many pieces, parsed apart; so are the members of an object stream."""
    n = 200_000
    body, places = bytearray(b"%PDF-1.4\n"), []
    for i in range(1, n + 1):
        places.append(len(body))
        body += b"%d 0 obj\n[%d (%s)]\nendobj\n" % (i, i, b"x" * (i % 9))
    made = bytes(body) + b"xref\n1 %d\n" % n + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer\n<</Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % len(body)
    scanned = scan(spark, made)
    pieces = scanned.structure.where("piece is not null").selectExpr("length(data) n").collect()
    assert len(pieces) >= 7 and sum(p.n for p in pieces) > len(body) and max(p.n for p in pieces) < 1.1 * files.PIECE + len(made) - len(body)
    got = files.objects(scanned)
    assert got.where("error is null").agg(F.count("*"), F.sum(F.try_variant_get("value", "$[0]", "bigint"))).first()[:] == (n, n * (n + 1) // 2)
    assert got.select(F.spark_partition_id()).distinct().count() > 3


def test_chains_of_references_and_references_inside(spark):
    """Two hops, a circle of three, one that ends at nothing, and `[0 0 6 0 R 7 0 R]` whose numbers are two hops away."""
    made = by_hand([
        b"1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n", b"2 0 obj <</Type/Pages/Kids[3 0 R 15 0 R]/MediaBox 4 0 R>> endobj\n", b"3 0 obj <</Type/Page/Rotate 9 0 R/CropBox[1 1 8 0 R 10 0 R]>> endobj\n", b"4 0 obj 5 0 R endobj\n",
        b"5 0 obj [0 0 6 0 R 7 0 R] endobj\n", b"6 0 obj 8 0 R endobj\n", b"7 0 obj 792 endobj\n", b"8 0 obj 612 endobj\n", b"9 0 obj 14 0 R endobj\n", b"10 0 obj 99 0 R endobj\n", b"11 0 obj 12 0 R endobj\n", b"12 0 obj 13 0 R endobj\n", b"13 0 obj 11 0 R endobj\n", b"14 0 obj 90 endobj\n", b"15 0 obj 16 0 R endobj\n", b"16 0 obj <</Type/Page>> endobj\n",
    ])
    scanned = scan(spark, made)
    found = objects_of(scanned, JSON)
    assert (found[0, 6], found[0, 9], found[0, 10], found[0, 11], found[0, 13], found[0, 4]) == ("612", "90", None, None, None, found[0, 5])
    got = pages.pages(scanned, files.objects(scanned)).orderBy("page_index").collect()
    assert (got[0].mediabox, got[0].cropbox, got[0].rotate, got[0].obj_no) == ([0, 0, 612, 792], [1, 1, 612, None], 90, 3)


def test_registered_filters_reach_the_workers(spark, monkeypatch):
    """In a content stream, in an object stream, and from SQL."""
    monkeypatch.setattr(codecs, "FILTERS", codecs.FILTERS | {})
    codecs.register("Turned", lambda data, params: data[::-1], lambda data, params=None: data[::-1])
    inside = b"3 0 <</Type /Page>>"
    packed = writer.object_bytes(2, {"Type": "ObjStm", "N": 1, "First": 4, "Filter": "Turned"}, inside[::-1])
    body = b"%PDF-1.5\n" + CATALOG
    places = [9, len(body)]
    body += packed
    rows = b"".join(bytes([k]) + a.to_bytes(4, "big") + b"\0" for k, a in ((1, places[0]), (1, places[1]), (2, 2)))
    table = writer.object_bytes(4, {"Type": "XRef", "W": [1, 4, 1], "Index": [1, 3], "Root": writer.ref(1), "Size": 5, "Filter": "Turned"}, rows[::-1])
    scanned = scan(spark, body + table + b"startxref\n%d\n%%%%EOF" % len(body))
    assert objects_of(scanned, "type", "error")[0, 3] == ("Page", None)
    codecs.register_sql(spark)
    assert spark.sql("select decode_stream(cast('cba' as binary), array('Turned')) d").first().d == b"abc"


def test_metrics_and_glyph_lists_from_files(spark, tmp_path):
    (tmp_path / "Times-BoldItalic.afm").write_text("StartFontMetrics 4.1\nFamilyName Times\nFontBBox -200 -218 996 921\nItalicAngle -15\nCapHeight 669\nStdHW 42\nC 32 ; WX 250 ; N space ; B 0 0 0 0 ;\nC -1 ; WX 500 ; N Abreve ; B 0 0 0 0 ;\nKPX A y -74\n")
    lines = metrics.read_metrics(spark, str(tmp_path / "*.afm"))
    row = metrics.font_metrics(lines).first()
    assert (row.font, row.widths, row.char_set, row.bbox, row.flags, row.cap_height, row.stem_h, row.stem_v) == ("Times-BoldItalic", [250.0], ["Abreve", "space"], [-200, -218, 996, 921], 96, 669, 42, None)
    assert [tuple(r) for r in metrics.kern_pairs(lines).collect()] == [("Times-BoldItalic", "A", "y", -74.0)]
    names = ["TimesNewRomanPS-BoldItalicMT", "ABCDEF+Arial", "Arial,Italic", "CourierNew-Bold", "Times", "Helvetica-BoldOblique", "Arialish", "ArialMT"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(metrics.standard_name(F.col("n"))).collect()
    assert [r[0] for r in got] == ["Times-BoldItalic", "Helvetica", "Helvetica-Oblique", "Courier-Bold", "Times-Roman", "Helvetica-BoldOblique", "Arialish", "Helvetica"]
    (tmp_path / "list.txt").write_text("# a comment\nA;0041\nlamvav;05DC 05D5\nodd;12\nA;0042\n")
    listed = encodings.read_glyph_list(spark, str(tmp_path / "list.txt"))
    assert sorted(map(tuple, listed.collect())) == [("A", "A"), ("lamvav", "\u05dc\u05d5")]
    rows = spark.createDataFrame(list(enumerate(["A.sc", "A_lamvav_A", "lamvav_uni0042_u1F600.x.y", ".notdef", "nothing", "A_nothing"])), "k int, glyph string")
    assert [r.text for r in encodings.glyph_texts(rows, ["k"], listed).orderBy("k").collect()] == ["A", "A\u05dc\u05d5A", "\u05dc\u05d5B\U0001f600", None, None, "A"]


def test_codes_and_glyphs_are_each_other(spark):
    """Differences that move a glyph, name one twice and take the code of another."""
    rows = spark.createDataFrame([("x", 1, "WinAnsiEncoding", ["65", "B", "zzz", "70", "B", "200", "A_A.alt"]), ("x", 2, "nonsense", None)], "path string, font_obj int, base_encoding string, differences array<string>")
    tables = {r.font_obj: r for r in pages.font_encodings(rows).collect()}
    assert (tables[1].glyphs[65:68], tables[1].texts[65:68], tables[1].glyphs[70], tables[1].texts[200]) == (["B", "zzz", "C"], ["B", None, "C"], "B", "AA") and tables[2].glyphs[0xA4] == "fraction"
    codes = {(r.font_obj, r.glyph): r.code for r in pages.glyph_codes(rows, ["path", "font_obj"]).collect()}
    assert (codes[1, "B"], codes[1, "zzz"], codes[1, "C"], codes[1, "A_A.alt"]) == (70, 66, 67, 200) and (1, "A") not in codes and (1, "F") not in codes
    assert all(tables[f].glyphs[c] == g for (f, g), c in codes.items())
