"""The registered queries: each applies an operator to a whole table, with the SQL that says the same."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, scalars, values
from ..functions.encodings import base_encodings, char_codes, glyph_lines, glyph_texts, numbered_glyph
from ..operators import layout, pages, state, tree
from ..sources import files, metrics, writer
from ..sources.syntax import SyntaxFault, value_at
from . import text as plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as there are cores, if they come in fewer: a small table is one task, and Python's work on it would use one core."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def parsed(source: Column) -> Column:
    """The first value in source (binary) as a variant; null if it is malformed."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            try:
                return None if data is None else json.dumps(value_at(bytes(data)))
            except SyntaxFault:
                return None

        return values.map(one)

    return F.try_parse_json(run(source))


def painted(text: Column, ends: bool = True) -> Column:
    """A content stream that shows the lines of text."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: writer.paint_lines(t or "", ends=ends))

    return run(text)


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-page file for each document."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("path"), writer.files_of(F.array("text")).alias("content"))


def conversation_files(spark: SparkSession, sf_dir: str, font: dict | None = None) -> DataFrame:
    """A file for each conversation, with a page for each turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: t["text"]).alias("texts"))
    grouped = spread(grouped)
    return grouped.select(F.col("conv_id").cast("string").alias("path"), writer.files_of(F.col("texts"), lambda t: writer.paint_lines(t, ends=False), font).alias("content"))


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def scaled(column: Column) -> Column:
    return F.floor(column * 10000 + 0.5).cast("bigint")


# --- filters --------------------------------------------------------------------------------------------


@query("select doc_id, cast(length(hex(text)) as bigint) n_hex, md5(lower(hex(text))) hex_md5, md5(text) text_md5 from documents")
def hex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", codecs.encode_streams(F.encode("text", "UTF-8"), ["ASCIIHexDecode"]).alias("raw"))
    docs = docs.select("doc_id", F.rtrim(F.decode("raw", "UTF-8"), F.lit(">")).alias("hexed"), codecs.decode_streams(F.col("raw"), F.array(F.lit("ASCIIHexDecode"))).alias("got"))
    return docs.select("doc_id", big(F.length("hexed")).alias("n_hex"), F.md5("hexed").alias("hex_md5"), F.md5("got.data").alias("text_md5"))


def round_trip(spark: SparkSession, sf_dir: str, filters: list[str], params: list | None = None) -> DataFrame:
    """What is left of documents that went through encoders and decoders, and how long they were in between."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", codecs.encode_streams(F.encode("text", "UTF-8"), filters, params).alias("raw"))
    decoded = codecs.decode_streams(F.col("raw"), F.array(*map(F.lit, filters)), F.lit(json.dumps(params)) if params else None)
    docs = docs.select("doc_id", F.length("raw").alias("n_raw"), decoded.alias("got"))
    return docs.select("doc_id", big("n_raw").alias("n_raw"), big(F.length("got.data")).alias("n_bytes"), F.md5("got.data").alias("text_md5"))


SAME_TEXT = "select doc_id, cast(strlen(text) as bigint) n_bytes, md5(text) text_md5 from documents"


@query("select doc_id, cast(5 * (strlen(text) // 4) + case when strlen(text) % 4 > 0 then strlen(text) % 4 + 1 else 0 end + 2 as bigint) n_raw, cast(strlen(text) as bigint) n_bytes, md5(text) text_md5 from documents")
def ascii85_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir, ["ASCII85Decode"])


@query("select doc_id, cast(strlen(text) + ceil(strlen(text) / 128.0) + 1 as bigint) n_raw, cast(strlen(text) as bigint) n_bytes, md5(text) text_md5 from documents")
def run_length_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir, ["RunLengthDecode"])


@query(SAME_TEXT)
def flate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir, ["FlateDecode"]).drop("n_raw")


@query(SAME_TEXT)
def flate_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir, ["FlateDecode"], [{"Predictor": 12, "Columns": 16}]).drop("n_raw")


@query(SAME_TEXT)
def lzw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir, ["LZWDecode"]).drop("n_raw")


@query(SAME_TEXT)
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir, ["ASCIIHexDecode", "FlateDecode"]).drop("n_raw")


@query("select n_nationkey, name, case when name in ('FlateDecode', 'LZWDecode', 'Fl') then 'known' else 'unsupported' end status from (select n_nationkey, case n_nationkey % 5 when 0 then 'FlateDecode' when 1 then 'LZWDecode' when 2 then 'JPXDecode' when 3 then 'Fl' else n_name end as name from nation)")
def filter_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("case n_nationkey % 5 when 0 then 'FlateDecode' when 1 then 'LZWDecode' when 2 then 'JPXDecode' when 3 then 'Fl' else n_name end")
    return table(spark, sf_dir, "nation").select("n_nationkey", name.alias("name")).select("*", codecs.filter_status(F.col("name")).alias("status"))


# --- scalars --------------------------------------------------------------------------------------------


@query("select c_custkey, hex(unhex(left(hex(c_name), length(hex(c_name)) - 1) || '0')) hexed from customer")
def hex_string_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.expr("left(hex(c_name), length(hex(c_name)) - 1)")
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(scalars.hex_string(digits)).alias("hexed"))


@query("select doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: printf('%02X', ord(c))), '')) hex_md5, md5(text) text_md5 from documents")
def pdfdoc_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", scalars.pdfdoc_encode("text").alias("raw"))
    return docs.select("doc_id", F.md5(F.hex("raw")).alias("hex_md5"), F.md5(scalars.pdfdoc_decode("raw")).alias("text_md5"))


@query(r"select conv_id, turn, cast(length(text) - length(regexp_replace(text, '[\\()\r\n]', '', 'g')) as bigint) n_escapes, md5(text) text_md5 from conversations")
def literal_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "text", scalars.encode_literal("text").alias("written"))
    value = parsed(F.encode("written", "ISO-8859-1"))
    return turns.select("conv_id", "turn", big(F.length("written") - F.length("text") - 2).alias("n_escapes"), F.md5(values.text(value, "text")).alias("text_md5"))


@query("select doc_id, cast(2 * length(text) + 2 as bigint) n_bytes, md5(text) text_md5 from documents")
def utf16_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")).alias("raw"))
    return docs.select("doc_id", big(F.length("raw")).alias("n_bytes"), F.md5(scalars.string_text("raw")).alias("text_md5"))


@query("select p_partkey, p_name as name from part")
def name_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.name_text(F.expr("concat('/', replace(p_name, ' ', '#20'))")).alias("name"))


@query("""select l_orderkey, l_linenumber, case when k = 0 then q end int_value, case k when 0 then cast(q as double) when 1 then -(q + 0.25::double) when 2 then cast(l_linenumber as double) / 10 end real_value
from (select l_orderkey, l_linenumber, cast(trunc(l_quantity) as bigint) q, (l_orderkey + l_linenumber) % 5 k from lineitem)""")
def number_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.expr("case (l_orderkey + l_linenumber) % 5 when 0 then concat(cast(l_quantity as bigint), '') when 1 then concat('-', cast(l_quantity as bigint), '.25') when 2 then concat('.', l_linenumber) when 3 then concat(cast(l_quantity as bigint), 'e5') else concat('1_', cast(l_quantity as bigint)) end")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", token.alias("token")).select("l_orderkey", "l_linenumber", scalars.integer_literal("token").alias("int_value"), scalars.number_literal("token").alias("real_value"))


@query("select n_nationkey, '<</Key ' || n_nationkey || ' /Name (' || n_name || ') /Region ' || n_regionkey || '>>' written, n_name as name, cast(n_regionkey as bigint) region from nation")
def value_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.create_map(F.lit("Key"), F.col("n_nationkey").cast("string"), F.lit("Name"), scalars.encode_literal("n_name"), F.lit("Region"), F.col("n_regionkey").cast("string"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", scalars.encode_dict(entries).alias("written")).withColumn("value", parsed(F.encode("written", "ISO-8859-1")))
    return rows.select("n_nationkey", "written", values.text("value", "Name.text").alias("name"), values.part("value", "Region", "bigint").alias("region"))


@query("select o_orderkey, '[' || o_orderkey || ' ' || o_custkey || ' (' || o_orderstatus || ')]' written, cast(3 as bigint) n_items, o_custkey item from orders")
def value_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), scalars.encode_literal("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", scalars.encode_array(items).alias("written")).withColumn("value", parsed(F.encode("written", "ISO-8859-1")))
    return rows.select("o_orderkey", "written", big(F.size(F.try_variant_get("value", "$", "array<variant>"))).alias("n_items"), F.try_variant_get("value", "$[1]", "bigint").alias("item"))


@query("select o_orderkey, c_name as name from orders left join customer on c_custkey = 2 * o_custkey")
def reference_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.to_variant_object(F.struct(F.lit("ref").alias("t"), (F.col("o_custkey") * 2).alias("n"), F.lit(0).alias("g")))
    rows = table(spark, sf_dir, "orders").select(F.lit("x").alias("path"), "o_orderkey", ref.alias("ref"))
    targets = table(spark, sf_dir, "customer").select(F.lit("x").alias("path"), F.col("c_custkey").cast("int").alias("obj_no"), F.col("c_name").alias("value"))
    return files.resolve(rows, "ref", targets, "name").select("o_orderkey", "name")


@query("select r_regionkey, '1.' || r_regionkey as version from region")
def header_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.expr("encode(concat(if(r_regionkey % 2 = 0, '%PDF-1.', '%!PS-Adobe-3.0 PDF-1.'), r_regionkey, char(10), 'x'), 'UTF-8')")
    return table(spark, sf_dir, "region").select("r_regionkey", scalars.header_version(head).cast("string").alias("version"))


@query("select n_nationkey, cast((n_nationkey % 3 + 1) * 100 + n_nationkey as bigint) startxref from nation")
def startxref_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr(r"encode(array_join(transform(sequence(1, n_nationkey % 3 + 1), i -> concat('startxref', char(10), i * 100 + n_nationkey, char(10), '%%EOF', char(10))), repeat('x', 400)), 'UTF-8')")
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.last_startxref(body).alias("startxref"))


@query("select o_orderkey, printf('%010d %05d ', o_orderkey * 20, o_custkey % 7) || case when o_orderstatus <> 'F' then 'n' else 'f' end line, o_orderkey * 20 as position, o_custkey % 7 as generation, o_orderstatus <> 'F' in_use from orders")
def xref_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = scalars.encode_xref(F.expr("o_orderkey * 20"), F.expr("o_custkey % 7"), F.expr("o_orderstatus <> 'F'"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")).withColumn("f", scalars.xref_fields("line"))
    return rows.select("o_orderkey", F.rtrim(F.translate("line", "\r\n", "")).alias("line"), "f.position", big("f.generation").alias("generation"), "f.in_use")


@query("select l_orderkey, cast(2 + l_partkey % 3 as bigint) obj_no, max(l_linenumber)::bigint as value, count(*)::bigint n_entries from lineitem group by all")
def xref_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a file with a revision for each of its lines, the last the newest, which has one of three objects."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as string) path", "-l_linenumber revision", "0 seq", "cast(2 + l_partkey % 3 as int) obj_no", "0 generation", "l_linenumber position", "true in_use", "cast(null as int) container")
    counts = lines.groupBy("path", "obj_no").agg(F.count("*").alias("n_entries"))
    found = files.newest_entries(lines).join(counts, ["path", "obj_no"])
    return found.select(big("path").alias("l_orderkey"), big("obj_no").alias("obj_no"), big("position").alias("value"), "n_entries")


@query("select l_orderkey, l_linenumber, cast(1 as bigint) kind, l_orderkey as a, cast(l_linenumber as bigint) b from lineitem")
def xref_stream_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.unhex(F.format_string("01%08X%04X", "l_orderkey", "l_linenumber")).alias("raw"))
    part = lambda at, n: scalars.int_from_bytes(F.substring("raw", at, n))
    return rows.select("l_orderkey", "l_linenumber", part(1, 1).alias("kind"), part(2, 4).alias("a"), part(6, 2).alias("b"))


# --- documents and pages --------------------------------------------------------------------------------


@query("select t as type, (select count(*) from documents) n from (values ('Catalog'), ('Font'), ('Page'), ('Pages'), ('stream')) v(t)")
def objects_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.objects(files.scan_files(doc_files(spark, sf_dir)))
    return found.groupBy(F.coalesce("type", F.lit("stream")).alias("type")).agg(F.count("*").alias("n"))


@query("select doc_id, '1.4' as version, cast(6 as bigint) size, cast(5 as bigint) n_objects, cast(null as varchar) error from documents")
def file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.documents(files.scan_files(doc_files(spark, sf_dir)))
    return found.select(big("path").alias("doc_id"), F.col("version").cast("string").alias("version"), big("size").alias("size"), big("n_objects").alias("n_objects"), "error")


@query("select c_custkey, cast(2 as bigint) n_revisions, c_name as title, cast(c_nationkey as bigint) nation from customer")
def file_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose second revision replaces an object, for each customer; even keys have cross-reference and object streams."""

    @F.pandas_udf("binary")
    def made(keys: pd.Series, names: pd.Series, nations: pd.Series) -> pd.Series:
        def one(key: int, name: str, nation: int) -> bytes:
            first = writer.file_bytes({1: {"Type": "Catalog"}, 2: {"Title": b"old", "Nation": int(nation)}, 3: [int(nation)]}, info=2, as_stream=key % 2 == 0)
            return writer.file_bytes({2: {"Title": name.encode(), "Nation": int(nation)}}, info=2, before=first)

        return pd.Series([one(*x) for x in zip(keys, names, nations, strict=True)])

    content = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").cast("string").alias("path"), made("c_custkey", "c_name", "c_nationkey").alias("content"))
    scanned = files.scan_files(content)
    return files.documents(scanned).select(
        big("path").alias("c_custkey"), big("n_revisions").alias("n_revisions"), values.text("info", "Title.text").alias("title"), values.part("info", "Nation", "bigint").alias("nation")
    )


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = files.scan_files(conversation_files(spark, sf_dir))
    return pages.pages(scanned, files.objects(scanned))


@query("select conv_id, count(*) n_pages from conversations group by conv_id")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pages(spark, sf_dir).groupBy(big("path").alias("conv_id")).agg(F.count("*").alias("n_pages"))


@query("select conv_id, row_number() over (partition by conv_id order by turn) - 1 page_index, cast(4 + 2 * (row_number() over (partition by conv_id order by turn) - 1) as bigint) obj_no, cast(612 as bigint) width from conversations")
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pages(spark, sf_dir).select(big("path").alias("conv_id"), big("page_index").alias("page_index"), big("obj_no").alias("obj_no"), big(F.get("cropbox", F.lit(2))).alias("width"))


def customer_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions' trees of nations and customers, with a box on every region, every second nation and every fifth customer."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    kids = lambda key: F.array_sort(F.collect_list(key))
    nations = nation.groupBy(F.col("n_regionkey").alias("tree")).agg(kids("n_nationkey").alias("k"))
    tops = region.withColumnRenamed("r_regionkey", "tree").join(nations, "tree", "left").select("tree", F.lit("top").alias("node"), F.expr("coalesce(transform(k, x -> concat('n', x)), array())").alias("kids"), (F.col("tree") * 100).cast("bigint").alias("box"))
    members = customer.groupBy("c_nationkey").agg(kids("c_custkey").alias("k"))
    middles = nation.join(members, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_regionkey").alias("tree"), F.expr("concat('n', n_nationkey)").alias("node"), F.expr("coalesce(transform(k, x -> concat('c', x)), array())").alias("kids"), F.expr("case when n_nationkey % 2 = 0 then cast(n_nationkey as bigint) end").alias("box"))
    leaves = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("tree"), F.expr("concat('c', c_custkey)").alias("node"), F.lit(None).cast("array<string>").alias("kids"), F.expr("case when c_custkey % 5 = 0 then -c_custkey end").alias("box"))
    return tops.unionByName(middles).unionByName(leaves), region.select(F.col("r_regionkey").alias("tree"), F.lit("top").alias("node"))


@query("""with recursive t(tree, kind, key, path) as (
select r_regionkey, 0, cast(r_regionkey as bigint), [cast(0 as bigint)] from region
union all select t.tree, t.kind + 1, u.key, list_append(t.path, u.key) from t join (select 0 kind, cast(n_regionkey as bigint) parent, cast(n_nationkey as bigint) as key from nation union all select 1, c_nationkey, c_custkey from customer) u on u.kind = t.kind and u.parent = t.key)
select cast(tree as bigint) tree, key c_custkey, row_number() over (partition by tree order by path) - 1 place from t where kind = 2""")
def page_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = tree.numbered(tree.flatten(*customer_tree(spark, sf_dir)), "n")
    return leaves.select(big("tree").alias("tree"), big(F.substring("node", 2, 20)).alias("c_custkey"), big("n").alias("place"))


@query("select c_custkey, coalesce(case when c_custkey % 5 = 0 then -c_custkey end, case when n_nationkey % 2 = 0 then n_nationkey end, n_regionkey * 100) box from customer join nation on n_nationkey = c_nationkey")
def page_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.flatten(*customer_tree(spark, sf_dir), ("box",)).select(big(F.substring("node", 2, 20)).alias("c_custkey"), "box")


@query("""select c_custkey, coalesce(crop, media) cropbox, coalesce(bleed, crop, media) bleedbox, coalesce(crop, media) trimbox, coalesce(turn, 0) rotate from (select c_custkey, c_custkey media, case when c_custkey % 2 = 0 then c_custkey + 1 end crop, case when c_custkey % 3 = 0 then c_custkey + 2 end bleed, case when c_custkey % 7 = 0 then cast(90 as bigint) end turn from customer)""")
def page_box_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda when, plus: F.expr(f"case when {when} then array(double(c_custkey + {plus}), 0D, 612D, 792D) end")
    rows = table(spark, sf_dir, "customer").select("c_custkey", box("true", 0).alias("mediabox"), box("c_custkey % 2 = 0", 1).alias("cropbox"), box("c_custkey % 3 = 0", 2).alias("bleedbox"), box("false", 0).alias("trimbox"), box("false", 0).alias("artbox"), F.expr("case when c_custkey % 7 = 0 then 90 end").alias("rotate"))
    return pages.page_boxes(rows).select("c_custkey", *(big(F.get(c, F.lit(0))).alias(c) for c in ("cropbox", "bleedbox", "trimbox")), big("rotate").alias("rotate"))


# --- content streams ------------------------------------------------------------------------------------


@query("""select doc_id, opcode, case opcode when 'Tj' then n - case when text = '' or text like '%' || chr(10) then 1 else 0 end when 'T*' then n else 1 end n
from (select doc_id, text, cast(len(string_split(text, chr(10))) as bigint) n from documents), (values ('BT'), ('Tf'), ('TL'), ('Td'), ('Tj'), ('T*'), ('ET')) v(opcode)
where opcode <> 'Tj' or n - case when text = '' or text like '%' || chr(10) then 1 else 0 end > 0""")
def content_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", painted(F.col("text")).alias("content"))
    return layout.content_ops(contents, "doc_id").groupBy("doc_id", "opcode").agg(F.count("*").alias("n"))


@query("select event_id, opcode, coalesce(kind, 'other') optype from (select event_id, ['BT', 'Tj', 'Td', 'cm', 'Tf', 'Do'][event_id % 6 + 1] opcode from events) left join (values ('BT', 'text object'), ('Tj', 'text showing'), ('Td', 'text positioning'), ('cm', 'graphics state'), ('Tf', 'text state')) v(o, kind) on o = opcode")
def op_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    opcode = F.expr("array('BT', 'Tj', 'Td', 'cm', 'Tf', 'Do')[event_id % 6]")
    return table(spark, sf_dir, "events").select("event_id", opcode.alias("opcode")).select("*", layout.optype(F.col("opcode")).alias("optype"))


@query("select p_partkey, cast(strlen(p_name) + 6 as bigint) n_bytes, md5(p_name || 'EI x  ') data_md5, cast(p_size as bigint) width from part")
def inline_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.concat(F.lit("q BI /W "), F.col("p_size").cast("string"), F.lit(" /H 1 ID "), F.col("p_name"), F.lit("EI x   EI Q")), "ISO-8859-1")
    ops = layout.content_ops(table(spark, sf_dir, "part").select("p_partkey", content.alias("content")), "p_partkey").where("opcode = 'EI'")
    data = F.unhex(F.get("parts", F.lit(0))["hex"])
    return ops.select("p_partkey", big(F.length(data)).alias("n_bytes"), F.md5(data).alias("data_md5"), big(F.get_json_object("operands", "$[0].W")).alias("width"))


@query("select o_orderkey, seq, opcode from orders join (values (0, 0, 'T*'), (0, 1, 'Tj'), (1, 0, 'Tw'), (1, 1, 'Tc'), (1, 2, 'T*'), (1, 3, 'Tj'), (2, 0, 'TL'), (2, 1, 'Td'), (3, 0, 'Tj')) v(k, s, opcode) on k = o_orderkey % 4, (select 1) one, lateral (select cast(s as bigint) seq)")
def quote_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "array(\"'\", '\"', 'TD', 'Tj')[o_orderkey % 4] opcode", "array(1D, 2D) nums", "cast(array() as array<struct<hex: string, move: double>>) parts", "0 sub_idx")
    return layout.expand_ops(ops).select("o_orderkey", big("sub_idx").alias("seq"), "opcode")


def line_matrices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column], list[Column]]:
    q, k = F.floor("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    one, two = F.lit(1.0), F.lit(2.0)
    return table(spark, sf_dir, "lineitem"), [k, one, two, q, F.lit(3.0), k], [two, F.lit(0.0), one, k, q, F.lit(5.0)]


@query("""select l_orderkey, l_linenumber, cast(k * 2 + 1 as bigint) a, cast(k as bigint) b, cast(2 * 2 + q as bigint) c, cast(q * k as bigint) d, cast(3 * 2 + k + q as bigint) e, cast(k * k + 5 as bigint) f
from (select l_orderkey, l_linenumber, trunc(l_quantity) q, cast(l_linenumber as double) k from lineitem)""")
def matrix_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, m, n = line_matrices(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", *(big(x).alias(c) for c, x in zip("abcdef", state.multiply(m, n), strict=True)))


@query("select l_orderkey, l_linenumber, cast(l_linenumber * 7 + 2 * l_suppkey + 3 as bigint) x, cast(7 + trunc(l_quantity) * l_suppkey + l_linenumber as bigint) y from lineitem")
def matrix_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, m, _ = line_matrices(spark, sf_dir)
    x, y = state.apply_matrix(m, F.lit(7.0), F.col("l_suppkey").cast("double"))
    return rows.select("l_orderkey", "l_linenumber", big(x).alias("x"), big(y).alias("y"))


@query("""with recursive r as (select l_orderkey, cast(l_linenumber as bigint) k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) n from lineitem),
t as (select l_orderkey, n, cast(1 as bigint) a, cast(0 as bigint) b, cast(1 as bigint) c, cast(2 as bigint) d, k e, cast(1 as bigint) f from r where n = 1
union all select r.l_orderkey, r.n, t.a, t.b, t.a + 2 * t.c, t.b + 2 * t.d, r.k * t.a + t.c + t.e, r.k * t.b + t.d + t.f from t join r on r.l_orderkey = t.l_orderkey and r.n = t.n + 1)
select l_orderkey, max(n) n, arg_max(c, n) c, arg_max(d, n) d, arg_max(e, n) e, arg_max(f, n) f from t group by l_orderkey""")
def matrix_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr("array(1D, 0D, 1D, 2D, double(l_linenumber), 1D)")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", m.alias("m")))), lambda r: r["m"]).alias("all"))
    rows = rows.select("l_orderkey", big(F.size("all")).alias("n"), state.matrix_chain(F.col("all")).alias("m"))
    return rows.select("l_orderkey", "n", *(big(F.get("m", F.lit(i))).alias(c) for i, c in enumerate("abcdef") if i > 1))


#: The order of an order's line items: keys repeat, so it goes on with what tells them apart.
ITEMS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
ITEM_ORDER = ", ".join(ITEMS)
SEGMENTS = f"(select *, count(case when l_linenumber = 1 then 1 end) over (partition by l_orderkey order by {ITEM_ORDER} rows between unbounded preceding and current row) seg from lineitem)"


def event_ops(spark: SparkSession, sf_dir: str, codes: str) -> DataFrame:
    """Each user's events as ops."""
    return table(spark, sf_dir, "events").selectExpr("user_id", "ts", "event_id", f"array({codes})[event_id % size(array({codes}))] opcode", "array(double(event_id % 50)) nums", "cast(null as string) name")


@query("""select event_id, coalesce(last_value(case when event_id % 4 = 0 then event_id % 50 end ignore nulls) over w, 0) tc, coalesce(last_value(case when event_id % 4 = 1 then event_id % 50 end ignore nulls) over w, 0) tw, coalesce(last_value(case when event_id % 4 = 2 then event_id % 50 end ignore nulls) over w, 0) tl
from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def text_state_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = state.text_cursor(event_ops(spark, sf_dir, "'Tc', 'Tw', 'TL', 'Tj'"), ["user_id"], ["ts", "event_id"])
    return got.select("event_id", *(big(c).alias(c) for c in ("tc", "tw", "tl")))


@query("""with recursive r as (select user_id, event_id, event_id % 5 k, event_id % 50 v, row_number() over (partition by user_id order by ts, event_id) n from events),
s as (select distinct user_id, cast(0 as bigint) event_id, cast(0 as bigint) n, cast([1, 0, 10] as bigint[]) now, cast([] as bigint[][]) stack from events
union all select r.user_id, cast(r.event_id as bigint), r.n,
case k when 0 then cast([v, now[2], now[3]] as bigint[]) when 3 then cast([now[1], v, now[3]] as bigint[]) when 4 then cast([now[1], now[2], v] as bigint[]) when 2 then case when len(stack) > 0 then stack[len(stack)] else now end else now end,
case k when 1 then list_append(stack, now) when 2 then stack[1:greatest(len(stack) - 1, 0)] else stack end
from s join r on r.user_id = s.user_id and r.n = s.n + 1)
select event_id, now[1] line_width, now[2] line_cap, now[3] miter_limit, cast(len(stack) as bigint) depth from s where n > 0""")
def graphics_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = state.graphics_state(event_ops(spark, sf_dir, "'w', 'q', 'Q', 'J', 'M'"), ["user_id"], ["ts", "event_id"])
    return got.select("event_id", *(big(c).alias(c) for c in ("line_width", "line_cap", "miter_limit", "depth")))


@query("""select event_id, coalesce(last_value(case when event_id % 4 = 0 then event_id % 50 end ignore nulls) over w, 100) tz, coalesce(last_value(case when event_id % 4 = 1 then event_id % 50 end ignore nulls) over w, 0) mode, coalesce(last_value(case when event_id % 4 = 2 then event_id % 50 end ignore nulls) over w, 0) rise
from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def text_state_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling (Tz), rendering mode (Tr) and rise (Ts)."""
    got = state.text_cursor(event_ops(spark, sf_dir, "'Tz', 'Tr', 'Ts', 'Tj'"), ["user_id"], ["ts", "event_id"])
    return got.select("event_id", big(F.round(F.col("th") * 100)).alias("tz"), big("mode").alias("mode"), big("rise").alias("rise"))


@query("""select event_id, coalesce(last_value(case when event_id % 4 = 0 then event_id % 50 end ignore nulls) over w, 0) line_join, coalesce(last_value(case when event_id % 4 = 1 then event_id % 50 end ignore nulls) over w, 0) flatness, coalesce(last_value(case when event_id % 4 = 2 then event_id % 50 end ignore nulls) over w, 0) dash_phase,
coalesce(last_value(case when event_id % 4 = 3 then 'Intent' || event_id % 3 end ignore nulls) over w, 'RelativeColorimetric') intent from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def graphics_state_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line join (j), flatness (i), dash (d) and rendering intent (ri)."""
    ops = event_ops(spark, sf_dir, "'j', 'i', 'd', 'ri'").withColumn("name", F.expr("if(event_id % 4 = 3, concat('Intent', event_id % 3), null)"))
    got = state.graphics_state(ops, ["user_id"], ["ts", "event_id"])
    return got.select("event_id", *(big(c).alias(c) for c in ("line_join", "flatness", "dash_phase")), "intent")


@query(f"""select l_orderkey, l_linenumber, cast(sum(trunc(l_quantity)) over w as bigint) x, cast(sum(l_linenumber) over w as bigint) y
from {SEGMENTS} window w as (partition by l_orderkey, seg order by {ITEM_ORDER} rows between unbounded preceding and current row)""")
def tm_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text matrix (Tm) sets the origin that moves (Td) then shift."""
    ops = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", *ITEMS, "if(l_linenumber = 1, 'Tm', 'Td') opcode", "if(l_linenumber = 1, array(1D, 0D, 0D, 1D, floor(l_quantity) * 1D, 1D), array(floor(l_quantity) * 1D, double(l_linenumber))) nums", "cast(null as string) name")
    return state.text_cursor(ops, ["l_orderkey"], ITEMS).select("l_orderkey", "l_linenumber", big("lm_e").alias("x"), big("lm_f").alias("y"))


@query("select c_custkey, chr(cast(65 + c_custkey % 26 as int)) || chr(cast(12354 + c_custkey % 50 as int)) as text from customer")
def glyph_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs named by their UTF-16 units."""
    glyph = F.concat(F.lit("uni"), *(F.lpad(F.hex(F.expr(x)), 4, "0") for x in ("65 + c_custkey % 26", "12354 + c_custkey % 50")))
    return table(spark, sf_dir, "customer").select("c_custkey", numbered_glyph(glyph).alias("text"))


@query("select p_partkey, chr(cast(65 + p_partkey % 26 as int)) glyph, cast(65 + p_partkey % 26 as bigint) code from part")
def char_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes looked up by glyph name."""
    known = char_codes(base_encodings(spark)).where("encoding = 'WinAnsiEncoding'").select("glyph", big("code").alias("code"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("chr(65 + p_partkey % 26)").alias("glyph"))
    return rows.join(F.broadcast(known), "glyph").select("p_partkey", "glyph", "code")


@query("select n_nationkey, '%' || n_name || ' end' || chr(10) as comment, '<' || hex(n_name) || '>' as hex_string, n_nationkey || ' 0 R' as reference from nation")
def encoded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, hex strings and references as they are written."""
    comment = scalars.encode_comment(F.concat("n_name", F.lit("\r\nend")))
    return table(spark, sf_dir, "nation").select("n_nationkey", comment.alias("comment"), scalars.encode_hex(F.encode("n_name", "UTF-8")).alias("hex_string"), scalars.encode_ref("n_nationkey", F.lit(0)).alias("reference"))


@query(f"""select l_orderkey, l_linenumber, cast(sum(case when l_linenumber > 1 then trunc(l_quantity) else 0 end) over w as bigint) x, cast(sum(case when l_linenumber > 1 then l_linenumber else 0 end) over w as bigint) y
from {SEGMENTS} window w as (partition by l_orderkey, seg order by {ITEM_ORDER} rows between unbounded preceding and current row)""")
def td_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", *ITEMS, "if(l_linenumber = 1, 'BT', 'Td') opcode", "array(floor(l_quantity) * 1D, double(l_linenumber)) nums", "cast(null as string) name")
    return state.text_cursor(ops, ["l_orderkey"], ITEMS).select("l_orderkey", "l_linenumber", big("lm_e").alias("x"), big("lm_f").alias("y"))


@query(f"""select l_orderkey, l_linenumber, cast(-sum(case when l_linenumber > 2 then tl else 0 end) over (partition by l_orderkey, seg order by {ITEM_ORDER} rows between unbounded preceding and current row) as bigint) y
from (select *, coalesce(last_value(case when l_linenumber = 2 then trunc(l_quantity) end ignore nulls) over (partition by l_orderkey order by {ITEM_ORDER} rows between unbounded preceding and current row), 0) tl from {SEGMENTS})""")
def tstar_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", *ITEMS, "case l_linenumber when 1 then 'BT' when 2 then 'TL' else 'T*' end opcode", "array(floor(l_quantity) * 1D) nums", "cast(null as string) name")
    return state.text_cursor(ops, ["l_orderkey"], ITEMS).select("l_orderkey", "l_linenumber", big("lm_f").alias("y"))


@query("""select p_partkey, cast(floor((length(p_name) * 600 / 1000.0::double * p_size + length(p_name) * 1.5::double + (length(p_name) - length(replace(p_name, ' ', ''))) * 2) * 0.5::double * 10000 + 0.5) as bigint) string_move, cast(floor(-p_size / 1000.0::double * p_size * 0.5::double * 10000 + 0.5) as bigint) number_move from part""")
def tj_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    moved = state.advance(F.array_repeat(F.lit(600.0), 256), layout.codes_of(F.hex("p_name")), size, F.lit(1.5), F.lit(2.0), F.lit(0.5))
    return table(spark, sf_dir, "part").select("p_partkey", scaled(moved).alias("string_move"), scaled(state.number_advance(size, size, F.lit(0.5))).alias("number_move"))


# --- fonts ----------------------------------------------------------------------------------------------


@query("""select encoding, count(*) parts from (select unnest(['StandardEncoding', 'MacRomanEncoding', 'WinAnsiEncoding', 'PDFDocEncoding']) encoding), (select p_partkey % 128 code from part) where code between 32 and 126 or encoding = 'PDFDocEncoding' and code between 24 and 31 group by encoding""")
def encoding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose number, below 128, is a code that each base encoding has."""
    rows = table(spark, sf_dir, "part").select(F.expr("cast(p_partkey % 128 as int)").alias("code"))
    got = rows.join(F.broadcast(base_encodings(spark)), "code")  # under 1,000 rows
    return got.groupBy("encoding").agg(F.count("*").alias("parts"))


@query("select p_partkey, cast(code as bigint) code, case when code <> 173 then chr(cast(code as int)) end as text from (select p_partkey, case when p_partkey % 2 = 0 then 32 + p_partkey % 95 else 161 + p_partkey % 95 end code from part)")
def encoding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("cast(case when p_partkey % 2 = 0 then 32 + p_partkey % 95 else 161 + p_partkey % 95 end as int)")
    win = base_encodings(spark).where("encoding = 'WinAnsiEncoding'").select("code", "text")
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).join(F.broadcast(win), "code", "left").select("p_partkey", big("code").alias("code"), "text")


@query("""select p_brand, cast(code as bigint) code, arg_max(glyph, p_partkey) glyph from (select p_brand, p_partkey, glyph, first_value(num) over (partition by p_brand, part order by p_partkey) + row_number() over (partition by p_brand, part order by p_partkey) - 2 code, num
from (select *, count(num) over (partition by p_brand order by p_partkey) part from (select p_brand, p_partkey, case when p_partkey % 5 = 0 then p_size end num, case when p_partkey % 5 <> 0 then 'g' || p_partkey end glyph from part))) where num is null and code is not null group by p_brand, code""")
def encoding_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.expr("if(p_partkey % 5 = 0, cast(p_size as string), concat('g', p_partkey))")
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda r: r["item"]).alias("differences"))
    return pages.differences(rows, ["p_brand"]).select("p_brand", big("code").alias("code"), "glyph")


@query("select l_orderkey, l_linenumber, cast(case when l_partkey % 300 between 32 and 126 then (l_partkey % 300 - 32) * 2 else l_suppkey end as bigint) width from lineitem")
def glyph_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = F.transform(F.sequence(F.lit(0), F.lit(94)), lambda i: i * 2.0)
    width = pages.glyph_width(F.expr("cast(l_partkey % 300 as int)"), F.lit(32), F.lit(126), widths, F.col("l_suppkey").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", big(width).alias("width"))


@query("""select p_partkey, cast(floor(sum(case when c between 97 and 122 then 4 else 1 end * (c + p_size)) / cast(sum(case when c between 97 and 122 then 4 else 1 end) as double) * 10000 + 0.5) as bigint) width
from part, (select unnest(generate_series(65, 122)) c) where (c between 65 and 90 or c between 97 and 122) and c % 7 <> p_size % 7 group by p_partkey""")
def avg_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = F.expr("transform(sequence(0, 255), c -> if(c % 7 = p_size % 7, 0D, double(c + p_size)))")
    return table(spark, sf_dir, "part").select("p_partkey", scaled(pages.average_width(widths)).alias("width"))


@query("""select p_brand as font, min(c) first_char, max(c) last_char, cast(max(c) - min(c) + 1 as bigint) n_widths, cast(sum(w) as bigint) total from (select p_brand, cast(p_size + 32 as bigint) c, min(p_size * 10) w from part group by all) group by p_brand""")
def std_font_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics files, one for each brand, read back."""
    lines = table(spark, sf_dir, "part").selectExpr("p_brand font", "concat('C ', p_size + 32, ' ; WX ', p_size * 10, ' ; N g', p_size, ' ; B 0 0 0 0 ;') line").distinct()
    got = metrics.font_metrics(lines)
    return got.select("font", big("first_char").alias("first_char"), big("last_char").alias("last_char"), big(F.size("widths")).alias("n_widths"), big(F.aggregate("widths", F.lit(0.0), lambda s, w: s + w)).alias("total"))


@query("select doc_id, cast(length(text) as bigint) n_codes, md5(text) text_md5 from documents")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes of a font's encoding, decoded through the font's table."""
    font = spark.createDataFrame([("x", 3, json.dumps({"Type": {"t": "name", "v": "Font"}, "BaseFont": {"t": "name", "v": "Courier"}, "Encoding": {"t": "name", "v": "WinAnsiEncoding"}}), "Font", "Type1")], "path string, obj_no int, value string, type string, subtype string").withColumn("value", F.parse_json("value"))
    known = F.broadcast(pages.font_tables(pages.fonts(font)).select("texts"))  # one row
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", layout.codes_of(F.hex(F.encode("text", "ISO-8859-1"))).alias("codes")).join(known)
    text = F.array_join(F.transform("codes", lambda c: F.coalesce(F.get("texts", c), F.char(c))), "")
    return docs.select("doc_id", big(F.size("codes")).alias("n_codes"), F.md5(text).alias("text_md5"))


# --- layout ---------------------------------------------------------------------------------------------


@query("select l_orderkey, cast(round(round(l_partkey / 7.0::double, 1) * 10) as bigint) intercept, count(*) n, string_agg(l_linenumber::varchar, ',' order by l_linenumber) blocks from lineitem group by 1, 2")
def line_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, intercept = layout.line_ids(F.lit(0.0), F.lit(0.0), F.col("l_partkey") / 7.0, F.lit(0.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(intercept * 10).cast("bigint").alias("intercept"))
    return rows.groupBy("l_orderkey", "intercept").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("l_linenumber")), ",").alias("blocks"))


BLOCK_ORDER = [*ITEMS, "l_returnflag", "l_linestatus"]
BLOCKS = f"l_partkey % 400, {', '.join(BLOCK_ORDER)}"


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks of text, those of an order on one line."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", *ITEMS, "l_returnflag", "l_linestatus", "concat(l_returnflag, l_linestatus, l_linenumber) text", "double(l_partkey % 400) x0", "double(l_partkey % 400 + floor(l_quantity)) x1", "6D basis", "0D left")


@query(f"""select l_orderkey, l_linenumber, case when g / 6 >= 20 then chr(9) when g > 0 then repeat(' ', cast(trunc(g / 6) as int)) else '' end pad
from (select l_orderkey, l_linenumber, l_partkey % 400 - lag(l_partkey % 400 + trunc(l_quantity)) over (partition by l_orderkey order by {BLOCKS}) g from lineitem)""")
def block_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("x0") - F.lag("x1").over(Window.partitionBy("l_orderkey").orderBy("x0", *BLOCK_ORDER))
    return line_blocks(spark, sf_dir).select("l_orderkey", "l_linenumber", F.coalesce(layout.spacing(gap, F.col("basis"), 20.0), F.lit("")).alias("pad"))


@query(f"""with recursive r as (select l_orderkey, l_returnflag || l_linestatus || l_linenumber t, cast(trunc((l_partkey % 400) / 6.0::double) as int) c, row_number() over (partition by l_orderkey order by {BLOCKS}) n from lineitem),
s as (select l_orderkey, n, ' ' || repeat(' ', greatest(0, c - 1)) || t line from r where n = 1
union all select r.l_orderkey, r.n, s.line || repeat(' ', greatest(0, r.c - cast(length(s.line) as int))) || r.t from s join r on r.l_orderkey = s.l_orderkey and r.n = s.n + 1)
select l_orderkey, arg_max(line, n) line from s group by l_orderkey""")
def line_join_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.join_fixed(line_blocks(spark, sf_dir), ["l_orderkey"], BLOCK_ORDER)


@query(f"""select l_orderkey, string_agg(case when g > 0 then repeat(' ', cast(trunc(g / 6) as int)) else '' end || t, '' order by n) line
from (select l_orderkey, l_returnflag || l_linestatus || l_linenumber t, row_number() over w n, l_partkey % 400 - lag(l_partkey % 400 + trunc(l_quantity)) over w g from lineitem window w as (partition by l_orderkey order by {BLOCKS})) group by l_orderkey""")
def line_join_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.join_flow(line_blocks(spark, sf_dir), ["l_orderkey"], BLOCK_ORDER)


@query("""select * from (select conv_id, row_number() over (partition by conv_id order by turn) - 1 page_index, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) as text from conversations) where text <> ''""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = plans.layout_text(conversation_files(spark, sf_dir), fixed_width=False)
    return got.select(big("path").alias("conv_id"), big("page_index").alias("page_index"), "text")


@query("""select * from (select conv_id, row_number() over (partition by conv_id order by turn) - 1 page_index, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: '     ' || x), chr(10)) as text from conversations) where text <> ''""")
def page_text_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines start 36 points from the page's left edge, which is 5 columns of 7.2."""
    got = plans.layout_text(conversation_files(spark, sf_dir), fixed_width=True)
    return got.select(big("path").alias("conv_id"), big("page_index").alias("page_index"), "text")


@query("select doc_id, text from documents where text <> ''")
def simple_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.simple_text(doc_files(spark, sf_dir)).select(big("path").alias("doc_id"), "text")


# --- references, trees and nested state -----------------------------------------------------------------


def as_variant(value: Column) -> Column:
    return F.to_variant_object(value)


def pointer(number: Column) -> Column:
    """A reference, as the scan gives it."""
    return F.struct(F.lit("ref").alias("t"), number.cast("int").alias("n"), F.lit(0).alias("g"))


@query("select c_custkey, case when c_custkey % 8 <> 3 then name end as name from customer left join (select c_custkey as k, c_name as name from customer) on k = c_custkey - c_custkey % 4")
def reference_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as objects: every fourth has a name, the others point at the one before, up to three hops away, or at themselves or at nothing."""
    key = F.col("c_custkey")
    value = F.when(key % 4 == 0, F.parse_json(F.to_json(F.struct(F.col("c_name").alias("v"))))).when(key % 8 == 3, F.parse_json(F.to_json(pointer(key)))).otherwise(F.parse_json(F.to_json(pointer(key - 1))))
    made = table(spark, sf_dir, "customer").select(F.lit("x").alias("path"), key.cast("int").alias("obj_no"), value.alias("value"))
    return files.settled(made).select(big("obj_no").alias("c_custkey"), values.text("value", "v").alias("name"))


@query("""select o_orderkey, cast(0 as bigint) a, cast(o_custkey as bigint) b, cast(c.c_nationkey as bigint) c, cast(d.c_nationkey as bigint) d, cast(e.c_nationkey as bigint) e
from orders left join customer c on c.c_custkey = o_custkey left join customer d on d.c_custkey = 2 * o_custkey left join customer e on e.c_custkey = case when o_orderkey % 2 = 0 then o_orderkey end""")
def references_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array whose last two numbers, and a dictionary one of whose entries, are objects of their own; every second order has the entry."""
    box = F.array_join(F.array(F.lit("0"), F.col("o_custkey").cast("string"), F.to_json(pointer(F.col("o_custkey"))), F.to_json(pointer(2 * F.col("o_custkey")))), ",")
    entry = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(pointer(F.col("o_orderkey")).alias("E")))).otherwise("{}")
    rows = table(spark, sf_dir, "orders").select(F.lit("x").alias("path"), "o_orderkey", F.parse_json(F.concat(F.lit("["), box, F.lit("]"))).alias("Box"), F.parse_json(entry).alias("Dict"))
    targets = table(spark, sf_dir, "customer").select(F.lit("x").alias("path"), F.col("c_custkey").cast("int").alias("obj_no"), F.parse_json(F.col("c_nationkey").cast("string")).alias("value"))
    got = files.resolve_inside(rows, ["path", "o_orderkey"], {"Box": "array<double>", "Dict": None}, targets)
    item = lambda i: F.try_variant_get(F.get("Box_items", F.lit(i)), "$", "bigint")
    return got.select("o_orderkey", *(item(i).alias(c) for i, c in enumerate("abcd")), F.try_variant_get(F.try_element_at("Dict_entries", F.lit("E")), "$", "bigint").alias("e"))


@query("select cast(p_partkey as bigint) p_partkey, cast(30 as bigint) first_char, p_size || ',' || case when p_partkey % 3 = 0 then p_size + 2 else p_size + 1 end || ',7' widths, p_name as char_set, cast(p_size as double) missing_width from part")
def font_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts of files made for parts: widths, the list of them and the descriptor in objects of their own."""

    @F.pandas_udf("binary")
    def made(keys: pd.Series, sizes: pd.Series, names: pd.Series) -> pd.Series:
        def one(key: int, size: int, name: str) -> bytes:
            font = {"Type": "Font", "Subtype": "Type1", "BaseFont": "X", "FirstChar": writer.ref(8), "LastChar": 32, "Widths": writer.ref(4), "FontDescriptor": writer.ref(6)}
            second = writer.ref(5) if key % 3 == 0 else int(size) + 1
            glyphs = b"".join(b"/" + word for word in name.encode().split())
            return writer.file_bytes({1: {"Type": "Catalog"}, 3: font, 4: [int(size), second, 7], 5: writer.ref(7), 6: {"MissingWidth": writer.ref(9), "CharSet": glyphs}, 7: int(size) + 2, 8: 30, 9: int(size)}, as_stream=key % 2 == 0)

        return pd.Series([one(*x) for x in zip(keys, sizes, names, strict=True)])

    content = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("path"), made("p_partkey", "p_size", "p_name").alias("content"))
    got = pages.fonts(files.objects(files.scan_files(content)))
    return got.select(big("path").alias("p_partkey"), big("first_char").alias("first_char"), F.array_join(F.transform("widths", big), ",").alias("widths"), F.array_join("char_set", " ").alias("char_set"), "missing_width")


@query("""select user_id, event_id, cast(n as bigint) depth, coalesce(case when event_id % 7 = 0 then event_id end, before, first_id * 10) as near from (
select *, last_value(case when event_id % 7 = 0 then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) before, first_value(event_id) over (partition by user_id order by ts, event_id) first_id,
row_number() over (partition by user_id order by ts, event_id) n, count(*) over (partition by user_id) all_n from events) where n = all_n""")
def page_tree_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a tree in which each event is the only child of the one before: a value at every seventh event, and at the root, is inherited."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("tree"), F.col("event_id").alias("node"), F.lead("event_id").over(w).alias("next"), (F.row_number().over(w) == 1).alias("top"))
    rows = rows.withColumn("box", F.when(F.col("node") % 7 == 0, F.col("node")).when(F.col("top"), F.col("node") * 10))
    nodes = rows.select("tree", "node", F.when(F.col("next").isNotNull(), F.array("next")).alias("kids"), "box")
    leaves = tree.flatten(nodes, rows.where("top").select("tree", "node"), ("box",))
    return leaves.select(F.col("tree").alias("user_id"), F.col("node").alias("event_id"), big(F.size("place") + 1).alias("depth"), F.col("box").alias("near"))


# --- glyphs and standard fonts --------------------------------------------------------------------------


@query("select p_partkey, p_brand || chr(cast(65 + p_partkey % 26 as int)) || case when p_partkey % 2 = 0 then chr(cast(12354 + p_partkey % 50 as int)) else '' end as text from part")
def glyph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names such as `gBrand#1_A_uni3042.alt`, the first part of which is in a glyph list made for the table's brands."""
    parts = table(spark, sf_dir, "part")
    brand = F.concat(F.lit("g"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    units = F.regexp_replace(F.hex(F.encode("p_brand", "UTF-16BE")), "(....)(?=.)", "$1 ")
    listed = glyph_lines(parts.select(F.concat(brand, F.lit(";"), units).alias("line")).distinct())
    letters = base_encodings(spark).where("encoding = 'StandardEncoding'").select("glyph", "text")
    wide = F.expr("if(p_partkey % 2 = 0, concat('_uni', lpad(hex(12354 + p_partkey % 50), 4, '0')), '')")
    glyph = F.concat(brand, F.lit("_"), F.expr("chr(65 + p_partkey % 26)"), wide, F.lit(".alt"))
    return glyph_texts(parts.select("p_partkey", glyph.alias("glyph")), ["p_partkey"], listed.unionByName(letters)).select("p_partkey", "text")


@query("""with d as (select p_brand, p_partkey, case when p_partkey % 5 = 0 then p_size + 60 end num, case when p_partkey % 5 <> 0 then chr(cast(65 + p_partkey % 26 as int)) end glyph from part),
c as (select p_brand, arg_max(glyph, p_partkey) glyph, max(p_partkey) p_partkey, code from (select *, first_value(num) over w + row_number() over w - 2 code from (select *, count(num) over (partition by p_brand order by p_partkey) part from d) window w as (partition by p_brand, part order by p_partkey)) where num is null and code is not null group by p_brand, code),
own as (select p_brand, glyph, arg_max(code, p_partkey) code from c group by all),
base as (select p_brand, chr(cast(k as int)) glyph, k code from (select distinct p_brand from part), (select unnest(range(65, 91)) k))
select p_brand, glyph, cast(code as bigint) code from own union all select p_brand, glyph, cast(code as bigint) from base where not exists (from c where c.p_brand = base.p_brand and c.code = base.code) and not exists (from own where own.p_brand = base.p_brand and own.glyph = base.glyph)""")
def glyph_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each capital letter's glyph in fonts whose differences are made of a brand's parts."""
    item = F.expr("if(p_partkey % 5 = 0, cast(p_size + 60 as string), chr(65 + p_partkey % 26))")
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda r: r["item"]).alias("differences"))
    got = pages.glyph_codes(rows.withColumn("base_encoding", F.lit("WinAnsiEncoding")), ["p_brand"])
    return got.where("glyph rlike '^[A-Z]$'").select("p_brand", "glyph", big("code").alias("code"))


@query("""with m as (select 32 + c_custkey % 95 code, max(c_custkey) width from customer group by all), t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 page_index, text from conversations),
x as (select conv_id, page_index, ord(unnest(string_split(text, ''))) code from t)
select conv_id, page_index, cast(floor(sum(coalesce(width, 0)) * 12 / 1000.0::double * 10000 + 0.5) as bigint) moved from x left join m using (code) where code <> 10 group by conv_id, page_index""")
def standard_font_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each page's strings reach in a font that names a standard one and has no widths; the metrics are made of customers' keys."""
    lines = table(spark, sf_dir, "customer").groupBy(F.expr("32 + c_custkey % 95").alias("code")).agg(F.max("c_custkey").alias("width"))
    lines = lines.select(F.lit("Helvetica-Bold").alias("font"), F.format_string("C %d ; WX %d ; N g%d ; B 0 0 0 0 ;", "code", "width", "code").alias("line"))
    font = {"Type": "Font", "Subtype": "Type1", "BaseFont": "ABCDEF+Arial,Bold", "Encoding": "WinAnsiEncoding"}
    _, parts = plans.page_runs(conversation_files(spark, sf_dir, font), metrics=metrics.font_metrics(lines))
    moved = parts.groupBy("path", "page_index").agg(F.sum(F.col("x1") - F.col("x0")).alias("moved"))
    return moved.select(big("path").alias("conv_id"), big("page_index").alias("page_index"), scaled(F.round("moved", 6)).alias("moved"))


@query("select cast(p_brand as varchar) as font, 'Family ' || p_brand family, cast(case when min(p_size) % 2 = 1 then 1 else 0 end + case when min(p_size) % 3 = 0 then 4 else 32 end + 64 as bigint) flags, cast(-min(p_size) as double) italic_angle, '0,-200,' || max(p_size) || ',900' bbox, cast(max(p_size) as double) ascent, cast(min(p_size) as double) stem_v from part group by p_brand")
def font_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptors of metrics files, one for each brand."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"))
    said = "array(concat('FamilyName Family ', p_brand), concat('ItalicAngle -', a), concat('IsFixedPitch ', a % 2 = 1), concat('CharacterSet ', if(a % 3 = 0, 'Special', 'ExtendedRoman')), concat('FontBBox 0 -200 ', b, ' 900'), concat('Ascender ', b), concat('StdVW ', a), 'C 32 ; WX 250 ; N space ; B 0 0 0 0 ;')"
    lines = rows.select(F.col("p_brand").alias("font"), F.explode(F.expr(said)).alias("line"))
    got = metrics.font_metrics(lines)
    return got.select("font", "family", big("flags").alias("flags"), "italic_angle", F.array_join(F.transform("bbox", big), ",").alias("bbox"), "ascent", "stem_v")


# --- what is written, and what a file says of itself ----------------------------------------------------


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'true' when 1 then 'false' else 'null' end as boolean, case when o_orderkey % 5 = 0 then 'null' else rtrim(rtrim(printf('%.6f', o_custkey / 8.0::double), '0'), '.') end as real, case o_orderkey % 3 when 0 then true when 1 then false end as back, case when o_orderkey % 5 <> 0 then o_custkey / 8.0::double end as real_back from orders")
def encoded_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans, nulls and reals as they are written, and read back."""
    boolean = F.expr("case o_orderkey % 3 when 0 then true when 1 then false end")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", scalars.encode_boolean(boolean).alias("boolean"), scalars.encode_real(F.expr("if(o_orderkey % 5 = 0, null, o_custkey / 8D)")).alias("real"))
    return rows.select("*", scalars.boolean_literal("boolean").alias("back"), scalars.number_literal("real").alias("real_back"))


@query("select c_custkey, lower(hex(c_name)) file_id, c_custkey % 3 = 0 encrypted, case when c_custkey % 3 = 0 then 'encrypted' end as error, cast(case when c_custkey % 3 = 0 then 0 when c_custkey % 2 = 0 then 4 else 2 end as bigint) n_objects, '1.' || (c_custkey % 8) as version from customer")
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with an identity in the trailer, a version in the catalog, and every third of them encrypted."""

    @F.pandas_udf("binary")
    def made(keys: pd.Series, names: pd.Series) -> pd.Series:
        def one(key: int, name: str) -> bytes:
            more = {"ID": [writer.string(name.encode())] * 2} | ({"Encrypt": writer.ref(2)} if key % 3 == 0 else {})
            return writer.file_bytes({1: {"Type": "Catalog", "Version": f"1.{key % 8}"}, 2: [name.encode()]}, trailer=more, as_stream=key % 2 == 0)

        return pd.Series([one(*x) for x in zip(keys, names, strict=True)])

    content = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").cast("string").alias("path"), made("c_custkey", "c_name").alias("content"))
    got = files.documents(files.scan_files(content)).select(big("path").alias("c_custkey"), F.try_variant_get("file_id", "$[1].hex", "string").alias("file_id"), "encrypted", "error", big("n_objects").alias("n_objects"), F.col("version").cast("string").alias("version"))
    return got.withColumn("version", F.when(F.col("encrypted"), F.concat(F.lit("1."), (F.col("c_custkey") % 8).cast("string"))).otherwise(F.col("version")))


@query("select l_orderkey, l_linenumber, case when -l_suppkey <= -(case when l_linenumber % 2 = 0 then trunc(l_quantity) else 50 end) then cast(-l_suppkey as bigint) else 0 end lowered from lineitem")
def rise_off_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that a rise moves to another line: by the leading, or where there is none by the height of capitals."""
    leading = F.when(F.col("l_linenumber") % 2 == 0, F.floor("l_quantity")).otherwise(0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", big(layout.off_line(-F.col("l_suppkey"), leading, F.lit(50))).alias("lowered"))


@query("select conv_id, turn, 2 * length(text) n_digits, md5(text) text_md5 from conversations")
def hex_strings_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as hex strings with white space and comments around them, through the parser of values."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    written = F.concat(F.lit("% a comment\n<<%another\n/A <"), F.regexp_replace(F.hex(F.encode("text", "ISO-8859-1")), "(.{60})", "$1\n"), F.lit("> >>"))
    value = parsed(F.encode(written, "ISO-8859-1"))
    return turns.select("conv_id", "turn", big(F.length(values.text(value, "A.hex"))).alias("n_digits"), F.md5(values.text(value, "A.text")).alias("text_md5"))


@query("select n_nationkey, n_name || ' 100%' as said, cast(null as varchar) as other from nation")
def comment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments written and read back; other tokens say nothing."""
    written = scalars.encode_comment(F.concat("n_name", F.lit(" 100%")))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.comment_text(written).alias("said"), scalars.comment_text(F.concat(F.lit("/"), "n_name")).alias("other"))


@query("select event_id, opcode, case opcode when 'Do' then 'external object' when 'Tf' then 'fonts' else coalesce(kind, 'other') end optype from (select event_id, ['BT', 'sh', 'Td', 'cm', 'Tf', 'Do'][event_id % 6 + 1] opcode from events) left join (values ('BT', 'text object'), ('Td', 'text positioning'), ('cm', 'graphics state')) v(o, kind) on o = opcode")
def opcode_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of opcodes with one of the caller's own, and one that the caller has put elsewhere."""
    opcode = F.expr("array('BT', 'sh', 'Td', 'cm', 'Tf', 'Do')[event_id % 6]")
    return table(spark, sf_dir, "events").select("event_id", opcode.alias("opcode")).select("*", layout.optype(F.col("opcode"), {"Do": "external object", "Tf": "fonts"}).alias("optype"))


@query("select doc_id, cast(strlen(text) as bigint) n_raw, cast(strlen(text) as bigint) n_bytes, md5(text) text_md5 from documents")
def registered_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a filter of the caller's own, which turns bytes around."""
    codecs.register("Turned", lambda data, params=None: data[::-1], lambda data, params=None: data[::-1])
    return round_trip(spark, sf_dir, ["Turned"])
