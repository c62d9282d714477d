"""The pipeline's stages against their operators, one row at a time."""

from collections import Counter

from pyspark.sql import functions as F
from test_operators import BASE, LONG, linked, shingles

import corpus_pipeline as pipeline
from quire.llm import langid, secret_scan, toxicity
from quire.llm.queries import language_model, toxicity_model


def test_stages_do_what_their_operators_say(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    tox, lang = toxicity_model(spark, data), language_model(spark, data)
    clean = {d for d, score in zip(rows, tox.scores([r.text for r in rows.values()]), strict=True) if score[0] < 0.5}
    step = dict(pipeline.STAGES)
    got = step["toxicity"](spark, docs, data)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == clean
    known = {d for d in clean if (p := lang.predict(rows[d].text))[0] != "und" and p[1] >= langid.KNOWN}
    got = step["language ID"](spark, got, data)
    assert {r.doc_id for r in got.collect()} == known
    single = step["n-gram Jaccard join"](spark, got, data)
    left = sorted(r.doc_id for r in single.collect())
    assert set(left) <= known and len(left) == len(set(left)) and single.columns == docs.columns
    bare = step["secret scans"](spark, single, data)
    texts = {r.doc_id: r for r in bare.collect()}
    assert sorted(texts) == left and all(r.n_chars == len(r.text or "") for r in texts.values())
    assert not any(secret_scan.base_spans(r.text or "") for r in texts.values())
    packed = pipeline.run(spark, data).collect()
    assert {r.doc_id for r in packed} == set(left) and max(r.offset + r.length for r in packed) <= 4096


def test_stages_on_awkward_rows(spark, data, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows and clashing columns through all stages; then an empty table."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    prose = docs.where("length(text) > 300 and lang = 'en'").orderBy("doc_id").first().text
    texts = [None, "", " \t\n", "12 34", LONG, LONG + " end", prose, prose + " more", prose + ' password = "hunter2hunter2"', BASE]
    rows = [(10**6 + i, t) for i, t in enumerate(texts)] + [(None, prose), (None, None), (10**6 + 6, prose), (10**6 + 9, BASE)]
    more = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "length(text) as n_chars", "cast(null as string) as lang", "'s' as source")
    clash = ["1 as score", "'x' as component_id", "2 as text_key", "'y' as kept_doc_id", "3 as copies", "4 as piece", "5 as sequence_id"]
    made = docs.unionByName(more.select(*(F.col(f.name).cast(f.dataType) for f in docs.schema))).selectExpr("*", *clash)
    made.write.parquet(f"{tmp_path}/some/documents.parquet")
    made.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for part in ("some", "none"):
        spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{tmp_path}/{part}/labels.parquet")
    at = f"{tmp_path}/some"
    made = spark.read.parquet(f"{at}/documents.parquet")
    rows_of = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    tox, lang, step = toxicity_model(spark, at), language_model(spark, at), dict(pipeline.STAGES)

    want = rows_of(made)
    score = {t: s[0] for t, s in zip({t for _, t in want}, tox.scores([*{t for _, t in want}]), strict=True)}
    want = Counter({k: n for k, n in want.items() if score[k[1]] < 0.5})
    got = step["toxicity"](spark, made, at)
    assert rows_of(got) == want and got.columns == made.columns
    want = Counter({k: n for k, n in want.items() if (p := lang.predict(k[1]))[0] != "und" and p[1] >= langid.KNOWN})
    got = step["language ID"](spark, got, at)
    assert rows_of(got) == want and got.columns == made.columns and want[10**6 + 6, prose] == 2 and want[None, prose] == 1
    of = linked([(d, shingles(t)) for d, t in want if d is not None])
    want = Counter({(d, t): n if d is None else 1 for (d, t), n in want.items() if d is None or of[d] == d})
    single = step["n-gram Jaccard join"](spark, got, at)
    assert rows_of(single) == want and single.columns == made.columns
    # Stages from here on keep every row, so they are also shown what the filters took away.
    bare = step["secret scans"](spark, made, at)
    left = rows_of(bare)
    assert Counter(d for d, _ in left.elements()) == Counter(r.doc_id for r in made.collect()) and left[10**6, None] == left[None, None] == 1
    assert not any(secret_scan.base_spans(t or "") for _, t in left) and left[10**6 + 8, prose + " password = \"hunter2hunter2\""] == 0
    packed = step["best-fit packing"](spark, bare, at).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _ in left.elements())
    assert max(r.offset + r.length for r in packed) <= 4096 and sum(r.doc_id == 10**6 + 4 for r in packed) > 1
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
