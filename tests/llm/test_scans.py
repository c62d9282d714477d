"""Periodic runs, license scans and the filter audit: against brute force, against their SQL, and on awkward tables."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD
from test_queries import canonical

import __spark_entry__ as registry
from quire.llm import audit, licenses, oracles, periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    clash = "1 as runs, 'x' as collapsed, 2 as mask, 'y' as part, 'z' as print, 3 as n, 'q' as phrases, 4 as n_words, 'r' as row, 5 as _h"
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'en', null) as lang", *clash.split(", "))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_its_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = registry.queries()[name](spark, data).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


# --- periodic runs --------------------------------------------------------------------------------------


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def runs_by_hand(w, min_length=12):
    """By definition: every stretch, its smallest period, and whether a neighbour keeps it."""
    out = []
    for s in range(len(w)):
        for e in range(s + min_length, len(w) + 1):
            q = smallest_period(w[s:e])
            if e - s >= max(min_length, 2 * q) and not (s and w[s - 1] == w[s - 1 + q]) and not (e < len(w) and w[e] == w[e - q]):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_by_hand(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def random_texts(n, size, seed=3):
    rng = random.Random(seed)
    for i in range(n):
        w = [rng.choice("ab" if i % 3 else "abcd") for _ in range(rng.randrange(size))]
        at, p = rng.randrange(len(w) + 1), rng.randrange(1, 9)
        yield (w[:at] + (w[at : at + p] * 5)[: rng.randrange(40)] + w[at:])


def test_runs_equal_their_definition():
    for w in random_texts(150, 40):
        for least in (2, 12):
            got = periodic.primitive(periodic.agreements(periodic.word_ids([x.encode() for x in w]), 1, len(w), least))
            want = runs_by_hand(w, least)
            assert [tuple(r) for r in got.tolist()] == want
            assert periodic.collapse([x.encode() for x in w], got).split() == kept_by_hand(w, want)


def test_ranges_of_lags_give_the_same_runs(spark, monkeypatch):
    """Documents dealt as many ranges, words in blocks of a few lags, and runs whose multiples of the period lie in other ranges."""
    monkeypatch.setattr(periodic, "RANGE", 300)
    monkeypatch.setattr(periodic, "RANGE_LAGS", 3)
    monkeypatch.setattr(periodic, "CELLS", 500)
    texts = [" ".join(w) for w in random_texts(40, 40, 8)] + ["a b c " * 50, "x " * 100, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    long = {r.doc_id: r for r in periodic.periodic_runs(docs, long_text=1).collect()}
    assert short == long and sum(len(r.runs) > 1 for r in short.values()) > 5
    assert {d: [tuple(x) for x in r.runs] for d, r in long.items() if d < 40} == {d: runs_by_hand(t.split()) for d, t in enumerate(texts[:40])}
    assert [tuple(x) for x in long[40].runs] == [(0, 150, 3)] and long[40].collapsed == "a b c" and [tuple(x) for x in long[41].runs] == [(0, 100, 1)]


def test_planted_runs_and_digests_by_hand(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(random_texts(300, 60, 5))] + [(None, "a " * 30), (7, None), (8, ""), (9, " \t\n"), (10, "é x " * 13)]
    got = sorted(periodic.runs_digest(periodic.periodic_runs(periodic.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")))).collect(), key=str)
    want, planted = [], 0
    for d, text in rows:
        w = WORD.findall(text or "")
        h = 1 if d is None else zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)], planted + 1
        runs = runs_by_hand(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(lines), digest(" ".join(kept_by_hand(w, runs)))))
    assert planted > 10 and Counter(tuple(r) for r in got) == Counter(want)


def test_runs_on_awkward_rows(spark, awkward):
    got = periodic.periodic_runs(awkward, long_text=5000).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in AWKWARD)
    by = {r.doc_id: r for r in got}
    assert (by[4].n_words, by[5].collapsed, by[6].runs, by[9].n_words, by[9].runs) == (0, "", [], 30_000, [])
    many = spark.createDataFrame([(i, "same words here " * 9) for i in range(500)], "doc_id long, text string")
    assert periodic.periodic_runs(many, long_text=1).where("collapsed = 'same words here' and runs[0].period = 3").count() == 500
    assert periodic.periodic_runs(awkward.where("false")).count() == 0


# --- licenses -------------------------------------------------------------------------------------------


def random_template(rng, depth=0):
    parts = ["ab"[rng.randrange(2)]] if not depth else []
    for _ in range(rng.randrange(1, 5)):
        k = rng.randrange(5)
        parts.append(f"[{random_template(rng, depth + 1)}]" if k == 0 and depth < 2 else "{%d-%d}" % (lambda a: (a, a + rng.randrange(1, 3)))(rng.randrange(3)) if k == 1 else "abc"[rng.randrange(3)])
    return " ".join(parts) if parts else "a"


def test_automata_accept_what_their_templates_say():
    """Random templates against regular expressions made from the same text: acceptance, the longest end and the clauses passed."""
    rng = random.Random(7)
    accepted = 0
    for _ in range(400):
        template = random_template(rng)
        a = licenses.compile_template("x", template)
        whole, ends = oracles._pattern(template)
        words = [rng.choice("abc") for _ in range(rng.randrange(12))]
        line = " " + " ".join(words) + " "
        found = licenses.scan_text(" ".join(words), [a])
        text_at = {i: " " + " ".join(words[i:]) + " " for i in range(len(words))}
        first_clause = ends[0][0]
        starts = [i for i, t in text_at.items() if re.match(first_clause + " ", t)]
        longest = {}
        for i in starts:
            fits = [n for n in range(len(words) - i + 1) if re.fullmatch(whole, "".join(" " + w for w in words[i : i + n]))]
            if fits:
                longest[i] = max(fits)
        assert {x["start"]: x["length"] for x in found["licenses"]} == longest, template
        assert found["mandatory"] == max([0.0, *(n for p, n in ends if re.search(p + " ", line))]), (template, words)
        accepted += bool(longest)
    assert accepted > 50


def test_license_texts(spark):
    holder = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
    mit = dict(licenses.TEMPLATES)["mit"]
    texts = [
        holder, holder.replace("granted", "given"), "x Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 1.1", "under the MIT license. MIT\nLicense", "Licensed under CC BY-NC 4.0.",
        "licensed under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "mit-license", "mitlicense mıt license É", mit, None, "", "...",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_digest(licenses.scan_licenses(rows)).collect()}
    assert [got[i].labels for i in range(10)] == ["isc-text", "", "apache,apache-2.0", "apache", "mit", "cc-by-nc-4.0", "gpl,gpl-3.0,gpl-or-later", "mit", "", "mit"]
    assert (got[0].score, got[2].score, got[4].score, got[12].score) == (1.0, 1.0, 0.5, 0.0) and 0 < got[1].score < 1
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels, got[7].n_words, got[8].n_words) == (2, 2, 4, "mit", 2, 4)
    assert [(got[i].n_words, got[i].n_base, got[i].first_word, got[i].labels, got[i].score) for i in (10, 11, 12)] == [(0, 0, None, "", 0.0)] * 3
    spans = licenses.scan_licenses(rows).where("doc_id = 2").first()
    assert [(x.label, x.start, x.length) for x in spans.licenses] == [("apache-2.0", 1, 8)] and [(x.label, x.start, x.length) for x in spans.phrases] == [("apache", 4, 2)]


def test_licenses_on_awkward_rows(awkward):
    got = licenses.license_digest(licenses.scan_licenses(awkward)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in AWKWARD) and {r.doc_id: r.n_words for r in got}[10] == 30_001
    assert licenses.scan_licenses(awkward.where("false")).count() == 0


# --- the filter audit -----------------------------------------------------------------------------------


def audit_by_hand(rows, labels):
    """One filter after the other, on the rows themselves."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    fails = []
    for d, t, lang in rows:
        t, w = t or "", WORD.findall(t or "")
        on = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and first[t] < d]
        fails.append((lang or "", {x for x, y in zip("ABCDE", on, strict=True) if y}, d))
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in fails}:
        for order in permutations("ABCDE"):
            left = [(f, d) for p, f, d in fails if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                here = [(f, d) for f, d in left if x in f]
                redundant = sum(x in f for f, _ in gone)
                left = [(f, d) for f, d in left if x not in f]
                gone += here
                shapley[part, x] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, sum(f == {x} for p, f, _ in fails if p == part), sum(d in good for _, d in here), sum(d in toxic for _, d in here)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run_audit(rows, labels):
    got = audit.filter_audit(rows, labels, audit.quality_conditions(F.col("text")), duplicate="E").collect()
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got}


def test_audit_by_hand(spark, awkward):
    long = " ".join(f"w{i}" for i in range(220))
    rows = [(d, t, "en" if d and d % 2 == 0 else None) for d, t in AWKWARD] + [(100 + i, [long, long + " #", "A B " * 150, long.upper(), long][i % 5], ["en", "de", ""][i % 3]) for i in range(60)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (2, 1, 1), (104, 1, None), (None, 1, 1), (105, None, 1), (999, 1, 1)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as mask", "'x' as part", "'y' as print", "2 as n", "true as good")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text")
    want = audit_by_hand(rows, labels)
    assert run_audit(made, known) == want and len(want) == 3 * 600
    assert run_audit(made.where("false"), known) == {} and run_audit(made, known.where("false")).keys() == want.keys()


def test_duplicates_across_ranges(spark):
    """A text of two thirds of all rows lies in several ranges; so do rows that repeat its smallest id, and rows without one."""
    rng = np.random.default_rng(2)
    rows = [(int(i), "the same" if rng.random() < 0.67 else f"text {rng.integers(500)}") for i in rng.permutation(6000)]
    rows += [(min(d for d, t in rows if t == "the same"), "the same")] * 700 + [(None, "the same")] * 300
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).repartition(16)
    got = audit.failure_masks(made, {}, F.col("lang"), duplicate="E")
    first = {}
    for d, t in rows:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    assert Counter((r.doc_id, r.mask) for r in got.collect()) == Counter((d, int(d is not None and first[t] < d)) for d, t in rows)
