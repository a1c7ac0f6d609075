"""Operators against brute force, and their odd inputs: nulls, empty and long texts, repeats, clashing names."""

import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import dedup, gam, jaccard, licenses, lines, mixing, pieces, rules, sharding, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog and runs to the far end of a wide green field with no one in it"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, x_id long"


def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    words = PROSE.split()
    texts = [None, "", " \n\t ", "one", PROSE, PROSE, "a" * 5000, " ".join(words * 300), PROSE + " more", "é ▁ 日本 😀\r\n\x00", "\n".join([PROSE * 3] * 3)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, 1, True, i) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, PROSE, None, None, None, None, None, None), (4, "another text of the same id", None, "s1", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark):
    docs = odd(spark)
    got = dedup.mark_duplicates(docs).select("doc_id", "text", "keep_id", "group_size", "kept").collect()
    assert len(got) == docs.count()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    for r in got:
        ids = groups[r["text"] or ""]
        assert r["group_size"] == len(ids) and r["keep_id"] == max(i for i in ids if i is not None)
    kept = dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    collide = dedup.mark_duplicates(docs, digest=lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1)).cast("binary"))
    assert sorted(map(str, collide.select("doc_id", "keep_id", "group_size", "kept").collect())) == sorted(map(str, dedup.mark_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert dedup.mark_duplicates(empty(spark)).count() == 0


def test_sharding(spark):
    rows = [(i, PROSE[: (i * 37) % 90], None, None, None, None, None, None) for i in range(400)] + [(1000 + i, PROSE * 2, None, None, None, None, None, None) for i in range(200)]
    got = sharding.histogram_shards(spark.createDataFrame(rows, SCHEMA), 8).select("doc_id", "text", "size", "shard", "slot").toPandas()
    assert len(got) == 600 and (got["size"] == got["text"].str.len() + 16).all()
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 8 and per.max() - per.min() <= 2 * got["size"].max() + 0.02 * per.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert sharding.histogram_shards(odd(spark), 5).count() == odd(spark).count()
    assert sharding.histogram_shards(empty(spark), 5).count() == 0
    assert zlib.crc32(b"") == spark.range(1).select(F.crc32(F.lit(""))).first()[0]


def test_quality_rules(spark):
    for r in rules.quality_rules(odd(spark)).collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        grams = {}
        for i in range(len(w) - 7):
            grams.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {p + k for at in grams.values() if len(at) > 1 for p in at for k in range(8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        seen, dup = set(), 0
        for x in (x for x in t.split("\n") if WORD.search(x)):
            dup += x in seen
            seen.add(x)
        assert r["n_dup_lines"] == dup and r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert rules.quality_rules(empty(spark)).count() == 0


def test_classifier(spark):
    rng = np.random.default_rng(1)
    texts = [PROSE[: int(rng.integers(20, 100))] if i % 3 else "### ".join(PROSE.split()[: int(rng.integers(3, 20))]) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = gam.fit(docs, labels)
    got = docs.select("doc_id", gam.held_out(F.col("doc_id")).alias("h"), model.scores(F.col("text")).alias("s")).collect()
    held = [(r["s"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in got if r["h"]]
    assert len(held) > 80 and np.mean(held) > 0.95
    scores = [r[0] for r in odd(spark).select(model.scores(F.col("text"))).collect()]
    assert len(scores) == odd(spark).count() and all(0 <= s <= 1 for s in scores)
    assert 0 < gam.fit(docs, labels.limit(0)).score(gam.features([None]))[0] < 1


def test_mix(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), ["a", "b", None][i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    total = got["size"].sum()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert len(got) == 3000 and per["target"].sum() == pytest.approx(1.5 * total)
    assert (per["target"] <= 2 * per["size"] + 1e-6).all() and (got["taken"] <= 2 * got["size"]).all()
    assert ((per["taken"] - per["target"]).abs() <= 41).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(odd(spark)).count() == odd(spark).count()
    assert mixing.mixed(odd(spark)).columns == odd(spark).columns
    assert mixing.mix(empty(spark)).count() == 0


def brute_components(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(a), find(i)) for i, a in sets}


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 5)  # common shingles, at this size
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base, rows = " ".join(rng.choice(vocabulary, 120)), []
    for i in range(160):
        words = base.split() if i < 90 else list(rng.choice(vocabulary, int(rng.integers(1, 90)))) + base.split()[:20]
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = str(rng.choice(vocabulary))
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words)))
    rows += [(900, None), (901, ""), (902, "Two words"), (903, "two  WORDS")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    assert jaccard.jaccard_components(odd(spark)).count() == odd(spark).count()
    assert jaccard.one_per_component(odd(spark)).columns == odd(spark).columns
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_near_stage_links_five_words_at_four_fifths(spark, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(jaccard, "COMMON", 5)
    rng = np.random.default_rng(4)
    vocabulary, rows = [f"w{i}" for i in range(5000)], []
    for group in range(30):  # copies with up to six scattered edits of texts of all lengths, two of them with a passage in common
        base = list(rng.choice(vocabulary, int(rng.choice([6, 8, 9, 12, 40, 200])))) + ([f"p{i}" for i in range(60)] if group < 2 else [])
        for _ in range(6):
            words = list(base)
            for at in rng.choice(len(words), int(rng.integers(0, min(7, len(words)))), replace=False):
                words[at] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(words)))
    base = [f"q{i}" for i in range(200)]
    rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join("x" if i in (40, 80, 120, 160) else w for i, w in enumerate(base)))]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == {i for i in sets if top(i) == i}
    assert len(rows) - 2 in kept and len(rows) - 1 not in kept


def test_piece_codec(spark):
    own = pieces.Pieces.load(MODEL)
    texts = ["", " ", "the  cat\n sat", "é ▁ 日本 😀\r\n\x00", PROSE, "x" * 3000, "\tlead"]
    for t in texts:
        assert own.decode(own.encode(t)) == t

    def best(text):  # every segmentation of a short text
        found = {own.pieces[i].replace("▁", " "): own.scores[i] for i, k in enumerate(own.kinds) if k == pieces.NORMAL}
        score = [0.0] + [-1e30] * len(text)
        for e in range(1, len(text) + 1):
            score[e] = max([score[s] + found[text[s:e]] for s in range(e) if text[s:e] in found], default=-1e30)
        return score[-1]

    for w in (" the", " with", " reading", " fox", " unbelievable"):
        assert sum(own.scores[i] for i in own.viterbi(w)) == pytest.approx(best(w))
        assert own.viterbi_many([w, " a"])[0] == np.array(own.viterbi(w), np.int32).tobytes()
    shared = pieces.shared(spark, MODEL)
    got = pieces.tokenized(odd(spark), MODEL).withColumn("back", pieces.decoded(F.col("ids"), shared)).collect()
    assert all(r["back"] == r["text"] and r["n_ids"] == len(r["ids"] or []) for r in got) and len(got) == odd(spark).count()
    assert pieces.tokenized(empty(spark), MODEL).count() == 0


def brute_lines(rows, least):
    """Lines in a run of least words that occurred before: windows of each start and end, in order."""
    first, gone = {}, {}
    for ident, text in sorted(rows):
        ls = [x.strip() for x in (text or "").split("\n") if x.strip()]
        spans = set()
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                n = lambda x, y: sum(len(z.split()) for z in ls[x:y])
                if n(a, b) >= least and (n(a, b - 1) < least or n(a + 1, b) < least):
                    spans.add((a, b))
        for a, b in sorted(spans):
            place = first.setdefault(tuple(ls[a:b]), (ident, a, b))
            if place[0] != ident or a >= place[2]:
                gone.setdefault(ident, set()).update(range(a, b))
    return {i: len(s) for i, s in gone.items()}


def test_line_dedup(spark):
    rng = np.random.default_rng(3)
    pool = [" ".join(f"v{x}" for x in rng.integers(0, 50, int(n))) for n in rng.integers(1, 14, 30)]
    rows = [(i, "\n".join(str(x) for x in rng.choice(pool, int(rng.integers(1, 12))))) for i in range(60)]
    rows += [(100, "\n\n".join(pool[:8])), (101, "\n".join(["x", *pool[:8], "y"])), (102, None), (103, "")]
    got = {r["doc_id"]: r["n_removed"] for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least_words=20).collect()}
    assert {i: n for i, n in got.items() if n} == brute_lines(rows, 20) and len(got) == len(rows)
    assert lines.line_dedup(odd(spark)).count() == odd(spark).count()
    assert lines.line_dedup(empty(spark)).count() == 0


def test_urls(spark):
    entries = spark.createDataFrame([("domain", "Bad.example.com.", "block", "2024-02-01"), ("domain", "bad.example.com", "remove", "2024-03-01"), ("prefix", "bad.example.com/ok", "allow", "2024-01-01"), ("domain", None, "block", "2024-01-01")], "kind string, pattern string, action string, day string").withColumn("day", F.col("day").cast("date"))
    cases = [("http://www.bad.example.com/x", "2024-01-31", "keep"), ("http://www.bad.example.com/x", "2024-02-01", "drop"), ("HTTP://BAD.example.com:80", "2024-02-29", "drop"), ("http://bad.example.com/ok/1", "2024-02-02", "keep"), ("http://bad.example.com/okay", "2024-02-02", "drop"), ("http://bad.example.com/x", "2024-03-01", "keep"), ("http://notbad.example.com/", "2024-02-02", "keep"), (None, "2024-02-02", "keep"), ("nonsense", "2024-02-02", "keep"), ("http://bad.example.com/x", None, "keep")]
    pages = spark.createDataFrame([(i, *c) for i, c in enumerate(cases + cases[:2])], "page_id long, url string, fetched string, verdict string")
    got = urls.judge_urls(pages.withColumnRenamed("verdict", "want"), entries).collect()
    assert len(got) == len(cases) + 2 and all(r["verdict"] == r["want"] for r in got)
    assert urls.judge_urls(pages.limit(0), entries).count() == 0


def test_licenses(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.txt", "nothing here"), ("a/b/COPYING", "header\nLicensed under the Apache License, Version 2.0."), ("a/y.txt", "Licensed under CC BY-NC 4.0."), ("z.txt", "plain"), (None, None), ("a/b/c/x.txt", "nothing here")]
    docs = spark.createDataFrame([(i, p, t, "old") for i, (p, t) in enumerate(files)], "doc_id long, path string, text string, license string")
    got = {r["doc_id"]: (r["license"], r["how"], r["license_dir"]) for r in licenses.license_scan(docs).collect()}
    assert got == {0: ("MIT", "own", None), 1: ("Apache-2.0", "inherited", "a/b"), 2: ("Apache-2.0", "own", None), 3: ("CC-BY-NC-4.0", "own", None), 4: (None, "none", None), 5: (None, "none", None), 6: ("Apache-2.0", "inherited", "a/b")}
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_licenses_in_wrapped_headers(spark):
    def wrapped(text, sign):
        return "\n".join(f"{sign} {x}" for x in textwrap.wrap(text, 72))

    full = {t[0]: t[1] for t in licenses.TEMPLATES if len(t[1]) > 100}
    mit = full["MIT"] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    rest = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"
    files = [
        ("s/mit.py", "#!/bin/python\n# Copyright (c) 2020 A. Author\n#\n" + wrapped(mit, "#") + "\n\nimport os\n"),
        ("s/gpl.c", "/* tool\n" + wrapped(full["GPL-3.0"] + ", or (at your option) any later version.", " *") + "\n */\nint main;\n"),
        ("s/bsd.js", wrapped("Copyright A. Author. All rights reserved. " + full["BSD-3-Clause"] + ":", "//") + "\nvar x;\n"),
        ("s/apache.sh", wrapped(full["Apache-2.0"] + " http://www.apache.org/licenses/LICENSE-2.0", "#")),
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Author\n\n" + textwrap.fill(mit, 78) + "\n\n" + rest),
        ("m/src/x.py", "import os\n"),
        ("t.txt", "the software may use files free of charge with this notice\nand documentation without restriction"),
    ]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = [(r["license"], r["how"], r["license_dir"]) for r in licenses.license_scan(docs).orderBy("doc_id").collect()]
    own = [("MIT", "own", None), ("GPL-3.0", "own", None), ("BSD-3-Clause", "own", None), ("Apache-2.0", "own", None), ("MIT", "own", None)]
    assert got == [*own, ("MIT", "inherited", "m"), (None, "none", None)]


def test_pipeline_returns_documents(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
