"""Operators without SQL against plain computations, and their odd inputs compared row by row."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import common, gam, jaccard, licenses, lines, mixing, pieces, sharding, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog and runs to the far end of a wide green field with no one in it"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(spark, rows, *names):
    """doc_id, text and source, and columns that have the names of results, of helpers and odd characters."""
    more = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, t, s, *["mine"] * len(names)) for i, t, s in rows], f"doc_id long, text string, source string{', ' + more if more else ''}")


# Quality classifier.


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(gam.FEATURES))).astype(np.float32)
    x[:, 3] = np.round(x[:, 3])  # ties
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(float)
    model = gam.train(x, y, rounds=20, pair_rounds=10)
    for row in x[:50]:
        total = model.base
        for i, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
            total += table[sum(row[i] >= e for e in edges)]
        for i, j, a, b, table in model.pairs:
            total += table[sum(row[i] >= e for e in a), sum(row[j] >= e for e in b)]
        assert model.score(row[None, :])[0] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)
    assert np.mean((model.score(x) >= 0.5) == (y > 0)) > 0.8


def test_a_tree_has_the_best_cuts():
    rng = np.random.default_rng(6)
    g, h = rng.normal(size=12), rng.uniform(0.5, 1, 12)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 4)
    first = max(range(1, 12), key=lambda c: gain(0, c) + gain(c, 12))
    got = gam._tree(g, h, 4.0, leaves=2)
    assert got[0] == pytest.approx(g[:first].sum() / (h[:first].sum() + 4)) and len(set(got.tolist())) == 2
    assert got[first - 1] == pytest.approx(got[0]) and got[first] != pytest.approx(got[0])


def test_classifier_ignores_order_repeats_and_other_columns(spark):
    rows = [(i, PROSE[: 20 + i % 60] if i % 3 else "### " * (1 + i % 5), "s") for i in range(200)]
    docs = clashing(spark, rows, "x_id", "x_label", "score", "quality")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(1, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    a, b = gam.fit(docs, labels), gam.fit(docs.repartition(5).orderBy(F.desc("doc_id")), labels.repartition(3))
    x = gam.features([r[1] for r in rows] + [None, "", "a" * 200_000])
    assert np.array_equal(a.score(x), b.score(x)) and ((a.score(x) > 0) & (a.score(x) < 1)).all()
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", gam.held_out(F.col("doc_id")).alias("h")).collect()}
    import zlib

    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}


# Mixing.


def filled(sizes, weights, share, most):
    """Targets by raising a level in small steps of the sorted stops."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), share * sum(sizes.values()), {}
    while left:
        rate = (total - sum(out.values())) / sum(w[s] for s in left)
        over = {s for s in left if w[s] * rate > most * sizes[s]}
        if not over:
            return out | {s: w[s] * rate for s in left}
        out |= {s: most * sizes[s] for s in over}
        left -= over
    return out


def test_mix_fills_targets_and_pivots_by_document(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 24)  # a tree of several levels
    rng = np.random.default_rng(7)
    rows = [(i, "w " * int(rng.integers(0, 60)), [None, "b", "a", "Z", "é"][min(4, int(rng.exponential(1)))]) for i in range(1500)]
    rows += [(5000 + i, "", "empty") for i in range(3)] + [(6000, None, None)]
    docs = clashing(spark, rows, "size", "target", "taken", "x_id", "x_p")
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = filled(sizes, (5.0, 2.0, 1.0), 1.5, 2.0)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = r["source"]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
        ratio = want[s] / sizes[s] if sizes[s] else 0
        if r["size"]:
            assert r["copies"] in (math.floor(ratio + 1e-9), math.ceil(ratio - 1e-9)) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)  # a document at most


def test_pivots_keep_mass_and_expectations():
    mass, p = np.array([5.0, 1.0, 3.0, 8.0, 2.0, 4.0]), np.array([0.2, 0.5, 0.7, 0.1, 0.9, 0.4])
    sums = np.zeros(6)
    for seed in range(3000):
        out, left = mixing.pivot([(i,) for i in range(6)], mass, p, seed)
        assert (mass * out).sum() == pytest.approx((mass * p).sum())
        assert all(0 <= x <= 1 for x in out) and sum(0 < x < 1 for x in out) == (left >= 0) <= 1
        sums += out
    assert np.abs(sums / 3000 - p).max() < 0.04


def test_mix_of_repeats_and_nulls(spark):
    rows = [(1, "one two three", "s")] * 7 + [(None, PROSE, None), (None, "other words", None), (1, "another text", "s")]
    docs = clashing(spark, rows, "copies")
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t))) for i, t, _ in rows)
    assert len({r["copies"] for r in got if r["size"] == 3}) == 1  # repeats share a draw
    out = mixing.mixed(docs)
    per = {(r["doc_id"], r["size"]): r["copies"] for r in got}
    assert out.columns == docs.columns and Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in out.collect()) == Counter({k: n * per[k] for k, n in Counter((r["doc_id"], r["size"]) for r in got).items() if per[k]})


# Shards.


def test_splitters_against_a_sort(spark):
    rng = np.random.default_rng(8)
    rows = [(i, PROSE[: int(rng.integers(1, 90))] if i % 5 else "same " * 3) for i in range(900)] + [(2000 + i, "big " * 400) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    h, k = sharding.key_columns(F.col("text"), F.col("doc_id"))
    keys = docs.select(h.alias("h"), k.alias("k"), sharding.row_size(F.col("text")).alias("size")).cache()
    bounds = sharding.splitters(keys, 9, 0.01, 0.0)
    order = sorted(map(tuple, keys.collect()))
    total = sum(r[2] for r in order)
    edges = np.r_[0, np.cumsum([r[2] for r in order])]
    for i, bound in enumerate(bounds, 1):
        below, goal = sum(r[2] for r in order if r[:2] < bound), total * i / 9
        here = order[int(np.searchsorted(edges, goal, side="right")) - 1]
        group = sum(r[0] == here[0] for r in order) > 1  # its edge counts within one row
        assert abs(below - goal) <= max(0.01 * total / 9, np.abs(edges - goal).min() + 1e-9, here[2] if group else 0)
    assert bounds == sorted(bounds)


def test_groups_of_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 300} " + PROSE[: i % 300 % 80]) for i in range(900)]  # three of each
    got = sharding.histogram_shards(clashing(spark, [(i, t, "s") for i, t in rows], "size", "slot", "x_h", "x_part"), 6).toPandas()
    assert (got.groupby("text")["shard"].nunique() == 1).mean() > 0.98 and "x_h" in got.columns and (got["x_part"] == "mine").all()
    per = got.groupby("shard")["size"].sum()
    assert per.max() <= 1.08 * per.mean() and per.min() >= 0.92 * per.mean()


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None), (None, None, None), (1, "", "s"), (1, "", "s"), (2, "x" * 300_000, "s"), (3, "é😀", None)]
    got = sharding.histogram_shards(clashing(spark, rows, "shard"), 4).collect()
    assert Counter((r["doc_id"], r["text"], r["size"]) for r in got) == Counter((i, t, len((t or "").encode()) + 16) for i, t, _ in rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


# N-gram join.


def components(rows, k, link):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= link * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return sets, [top(i) for i in range(len(rows))]


@pytest.mark.parametrize(("deal", "cell"), [(3, 4), (1024, 4096)])
def test_near_copies_of_odd_rows(spark, monkeypatch, deal, cell):
    monkeypatch.setattr(jaccard, "COMMON", 5)
    monkeypatch.setattr(jaccard, "DEAL", deal)  # large tiles, at this size
    monkeypatch.setattr(jaccard, "CELL", cell)
    rng = np.random.default_rng(9)
    vocabulary, rows = [f"w{i}" for i in range(3000)], []
    for g in range(12):
        base = list(rng.choice(vocabulary, 60)) + [f"shared{i}" for i in range(30)]
        for _ in range(8):
            words = list(base)
            words[int(rng.integers(0, 60))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(words)))
    rows += [(0, "another text of the same id " + PROSE), (None, PROSE + " x"), (None, PROSE + " x"), (None, rows[0][1]), (500, None), (501, " \t\n"), (502, "é 日本 😀"), (503, "É 日本 😀"), rows[3], rows[3]]
    docs = clashing(spark, [(i, t, "s") for i, t in rows], "node", "key", "root", "component_id", "x_id")
    sets, root = components(rows, 3, 90)
    names = {}
    for (i, _), r in zip(rows, root, strict=True):
        names[r] = i if names.get(r) is None else names[r] if i is None else min(i, names[r])
    want = Counter((i, len(u), names[r]) for (i, _), u, r in zip(rows, sets, root, strict=True))
    assert Counter(map(tuple, jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == want
    kept = jaccard.one_per_component(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    per = {}
    for (i, t), u, r in zip(rows, sets, root, strict=True):
        if got.get((i, t)) and u:
            per.setdefault(r, set()).add((i, t))
    assert set(per) == {r for r, u in zip(root, sets, strict=True) if u} and all(len(v) == 1 for v in per.values())
    assert all(i == names[r] for r, v in per.items() for i, _ in v) and got[500, None] == got[501, " \t\n"] == 1


def tile_table(rng, n, cell, blocks):
    """Rows of two tiles as the last round has them, split in blocks: sizes, places and roots at random."""
    import pyarrow as pa

    rows = []
    for cid in range(n):
        size, token = int(rng.integers(50, 61)), int(rng.integers(0, 2))
        row = {"token": token, "band": 0, "visits": bool(rng.random() < 0.3), "n": size, "pos": int(rng.integers(0, 7)), "cid": cid, "root": int(rng.choice([1, 1, 1, 2, cid])), "sig": b"\0" * (jaccard.BITS // 8)}
        block = int(rng.integers(0, blocks))
        if blocks == 1:
            rows.append(row | {"deal": 0, "side": 0, "sides": 1})
            continue
        deals = blocks + 1
        rows += [row | {"deal": b * deals + cid % deals, "side": 1, "sides": 2} for b in range(blocks)]
        if 190 * (size - row["pos"]) // 90 - size >= size:
            rows += [row | {"deal": block * deals + d, "side": 0, "sides": 2} for d in range(deals)]
    rows.sort(key=lambda r: (r["token"], r["band"], r["deal"], r["side"], r["n"], r["cid"]))
    table = pa.Table.from_pylist(rows, schema=pa.schema([("token", pa.int64()), ("band", pa.int32()), ("visits", pa.bool_()), ("n", pa.int64()), ("pos", pa.int32()), ("cid", pa.int64()), ("root", pa.int64()), ("sig", pa.binary()), ("deal", pa.int32()), ("side", pa.int32()), ("sides", pa.int32())]))
    return rows, table


@pytest.mark.parametrize(("blocks", "pairs"), [(1, 1_000_000), (3, 7)])
def test_cells_meet_all_pairs_that_may_link(monkeypatch, blocks, pairs):
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    rows, table = tile_table(np.random.default_rng(4), 150, 10, blocks)
    one = {r["cid"]: r for r in rows}
    want = set()
    for a in one.values():
        for b in one.values():
            if a["cid"] < b["cid"] and a["token"] == b["token"] and a["root"] != b["root"] and not (a["visits"] and b["visits"]):
                x, y = a["n"], b["n"]
                if 100 * min(x, y) >= 90 * max(x, y) and 190 * min(x - a["pos"], y - b["pos"]) >= 90 * (x + y):
                    want.add((a["cid"], b["cid"]))
    got = [(r["a"], r["b"]) for batch in jaccard._between_roots(90)(table.to_batches(40)) for r in batch.to_pylist()]
    assert want and set(got) == want


def test_texts_of_one_passage_and_a_tenth_of_their_own_words(spark):
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, passage + " " + " ".join(f"o{i}x{j}" for j in range(22 if i % 50 else 2)), "s") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sets, root = components([r[:2] for r in rows], 3, 90)
    got = {r[0]: r[1] for r in jaccard.jaccard_components(docs).select("doc_id", "component_id").collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 500


def test_a_filter_of_keys_loses_none(spark):
    rows = spark.range(5000).withColumn("x_bits", F.lit(1))
    keys = spark.range(0, 5000, 50).withColumnRenamed("id", "k")
    got = common.perhaps_in(rows, F.col("id"), keys, 100)
    assert got.columns == rows.columns and {r["id"] for r in got.collect()} >= set(range(0, 5000, 50)) and got.count() < 600


# Lines.


def removed(rows, least):
    """The places (row, line) in a run of least words that occurred before, from all pairs of runs."""
    space = " \t\n\x0b\x0c\r"
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    texts = [[x.strip(space) for x in (rows[i][1] or "").split("\n") if x.strip(space)] for i in order]
    seen, gone = {}, {}
    for place, ls in enumerate(texts):
        n = [len(WORD.findall(x)) for x in ls]
        spans = [(a, b) for a in range(len(ls)) for b in range(a + 1, len(ls) + 1) if sum(n[a:b]) >= least]
        for a, b in spans:
            first = seen.setdefault(tuple(ls[a:b]), (place, b))
            if first[0] != place or a >= first[1]:
                gone.setdefault(order[place], set()).update(range(a, b))
    return gone


def test_lines_against_all_runs(spark):
    rng = np.random.default_rng(10)
    pool = [" ".join(f"v{x}" for x in rng.integers(0, 40, int(n))) for n in rng.integers(1, 12, 25)] + ["　", "   ", "\x1c", "", "  ", "a　b c"]
    rows = [(i * 3 % 83, "\n".join(str(x) for x in rng.choice(pool, int(rng.integers(1, 14))))) for i in range(83)]
    rows += [(200, None), (201, ""), (None, "\n".join(pool[:9])), (202, "z\n" + "\n".join(pool[:9])), (203, "é " * 40 + "\r\n" + "é " * 40)]
    docs = clashing(spark, [(i, t, "s") for i, t in rows], "n_lines", "clean_text", "x_of", "x_text", "key", "id")
    want = removed(rows, 20)
    got = {r["doc_id"]: r for r in lines.line_dedup(docs, least_words=20).collect()}
    assert len(got) == len(rows)
    for place, (i, t) in enumerate(rows):
        r, space = got[i], " \t\n\x0b\x0c\r"
        solid = [x for x in (t or "").split("\n") if x.strip(space)]
        keep = [x for k, x in enumerate(solid) if k not in want.get(place, ())]
        assert (r["n_lines"], r["n_removed"]) == (len(solid), len(solid) - len(keep)) and r["x_of"] == r["id"] == "mine"
        assert (r["clean_text"] is None) == (t is None) and [x for x in (r["clean_text"] or "").split("\n") if x.strip(space)] == keep


def test_windows_select_their_least_hash():
    rng = np.random.default_rng(11)
    hashes, sizes = rng.integers(0, 9, 60).astype(np.uint64), rng.integers(1, 9, 60).astype(np.int32)
    ends = lines.ends_of(sizes, 20)
    for i, at in enumerate(lines.minima(hashes, ends)):
        if sizes[i:].sum() < 20:
            assert at == -1
        else:
            b = next(b for b in range(i + 1, 61) if sizes[i:b].sum() >= 20)
            assert b == ends[i] and at == i + int(np.argmin(hashes[i:b]))


def test_rows_that_repeat_an_id_and_a_text_keep_their_lines(spark):
    long = "\n".join([PROSE] * 2 + ["x " * 30])
    rows = [(1, long, "s"), (1, long, "s"), (2, long, "s"), (1, long + "\nmore", "s")]
    got = Counter((r["doc_id"], r["text"] == long, r["n_removed"]) for r in lines.line_dedup(clashing(spark, rows)).collect())
    assert got[2, True, 3] == 1 and (got[1, True, 0], got[1, False, 3]) in ((2, 1), (0, 0)) or (got[1, True, 3], got[1, False, 0]) == (2, 1)


# URL lists.


def test_urls_against_each_entry(spark):
    entries = [("domain", "Bad.example.com.", "block", "2024-02-01"), ("domain", "bad.example.com", "remove", "2024-03-01"), ("domain", "bad.example.com", "block", "2024-03-01"), ("domain", "bad.example.com", "allow", "2024-05-01"),
               ("prefix", "bad.example.com//a//b/", "allow", "2024-01-15"), ("prefix", "bad.example.com/a", "block", "2024-01-10"), ("domain", "[::1]", "block", "2024-01-01"), ("domain", "com", "block", "2024-06-01"), ("domain", None, "block", "2024-01-01"), ("other", "x.org", "block", "2024-01-01")]
    hosts = ["bad.example.com", "www.bad.example.com", "notbad.example.com", "x.org", "[::1]:80", "u:p@BAD.example.com:8080", ""]
    paths = ["", "/", "/a", "/a/b", "/a//b/c", "/ab", "/a/b?q=/a", "#/a"]
    rows = [(f"http://{h}{p}", f"2024-{m:02d}-{d:02d}") for h in hosts for p in paths for m in (1, 2, 3, 5, 6) for d in (1, 12, 20)]
    rows += [(None, "2024-02-02"), ("", "2024-02-02"), ("nonsense", "2024-02-02"), (rows[0][0], None), rows[5], rows[5]]

    def judged(url, day):
        m = re.match(r"\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", (url or "").lower())
        host = m.group(1).strip(".") if m else ""
        if not host or day is None:
            return host, 0, None, "keep"
        path = [x for x in re.split(r"[?#]", re.sub(r"^[^:]*://[^/?#]*", "", url))[0].split("/") if x]
        active = {}
        for kind, pattern, action, start in entries:
            if kind not in ("domain", "prefix") or pattern is None or start > day:
                continue
            if kind == "domain":
                key = pattern.lower().strip("./")
                hit = host == key or host.endswith("." + key)
                key = "d:" + key
            else:
                h, _, rest = pattern.partition("/")
                parts = [x for x in rest.split("/") if x]
                hit, key = host == h.lower() and path[: len(parts)] == parts, "p:" + "/".join([h.lower(), *parts])
            if hit:
                rank = {"block": 0, "allow": 1, "remove": 2}[action]
                if key not in active or (start, -rank) > active[key][:2]:
                    active[key] = (start, -rank, action)
        live = {k: a for k, (_, _, a) in active.items() if a != "remove"}
        best = max(live, key=lambda k: (len(k), k), default=None)
        return host, len(live), best and best[2:], "drop" if best and live[best] == "block" else "keep"

    pages = spark.createDataFrame([(i, u, d, "mine", "mine") for i, (u, d) in enumerate(rows)], "page_id long, url string, fetched string, verdict string, x_url string")
    listed = spark.createDataFrame(entries, "kind string, pattern string, action string, day string").withColumn("day", F.col("day").cast("date"))
    got = urls.judge_urls(pages.drop("x_url"), listed).collect()
    assert len(got) == len(rows)
    for r in got:
        u, d = rows[r["page_id"]]
        assert (r["host"], r["n_active"], r["matched"], r["verdict"]) == judged(u, d), (u, d)
    assert urls.judge_urls(pages.drop("x_url"), listed.limit(0)).filter("verdict <> 'keep'").isEmpty()


# Licences.


def test_cosines_against_numpy(spark):
    fill = [PROSE, "some other words about software and permission to use it", "the license of this work is unknown to us", "nothing at all"]
    files = [(i, f"d/{i}.txt", f"{fill[i % 4]}\n# {licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1][: 40 + 9 * i]}\n{fill[(i + 1) % 4]}") for i in range(40)]
    docs = spark.createDataFrame(files, "doc_id long, path string, text string")
    terms = lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
    df = Counter(t for _, _, text in files for t in set(terms(text)))
    idf = lambda t: math.log((1 + len(files)) / (1 + df[t])) + 1
    vector = lambda ts: {t: n * idf(t) for t, n in Counter(ts).items()}
    cos = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    made = [(name, vector(terms(t)), len(terms(t))) for name, t in licenses.TEMPLATES]
    hits = 0
    for r in licenses.license_scan(docs).collect():
        all_ = terms(r["text"])
        scores = [(-round(cos(vector(terms(x)), w), 6), name) for x in r["text"].split("\n") if terms(x) for name, w, _ in made]
        scores += [(-round(cos(vector(all_[a : a + n]), w), 6), name) for name, w, n in made for a in range(max(1, len(all_) - n + 1))]
        best = min(scores)
        want = (best[1], -best[0]) if best[0] <= -0.8 else (None, None)
        hits += want[0] is not None
        assert (r["license"], r["similarity"]) == (want[0], pytest.approx(want[1], abs=2e-6) if want[1] else None)
    assert 8 < hits < 40


def test_licences_of_odd_files(spark):
    mit, gpl = licenses.TEMPLATES[0][1], licenses.TEMPLATES[6][1]
    rows = [(5, "r/x.txt", mit), (5, "r/x.txt", "nothing"), (5, "r/x.txt", mit), (None, "r/x.txt", gpl), (None, "r/x.txt", mit), (6, None, mit), (7, None, None), (8, "", ""), (9, "q/LICENSE", None), (10, "q/deep/er/file", PROSE * 4000),
            (11, "q/LICENSE.txt", gpl), (12, "q/COPYING", gpl), (13, "/root/a", "x"), (14, "q", "x"), (15, "LICENSE", mit)]
    docs = spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], "doc_id long, path string, text string, license string, how string, x_d string")
    got = Counter((r["doc_id"], r["path"], (r["text"] or "")[:9], r["license"], r["how"], r["license_dir"], r["x_d"]) for r in licenses.license_scan(docs).collect())
    of = lambda i, p, t, lic, how, at=None: (i, p, t[:9], lic, how, at, "mine")
    want = Counter([of(5, "r/x.txt", mit, "MIT", "own")] * 2 + [
        of(5, "r/x.txt", "nothing", "MIT", "inherited", ""), of(None, "r/x.txt", gpl, "GPL-3.0", "own"), of(None, "r/x.txt", mit, "MIT", "own"), of(6, None, mit, "MIT", "own"), of(7, None, "", "MIT", "inherited", ""), of(8, "", "", "MIT", "inherited", ""),
        of(9, "q/LICENSE", "", "GPL-3.0", "inherited", "q"), of(10, "q/deep/er/file", PROSE, "GPL-3.0", "inherited", "q"), of(11, "q/LICENSE.txt", gpl, "GPL-3.0", "own"), of(12, "q/COPYING", gpl, "GPL-3.0", "own"),
        of(13, "/root/a", "x", "MIT", "inherited", ""), of(14, "q", "x", "MIT", "inherited", ""), of(15, "LICENSE", mit, "MIT", "own")])
    assert got == want


# Pieces.


def test_ids_of_whole_texts_are_a_best_path(spark):
    own = pieces.Pieces.load(MODEL)
    found = {}
    for i, k in enumerate(own.kinds):
        if k in (pieces.NORMAL, pieces.USER_DEFINED):
            found.setdefault(own.pieces[i].replace("▁", " "), own.scores[i])
    texts = ["The end.", "a  b", "naïve 日本 x", "tab\tnew\nline", "x" * 40, "1234567890 + 0.5%"]
    for text in texts:
        t = (" " + text) if own.prefix else text
        best = [0.0] + [-math.inf] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - own.longest), e):
                piece = t[s:e]
                if piece in found:
                    best[e] = max(best[e], best[s] + found[piece])
            if t[e - 1 : e] not in found:
                best[e] = max(best[e], best[e - 1] + own.unknown_score)
        ids, total, run = own.encode(text), 0.0, 0
        for i in ids:  # the bytes of a character count once
            if own.kinds[i] == pieces.BYTE:
                run += 1
                raw = int(own.pieces[i][3:5], 16)
                total += own.unknown_score if raw < 0x80 or raw >= 0xC0 else 0.0
            else:
                total += own.scores[i]
        assert total == pytest.approx(best[-1]), text
        assert own.decode(ids) == text


def as_unigram(**changes):
    """The model file as one of the unigram kind, without the scores of -1e9 that single precision can't add to."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40_000.0)
    for name, value in changes.items():
        setattr(model.normalizer_spec, name, value)
    return model.SerializeToString()


def test_ids_equal_those_of_the_library(spark):
    spm = pytest.importorskip("sentencepiece")
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r[0]]
    texts += ["", " ", "a  b   c ", "naïve ＡＢＣ ﬁne ½ é", "x" * 500, "日本語 テキスト", "tab\tnew\nline\r\n", "\u200bzero\u00a0width"]
    plain = as_unigram()
    own, library = pieces.Pieces(plain), spm.SentencePieceProcessor(model_proto=plain)
    assert [own.encode(t) if t else [] for t in texts] == [library.encode(t) for t in texts]
    rules = spm.SentencePieceNormalizer(rule_name="nmt_nfkc")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    spec = pb.ModelProto()
    spec.ParseFromString(rules.serialized_model_proto())
    mapped = as_unigram(precompiled_charsmap=spec.normalizer_spec.precompiled_charsmap, remove_extra_whitespaces=True)
    own, library = pieces.Pieces(mapped), spm.SentencePieceProcessor(model_proto=mapped)
    assert [own.encode(t) if t else [] for t in texts] == [library.encode(t) for t in texts]
    assert own.decode(own.encode(" ＡＢＣ  ﬁne ")) == "ABC fine"


# The pipeline.


def small_corpus(spark, tmp_path, rows=None):
    src = "/root/testdata/sf0.001"
    d = str(tmp_path / "corpus")
    docs = spark.read.parquet(f"{src}/documents.parquet")
    (docs if rows is None else spark.createDataFrame(rows, docs.schema)).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{src}/labels.parquet").write.mode("overwrite").parquet(f"{d}/labels.parquet")
    return d


def test_pipeline_stage_by_stage(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    top = max(r["doc_id"] for r in base)
    extra = [(None, "a null id " + PROSE, None, None, None), (top + 1, None, "en", "s", 0), (top + 2, "", None, "s", 0), (top + 3, base[0]["text"], "en", None, 1), (top + 3, base[1]["text"], "en", None, 1), (top + 4, PROSE * 3000, "en", "s", 1)]
    d = small_corpus(spark, tmp_path, [tuple(r) for r in base] + extra)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, rows = docs.columns, {}
    before = docs
    for name, stage in cp.STAGES:
        out = common.stored(stage(spark, before, d), name)
        rows[name] = out.collect()
        if name != "encode":
            assert out.columns == columns
        before = out
    key = lambda r: (r["doc_id"], r["text"])
    model = gam.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    everything = [tuple(r)[:2] for r in base] + [e[:2] for e in extra]
    score = model.score(gam.features([t for _, t in everything]))
    assert Counter(map(key, rows["quality"])) == Counter(k for k, s in zip(everything, score, strict=True) if s >= cp.LEAST_QUALITY)
    most = {}
    for i, t in map(key, rows["quality"]):
        most[t or ""] = max((i is not None, i or 0), most.get(t or "", (False, 0)))
    assert Counter(map(key, rows["exact"])) == Counter((i if ok else None, t) for t, (ok, i) in most.items()) or len(rows["exact"]) == len(most)
    sets, root = components([key(r) for r in rows["exact"]], cp.NEAR_WORDS, cp.NEAR_LINK)
    groups = len({r for r, u in zip(root, sets, strict=True) if u}) + sum(not u for u in sets)
    assert len(rows["near"]) == groups and set(map(key, rows["near"])) <= set(map(key, rows["exact"]))
    copies = {(r["doc_id"], r["x_hash"]): r["copies"] for r in mixing.mix(spark.createDataFrame([tuple(r) for r in rows["near"]], docs.schema)).collect()}
    assert len(rows["mix"]) == sum(copies.values())
    own = pieces.Pieces.load(MODEL)
    assert Counter(map(key, rows["encode"])) == Counter(map(key, rows["mix"]))
    assert all(r["ids"] is None if r["text"] is None else own.decode(r["ids"]) == r["text"] and r["n_ids"] == len(r["ids"]) for r in rows["encode"])
    assert Counter(map(key, cp.run(spark, d).collect())) == Counter(map(key, rows["encode"]))


def test_pipeline_of_nothing(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    assert cp.run(spark, small_corpus(spark, tmp_path, [])).count() == 0


# Shared helpers.


def test_stored_tables_go_and_settings_stay(spark):
    before = spark.conf.get(common.CLEANUP, None)
    t = common.stored(spark.range(5), "t")
    assert t.count() == 5 and os.path.isdir(t.stored_at.replace("file:", "")) and spark.conf.get(common.CLEANUP, None) in (before, "false")
    common.discard(t)
    assert not os.path.isdir(t.stored_at.replace("file:", ""))


def test_draws_are_uniform():
    x = np.array([mixing._draw(3, i) for i in range(4000)])
    assert 0.48 < x.mean() < 0.52 and hashlib.sha256(x.tobytes()).hexdigest() == hashlib.sha256(np.array([mixing._draw(3, i) for i in range(4000)]).tobytes()).hexdigest()
