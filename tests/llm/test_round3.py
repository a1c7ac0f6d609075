"""Divergence of sources, SimHash components and the Merkle manifest against plain computations."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from copse.llm import divergence, manifest, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
PROSE = "the quick brown fox jumps over the lazy dog and runs to the far end of a wide green field with no one in it"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = DOCS + ", key string, pos long, id string, `rank` long, print long, `a``b` string, component_id long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def odd(spark):
    words = PROSE.split()
    texts = [None, "", " \n\t ", "one", PROSE, PROSE, "a" * 200_000, " ".join(words * 300), PROSE + " more", "é ▁ 日本 😀\r\n\x00Z", "\n".join([PROSE] * 3), "One\nTwo", None]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None if i % 5 else 7, "k", 1, "x", 2, 3, "y", 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[10], (None, PROSE + "\n", None, None, *[None] * 8), (4, "another text of the same id", None, "s1", *[None] * 8), (4, None, None, "S1", *[None] * 8), (3, "x", "", "", *[None] * 8)]
    return spark.createDataFrame(rows, CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)


def in_duckdb(sql, df):
    con = duckdb.connect()
    con.register("documents", df.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")).toArrow())
    return con.execute(sql).fetchall()


# Divergence.


def divergences(rows, least=3, ranks=200):
    docs = [((lang or "", source or ""), Counter(TERM.findall(lower(text or "")))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {g[0] for g, _ in docs}:
        own = [(g, c) for g, c in docs if g[0] == lang]
        seen = Counter(t for _, c in own for t in c)
        kept = [t for t, n in seen.items() if n >= least]
        count = {s: Counter() for s in {g[1] for g, _ in own}}
        for (_, s), c in own:
            count[s].update({t: n for t, n in c.items() if seen[t] >= least})
        all_ = sum(count.values(), Counter())
        share = lambda c, t: 1 + (10**9 * (c[t] + 1)) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in count.items():
            pairs = [(sum(f(share(c, t), share(o, t)) for t in kept), other) for other, o in count.items() if other != s]
            terms = [(f(share(c, t), share(all_, t)), t) for t in kept if c[t] and share(c, t) > share(all_, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= ranks]
    return sorted(out)


@pytest.mark.parametrize("ranks", [200, 3])
def test_divergence_against_plain_counts(spark, ranks):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Élan", "日本", "A1b"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 30), p=(p := 1 / (np.arange(63) + 1.5)) / p.sum())), ["en", "de", None][i % 3], [f"s{i % 7}", None][i % 11 == 0], None) for i in range(120)]
    rows += [(500, "lone words here", "xx", "alone", None), (501, None, "yy", "a", None), (502, "", "yy", "b", None)]
    got = divergence.divergence(spark.createDataFrame(rows, DOCS), ranks=ranks).collect()
    assert sorted(map(tuple, got)) == divergences(rows, ranks=ranks)


def test_divergence_of_odd_rows(spark):
    rows = odd(spark)
    assert sorted(map(tuple, divergence.divergence(rows).collect())) == divergences(rows.collect())
    assert sorted(map(tuple, divergence.divergence(rows).collect())) == sorted(in_duckdb(queries.OP11_SQL, rows))
    assert divergence.divergence(empty(spark)).count() == 0


def test_counts_pass_on_when_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "AT_HAND", 2)
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "a"], "source": ["s", "s"], "text": [b"x y x", b"x z"]})
    total = Counter()
    for b in divergence._counts([batch]):
        for r in b.to_pylist():
            total[r["term"]] += r["n"]
            total[r["term"], "docs"] += r["docs"]
    assert total == {"x": 3, ("x", "docs"): 2, "y": 1, ("y", "docs"): 1, "z": 1, ("z", "docs"): 1}


# SimHash.


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, differ):
    """Of each place the least place that links reach."""
    x = np.array(prints, np.uint64)
    label = np.arange(len(x))
    near = [np.flatnonzero(np.bitwise_count(x ^ v) <= differ) for v in x]
    for i in range(len(x)):
        for j in near[i]:
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    return label


def test_fingerprints(spark):
    for text in ("", "one", "one two three", PROSE, PROSE.upper(), "É É É É É", " \x0b\x1f a", PROSE * 40):
        assert simhash.fingerprint(text.encode()) == fingerprint(text)
    native = spark.range(1).select(F.xxhash64(F.lit("é of a wide"))).first()[0] % 2**64
    assert native == xxhash.xxh64_intdigest("é of a wide".encode(), seed=42)


def test_gray_order(spark):
    x = [0, 1, 2, 3, 1 << 63, (1 << 64) - 1, 0x0F0F0F0F0F0F0F0F]
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    got = {r[0] % 2**64: (r[1] + (1 << 63)) for r in spark.createDataFrame([(v,) for v in signed], "p long").select("p", simhash.gray_rank(F.col("p"))).collect()}
    assert {v: got[v] ^ (got[v] >> 1) for v in x} == {v: v for v in x}


def clustered(rng, n, spread):
    """Prints of which many differ in a few bits, and some are random."""
    centres = rng.integers(0, 2**64, 20, np.uint64)
    out = centres[rng.integers(0, 20, n)]
    for _ in range(spread):
        out = np.where(rng.random(n) < 0.7, out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), out)
    return np.unique(np.concatenate([out, rng.integers(0, 2**64, n, np.uint64), np.zeros(1, np.uint64)]))


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(7)
    x = clustered(rng, 700, 4)
    rank = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    x = x[np.argsort(rank)]
    levels = simhash.index(x)
    assert len(levels[0][0]) == 1 and len(levels) == 4
    low, high = np.full(len(x), 10), np.full(len(x), len(x) - 3)
    i, j = simhash.search(levels, x, low, high, 4)
    want = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    want[:, :10] = False
    want[:, -3:] = False
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*np.nonzero(want), strict=True))
    # Upper nodes hold bits that all rows below share, and a child none of those again.
    for (own, bits, _), (below, _, _) in zip(levels, levels[1:], strict=False):
        assert not (np.repeat(own, simhash.FAN)[: len(below)] & below).any() and not (bits & ~own).any()


@pytest.mark.parametrize("block", [4096, 37])
def test_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    x = clustered(np.random.default_rng(8), 600, 5)
    links = simhash.near_links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "print long")).collect()
    place = {int(v): i for i, v in enumerate(x.view(np.int64))}
    pairs = np.array([(place[r["a"]], place[r["b"]]) for r in links])
    label = simhash.merged(np.arange(len(x)), pairs[:, 0], pairs[:, 1])
    assert (label == components_of(x, 4)).all()


def test_simhash_of_odd_rows(spark):
    df = odd(spark)
    rows = [r for r in df.collect()]
    prints = [fingerprint(r["text"]) for r in rows]
    label = components_of(prints, 4)
    least = {c: min((r["doc_id"] for r, x in zip(rows, label, strict=True) if x == c and r["doc_id"] is not None), default=None) for c in set(label)}
    want = sorted((str(r["doc_id"]), f"{p:016x}", str(least[c])) for r, p, c in zip(rows, prints, label, strict=True))
    got = simhash.simhash_components(df)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == want
    assert simhash.simhash_components(empty(spark)).count() == 0
    only = spark.createDataFrame([(None, "a b c d e", None, None, None)], DOCS)
    assert simhash.simhash_components(only).first()["component_id"] is None


# Manifest.


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    of = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(of, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes, fan):
    """The root, and for each node the steps (left, right) up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = nodes[at[i] // fan * fan : at[i] // fan * fan + fan]
            p.append(("".join(run[: at[i] % fan]), "".join(run[at[i] % fan + 1 :])))
        at = [a // fan for a in at]
        nodes = [sha(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def manifests(rows, fan=3):
    by = {}
    for r in rows:
        by.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    leaves = {k: sorted(v, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]))) for k, v in by.items()}
    keys = sorted(leaves)
    trees = {k: tree([leaf_of(r, r["text"]) for r in leaves[k]], fan) for k in keys}
    root, outer = tree([trees[k][0] for k in keys], fan)
    out = []
    for i, k in enumerate(keys):
        for r, path in zip(leaves[k], trees[k][1], strict=True):
            text, path = r["text"], path + outer[i]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf_of(r, text)
            for left, right in path:
                node = sha(left, node, right)
            out.append((r["doc_id"], leaf_of(r, r["text"]), trees[k][0], root, sha(*[x for s in path for x in s]), node, node == root))
    return sorted(out, key=str)


def checked(df, **how):
    return manifest.verified(df, {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, **how)


@pytest.mark.parametrize(("fan", "deep"), [(3, 6), (3, 1), (2, 2)])
def test_manifest_against_plain_trees(spark, fan, deep):
    rows = [(i * 7 % 1000, f"text {i}\nof two lines" if i % 3 else None, "en", f"s{i % 3}" if i % 5 else ["é", None, "z"][i % 3], i) for i in range(130)] + [(2000, "alone", None, "one", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, checked(df, fan=fan, deep=deep).collect()), key=str)
    assert got == manifests(df.collect(), fan)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    df = odd(spark)
    got = sorted(map(tuple, checked(df).collect()), key=str)
    assert got == manifests(df.collect()) == sorted(in_duckdb(queries._op13_sql(), df), key=str)
    assert checked(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "x", None, None, None)], DOCS)
    assert [tuple(r) for r in checked(one).collect()] == manifests(one.collect())
