"""The queries of the operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, divergence, gam, jaccard, licenses, lines, manifest, mixing, pieces, rules, sharding, simhash, urls

#: The vocabulary file; a parameter of the tokenizer query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Dated entries of the host list (fixed values of the query).
URL_ENTRIES = (
    ("domain", "casino-win.example.com", "block", "2024-01-15"),
    ("domain", "casino-win.example.com", "remove", "2024-09-01"),
    ("domain", "casino-win.example.com", "block", "2024-11-01"),
    ("domain", "cheap-pills.example.com", "block", "2024-03-01"),
    ("domain", "free-bets.example.com", "block", "2024-02-01"),
    ("prefix", "free-bets.example.com/en", "allow", "2024-06-01"),
    ("domain", "example.net", "block", "2024-05-01"),
    ("domain", "example.net", "allow", "2024-07-01"),
    ("domain", "example.net", "remove", "2024-08-01"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, and whether a document is held out of the training of its labels."""
    docs = table(spark, sf_dir, "documents")
    model = gam.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", gam.held_out(F.col("doc_id")).alias("held_out"), model.scores(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sizes, targets of their sources and the words taken."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of three-word shingles of all documents and their components at a similarity of 0.9."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no fetch time: page p counts as fetched on day p mod 366 of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))
    entries = spark.createDataFrame([*URL_ENTRIES], "kind string, pattern string, action string, day string").withColumn("day", F.col("day").cast("date"))
    return urls.judge_urls(pages, entries).select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "host", "n_active", "matched", "verdict")


OP4_SQL = r"""
WITH e AS (SELECT * FROM (VALUES """ + ", ".join(f"('{'p:' if k == 'prefix' else 'd:'}{p}', '{a}', DATE '{d}')" for k, p, a, d in URL_ENTRIES) + r""") t(key, action, day)),
i AS (SELECT key, action, day AS starts, lead(day) OVER (PARTITION BY key ORDER BY day) AS ends FROM e),
p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched,
             regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host,
             regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, count(*) AS n, arg_max(key, length(key)) AS key, arg_max(action, length(key)) AS action
      FROM p JOIN i ON fetched >= starts AND (ends IS NULL OR fetched < ends) AND action <> 'remove'
       AND CASE WHEN key[1] = 'd' THEN host = key[3:] OR ends_with(host, '.' || key[3:])
                ELSE host || path = key[3:] OR starts_with(host || path, key[3:] || '/') END GROUP BY page_id)
SELECT page_id, url, fetched::VARCHAR AS fetched, host, coalesce(n, 0) AS n_active, key[3:] AS matched,
       CASE WHEN action = 'block' THEN 'drop' ELSE 'keep' END AS verdict
FROM p LEFT JOIN m USING (page_id)
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents and the row that stays of each."""
    marked = dedup.mark_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the pieces of all documents, and whether decoding gives the text back."""
    out = pieces.tokenized(table(spark, sf_dir, "documents"), PIECES)
    back = pieces.decoded(F.col("ids"), pieces.shared(spark, PIECES))
    return out.select("doc_id", "n_ids", "ids", back.eqNullSafe(F.col("text")).alias("round_trip"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    out = sharding.histogram_shards(table(spark, sf_dir, "documents"), n_shards=40)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of passages of 50 words or more that occurred before."""
    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "clean_text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents and the verdicts of the rules."""
    out = rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no path: source, language and hundreds of ids are their directories, and a text of
    under 400 characters counts as its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("n_chars") < 400, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), name)
    return licenses.license_scan(docs.withColumn("path", path)).select("doc_id", "path", "license", "how", "similarity", "license_dir")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of a language, and the terms that each source has more of."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, row, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS row FROM d)),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM k GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v) AS p,
             1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (l.total + l.v) AS q
      FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) x
          ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at 4 differing bits."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the manifest of the table; those with an even crc32 of their id have lost their line ends."""
    lost = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest.verified(table(spark, sf_dir, "documents"), {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, lost)


def _tree_sql(name: str, leaves: str, levels: int) -> list[str]:
    """name{levels}: tops of trees of leaves (key, pos, n, node); name_p{levels}: for each leaf what stands beside it."""
    out = [f"{name}0 AS (SELECT key, pos, n, node FROM {leaves})", f"{name}_p0 AS (SELECT key, pos, pos AS at, []::STRUCT(l VARCHAR, r VARCHAR)[] AS path FROM {leaves})"]
    for k in range(levels):
        out.append(f"{name}_r{k} AS (SELECT key, pos // 3 AS pos, any_value(n) AS n, list(node ORDER BY pos) AS nodes FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT key, pos, (n + 2) // 3 AS n, sha256(array_to_string(nodes, '')) AS node FROM {name}_r{k} UNION ALL SELECT key, pos, n, node FROM {name}{k} WHERE n = 1)")
        step = "{'l': array_to_string(nodes[1:p.at % 3], ''), 'r': array_to_string(nodes[p.at % 3 + 2:], '')}"
        out.append(f"{name}_p{k + 1} AS (SELECT p.key, p.pos, p.at // 3 AS at, CASE WHEN nodes IS NULL THEN path ELSE list_append(path, {step}) END AS path FROM {name}_p{k} p LEFT JOIN {name}_r{k} r ON r.key = p.key AND r.pos = p.at // 3)")
    return out


def _op13_sql(levels: int = 12, outer: int = 6) -> str:
    of = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({of('doc_id')} || {of('source')} || {of('lang')} || {of('n_chars')} || {of(text)})"
    odd = "(crc32 & 1) = 1"
    fold = lambda k: f"SELECT * EXCLUDE (node), CASE WHEN len(path) > {k} THEN sha256(path[{k + 1}].l || node || path[{k + 1}].r) ELSE node END AS node FROM f{k}"
    # The CRC of a few digits, bit by bit.
    ctes = [
        "crc0 AS (SELECT doc_id, encode(doc_id::VARCHAR) AS b, 4294967295::BIGINT AS c, 0 AS i FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) UNION ALL "
        "SELECT doc_id, b, " + _crc_step() + ", i + 1 FROM crc0 WHERE i < octet_length(b))",
        "crc AS (SELECT doc_id, xor(c, 4294967295) AS crc32 FROM crc0 WHERE i = octet_length(b))",
        "docs AS (SELECT d.*, " + leaf("text") + " AS leaf, CASE WHEN " + odd.replace("= 1", "= 0") + " THEN " + leaf("replace(text, chr(10), '')") + " END AS other, coalesce('1' || source, '0') AS key FROM documents d LEFT JOIN crc USING (doc_id))",
        "leaves AS (SELECT key, doc_id, leaf AS node, coalesce(other, leaf) AS other, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM docs)",
        *_tree_sql("s", "leaves", levels),
        f"tops AS (SELECT '' AS key, key AS source, node, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM s{levels})",
        *_tree_sql("o", "tops", outer),
        f"f0 AS (SELECT l.doc_id, l.node AS leaf, t.node AS subroot, o.node AS root, list_concat(a.path, b.path) AS path, l.other AS node FROM leaves l JOIN s_p{levels} a USING (key, pos) JOIN tops t ON t.source = l.key JOIN o_p{outer} b ON b.pos = t.pos, o{outer} o)",
        *[f"f{k + 1} AS ({fold(k)})" for k in range(levels + outer)],
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{levels + outer}"
    )


def _crc_step() -> str:
    """One more byte of the CRC-32 with the polynomial EDB88320."""
    c = "xor(c, ascii(decode(b[i + 1:i + 1])))"
    for _ in range(8):
        c = f"list_transform([{c}], lambda v: xor(v >> 1, CASE WHEN (v & 1) = 1 THEN 3988292384 ELSE 0 END))[1]"
    return c


_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
_FAILS = " OR ".join(f"{name} {sign} {bound}" for name, sign, bound in rules.RULES)
OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN c USING (doc_id)),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio,
         n_stop_words / greatest(n_words, 1)::DOUBLE AS stop_ratio, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_FAILS}) AS kept, n_lines, n_stop_words
FROM v
"""


def queries() -> dict:
    return {
        "op1_quality_gam": op1_quality_gam,
        "op2_pivotal_mix": op2_pivotal_mix,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_temporal_url_filter": op4_temporal_url_filter,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_piece_codec": op6_piece_codec,
        "op7_sharding": op7_sharding,
        "op8_line_dedup": op8_line_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_license_scan": op10_license_scan,
        "op11_source_divergence": op11_source_divergence,
        "op12_simhash": op12_simhash,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_temporal_url_filter": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op9_quality_rules": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_merkle_manifest": _op13_sql()}
