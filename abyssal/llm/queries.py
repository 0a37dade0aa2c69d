"""One query per operator over its whole table, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, collocations, decontaminate, disclosure, filter_audit, html_extract, langid, license_scan, ngram_lm, packing, simhash, substring, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(docs.select("doc_id", "text", path.alias("path")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(substring.repeated_spans(_table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"), order=3)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return chroma.search(rows.select(F.col("vec_id").alias("rec_id"), F.col("embedding").alias("media")), render=chroma.tones).withColumnRenamed("rec_id", "vec_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(_table(spark, sf_dir, "documents"))
    return token_files.read_tokens(spark, files, with_ids=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(disclosure.protected_spans(_table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_license_scan, op2_simhash_dedup, op3_substring_dedup, op4_decontaminate, op5_lm_score, op6_language_id, op7_packing, op8_html_extract, op9_chroma, op10_token_files, op11_filter_audit,
    op12_pii, op13_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}

_VALUES = ", ".join(f"({i}, '{name}', '{body.replace(chr(39), chr(39) * 2)}')" for i, (name, body) in enumerate(license_scan.TEMPLATES))
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_license_scan": rf"""
WITH files AS (SELECT doc_id, text, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path FROM documents),
template(template_id, license, body) AS (VALUES {_VALUES}),
tt AS (SELECT template_id, license, term, count(*) AS tf FROM (SELECT template_id, license, unnest(regexp_extract_all({_LOWER.format("body")}, '[a-z0-9]+')) AS term FROM template) GROUP BY ALL),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[a-z0-9]+') AS words FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM tt) GROUP BY term),
n AS (SELECT count(*) AS n FROM files),
idf AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), n),
w AS (SELECT template_id, license, term, tf * idf AS w, sum(tf * idf * tf * idf) OVER (PARTITION BY template_id) AS norm2 FROM tt JOIN idf USING (term)),
cut AS (SELECT doc_id, text, string_split_regex(text, '{license_scan.BLANK}') AS ps, string_split(text, chr(10)) AS ls FROM files),
pieces AS (SELECT doc_id, 0 AS kind, 0 AS block, text AS body FROM cut WHERE len(ps) > 1
  UNION ALL SELECT * FROM (SELECT doc_id, 1, generate_subscripts(ps, 1) - 1, unnest(ps) AS body FROM cut) WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 2, generate_subscripts(ls, 1) - 1, unnest(ls) FROM cut),
lw AS (SELECT doc_id, kind, block, regexp_extract_all({_LOWER.format("body")}, '[a-z0-9]+') AS words FROM pieces),
bt AS (SELECT doc_id, kind, block, len(words) AS block_words, term, count(*) AS btf FROM (SELECT doc_id, kind, block, words, unnest(words) AS term FROM lw) GROUP BY ALL),
bv AS (SELECT bt.*, btf * coalesce(idf, ln((n + 1)::DOUBLE) + 1) AS bw FROM bt LEFT JOIN idf USING (term), n),
bn AS (SELECT doc_id, kind, block, block_words, sum(bw * bw) AS bnorm2 FROM bv GROUP BY ALL),
dots AS (SELECT doc_id, kind, block, template_id, license, norm2, sum(bw * w) AS dot FROM bv JOIN w USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, kind, block, template_id, license, block_words, round(dot / sqrt(norm2 * bnorm2), 6) AS score FROM dots JOIN bn USING (doc_id, kind, block)),
best AS (SELECT s.*, block_words >= len(d.words) * {license_scan.FILE_SHARE} AS covers FROM scored s JOIN docs d USING (doc_id) WHERE score >= {license_scan.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY block_words >= len(d.words) * {license_scan.FILE_SHARE} DESC, score DESC, kind, block, template_id) = 1),
own AS (SELECT f.doc_id, f.path, regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS dir, b.license AS own_license, b.score, coalesce(b.covers, false) AS is_license_file FROM files f LEFT JOIN best b USING (doc_id)),
declared AS (SELECT dir AS ancestor, own_license AS dir_license FROM own WHERE is_license_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, doc_id) = 1),
nearest AS (SELECT o.dir, ancestor, dir_license FROM (SELECT DISTINCT dir FROM own) o JOIN declared ON ancestor = '' OR o.dir = ancestor OR starts_with(o.dir, ancestor || '/') QUALIFY row_number() OVER (PARTITION BY o.dir ORDER BY length(ancestor) DESC) = 1)
SELECT doc_id, path, own_license, score, is_license_file, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN ancestor END AS inherited_from FROM own LEFT JOIN nearest USING (dir)
""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM hit),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op4_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
hit AS (SELECT doc_id, p, k, item_id FROM win JOIN q USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM m GROUP BY ALL),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a JOIN f b ON b.b <> a.b JOIN f c ON c.b NOT IN (a.b, b.b) JOIN f d ON d.b NOT IN (a.b, b.b, c.b) JOIN f e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before + bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed, sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
  sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
""",
    "op13_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, phrase, k, string_split(phrase, ' ') AS words, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k))
  GROUP BY lang, phrase, k HAVING count(*) >= {collocations.LEAST}),
h AS (SELECT lang, phrase, f, j, array_to_string(words[1:j], ' ') AS head, array_to_string(words[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM g)),
c AS (SELECT h.lang, h.phrase, h.f AS a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * h.f) // (x.f::HUGEINT + y.f))::BIGINT AS score FROM h JOIN g x ON x.lang = h.lang AND x.phrase = head JOIN g y ON y.lang = h.lang AND y.phrase = tail),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, sub, max(f) AS longer FROM (SELECT lang, f, array_to_string(words[q:q + m - 1], ' ') AS sub FROM (SELECT *, unnest(range(1, k - m + 2)) AS q FROM g, (VALUES (2), (3)) s(m) WHERE k > m)) GROUP BY lang, sub),
o AS (SELECT b.lang, phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.sub = phrase WHERE longer IS NULL OR 100::HUGEINT * longer < {collocations.COVERED}::HUGEINT * a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN t USING (lang) WHERE rank <= {collocations.TOP}
""",
}
