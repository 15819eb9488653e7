"""The registered queries of the pipeline operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.conversation_repair import audit_conversations
from lexloom.llm.decontamination import decontaminate
from lexloom.llm.exact_dedup import exact_dedup
from lexloom.llm.language_id import identify_language
from lexloom.llm.mixing import mix_sources
from lexloom.llm.near_dedup import near_dedup
from lexloom.llm.pii import pii_report
from lexloom.llm.quality import score_quality
from lexloom.llm.substring_dedup import substring_dedup
from lexloom.llm.suffix_array_dedup import suffix_array_dedup
from lexloom.llm.toxicity import score_toxicity
from lexloom.llm.url_filter import url_filter
from lexloom.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), length=20).drop("kept_text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages")).drop("score")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(_table(spark, sf_dir, "documents"), length=100).drop("kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(_table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), k=16)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_quality": op7_quality,
    "op8_near_dedup": op8_near_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_pii": op11_pii,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_whitening": op13_whitening,
}

#: Words are `[^\x20\x09-\x0D]+` everywhere.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 19), ' ')) AS h FROM s),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
hit AS (SELECT DISTINCT doc_id, p + i AS p FROM later, range(0, 20) AS r(i)),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS m,
             CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS kept
      FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op6_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
s AS (SELECT doc_id, b, unnest(range(0, length(b) // 2 - 99)) AS p FROM d WHERE length(b) >= 200),
g AS (SELECT doc_id, p, md5(substr(b, 2 * p + 1, 200)) AS h FROM s),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
run AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r
        FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM later)),
span AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM span
        UNION ALL SELECT d.doc_id, coalesce(m, 0), length(b) // 2 FROM d LEFT JOIN (SELECT doc_id, max(hi) AS m FROM span GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(b, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS b FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, sum(hi - lo) AS gone FROM span GROUP BY doc_id)
SELECT d.doc_id, (length(d.b) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(from_hex(kept.b)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
         regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS digits FROM documents),
s AS (SELECT doc_id, lang, source, n_tokens,
             CASE WHEN digits = '' THEN 'other' ELSE ['web', 'books', 'code', 'talk'][(digits::INT % 4) + 1] END AS domain FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, 2 * sum(n_tokens)::BIGINT AS capacity FROM s GROUP BY ALL),
d0 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain),
d1 AS (SELECT *, least((SELECT floor(sum(supply) * 3 / 4)::BIGINT FROM leaf), (SELECT sum(capacity)::BIGINT FROM d0)) AS given FROM d0),
d2 AS (SELECT *, given - coalesce(sum(capacity) OVER o, 0) AS tokens, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight FROM d1
       WINDOW o AS (ORDER BY capacity::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d3 AS (SELECT *, capacity * weight <= tokens * w AS ok FROM d2),
d4 AS (SELECT domain, CASE WHEN ok THEN capacity ELSE ((given - sum(CASE WHEN ok THEN capacity ELSE 0 END) OVER ()) * w) // greatest(sum(CASE WHEN ok THEN 0 ELSE w END) OVER (), 1) END AS budget FROM d3),
l1 AS (SELECT domain, lang, sum(capacity)::BIGINT AS capacity, any_value(budget) AS given, CASE lang WHEN 'en' THEN 4 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END AS w
       FROM leaf JOIN d4 USING (domain) GROUP BY domain, lang),
l2 AS (SELECT *, given - coalesce(sum(capacity) OVER o, 0) AS tokens, sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER o, 0) AS weight FROM l1
       WINDOW o AS (PARTITION BY domain ORDER BY capacity::DOUBLE / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l3 AS (SELECT *, capacity * weight <= tokens * w AS ok FROM l2),
l4 AS (SELECT domain, lang, CASE WHEN ok THEN capacity ELSE ((given - sum(CASE WHEN ok THEN capacity ELSE 0 END) OVER (PARTITION BY domain)) * w) // greatest(sum(CASE WHEN ok THEN 0 ELSE w END) OVER (PARTITION BY domain), 1) END AS budget FROM l3),
s1 AS (SELECT domain, lang, source, supply, capacity, budget AS given, 1 AS w FROM leaf JOIN l4 USING (domain, lang)),
s2 AS (SELECT *, given - coalesce(sum(capacity) OVER o, 0) AS tokens, sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER o, 0) AS weight FROM s1
       WINDOW o AS (PARTITION BY domain, lang ORDER BY capacity::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, capacity * weight <= tokens * w AS ok FROM s2),
s4 AS (SELECT domain, lang, source, supply, CASE WHEN ok THEN capacity ELSE ((given - sum(CASE WHEN ok THEN capacity ELSE 0 END) OVER (PARTITION BY domain, lang)) * w) // greatest(sum(CASE WHEN ok THEN 0 ELSE w END) OVER (PARTITION BY domain, lang), 1) END AS budget FROM s3),
b AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS part FROM s4),
x AS (SELECT s.*, whole, part, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42|' || whole::BIGINT || '|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS run
      FROM s JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN run <= part AND part > 0 THEN 1 ELSE 0 END)::BIGINT AS epochs FROM x""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, sha256(n) AS text_sha256
FROM d WINDOW g AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)""",
    "op5_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path, translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM p),
rules(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
r AS (SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS v FROM u JOIN rules
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id),
j AS (SELECT u.*, rule, v, substr(md5(text), 1, 1) IN ('0', '1', '2') AS cal FROM u LEFT JOIN r USING (page_id)),
e AS (SELECT text, substr('^^^^' || text, i, 5) AS g FROM (SELECT DISTINCT text, unnest(range(1, length(text) + 1)) AS i FROM j)),
k AS (SELECT text, count(*) FILTER (v = 'allow' AND NOT cal) AS a, count(*) FILTER (v = 'block' AND NOT cal) AS r FROM j GROUP BY text),
c AS (SELECT g, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM e JOIN k USING (text) GROUP BY g),
c1 AS (SELECT right(g, 1) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1), c2 AS (SELECT right(g, 2) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1),
c3 AS (SELECT right(g, 3) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1), c4 AS (SELECT right(g, 4) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1),
m1 AS (SELECT g, (a + 4.0 * (1.0 / 256.0)) / (sum(a) OVER () + 4.0) AS pa, (r + 4.0 * (1.0 / 256.0)) / (sum(r) OVER () + 4.0) AS pr FROM c1),
m2 AS (SELECT x.g, (a + 4.0 * pa) / (sum(a) OVER q + 4.0) AS pa, (r + 4.0 * pr) / (sum(r) OVER q + 4.0) AS pr FROM c2 x JOIN m1 ON m1.g = right(x.g, 1) WINDOW q AS (PARTITION BY left(x.g, 1))),
m3 AS (SELECT x.g, (a + 4.0 * pa) / (sum(a) OVER q + 4.0) AS pa, (r + 4.0 * pr) / (sum(r) OVER q + 4.0) AS pr FROM c3 x JOIN m2 ON m2.g = right(x.g, 2) WINDOW q AS (PARTITION BY left(x.g, 2))),
m4 AS (SELECT x.g, (a + 4.0 * pa) / (sum(a) OVER q + 4.0) AS pa, (r + 4.0 * pr) / (sum(r) OVER q + 4.0) AS pr FROM c4 x JOIN m3 ON m3.g = right(x.g, 3) WINDOW q AS (PARTITION BY left(x.g, 3))),
m5 AS (SELECT x.g, (a + 4.0 * pa) / (sum(a) OVER q + 4.0) AS pa, (r + 4.0 * pr) / (sum(r) OVER q + 4.0) AS pr FROM c x JOIN m4 ON m4.g = right(x.g, 4) WINDOW q AS (PARTITION BY left(x.g, 4))),
sc AS (SELECT text, sum(ln(pa) - ln(pr)) / count(*) AS score FROM e JOIN m5 USING (g) GROUP BY text),
z AS (SELECT j.*, coalesce(score, 0.0) AS score FROM j LEFT JOIN sc USING (text)),
bins AS (SELECT floor(score * 100)::BIGINT AS b, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS r FROM z WHERE cal AND v IS NOT NULL GROUP BY 1),
gain AS (SELECT b, sum(a) OVER (ORDER BY b DESC) * sum(r) OVER () - sum(r) OVER (ORDER BY b DESC) * sum(a) OVER () AS gain, sum(a) OVER () AS ta, sum(r) OVER () AS tr, coalesce(lead(b) OVER (ORDER BY b DESC) + 1, b) AS low FROM bins),
t AS (SELECT coalesce((SELECT (b + low) / 200.0 FROM gain WHERE ta > 0 AND tr > 0 ORDER BY gain DESC, b DESC LIMIT 1), 0.0) AS t)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN score >= (SELECT t FROM t) THEN 'allow' ELSE 'block' END) AS verdict FROM z""",
    "op8_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id LEFT JOIN n USING (doc_id)""",
    "op12_conversation_repair": r"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT k, xor(list_reduce(flatten(list_transform(string_split(k, ''), lambda ch: list_transform(range(8), lambda i: (ascii(ch)::BIGINT >> i::INT) & 1))),
               lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM (SELECT DISTINCT k FROM d)),
h AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d JOIN crc USING (k)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS said
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM h)),
f AS (SELECT *, left(role, 1) AS first, CASE WHEN t = '' THEN 'blank' WHEN said > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) NOT IN ('su', 'ua', 'au') AS bad FROM n),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
g AS (SELECT conv_id, i, first, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM f),
dp(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {'c': 0, 'e': ''}, {'c': 1000000000, 'e': ''}, {'c': 3, 'e': 'I'}, {'c': 6, 'e': 'II'} FROM c
  UNION ALL
  SELECT conv_id, i, z, s, u2, least(a, {'c': u2.c + 3, 'e': u2.e || 'I'}) FROM (
    SELECT *, least(u, {'c': least(z, s, a).c + 3, 'e': least(z, s, a).e || 'I'}) AS u2 FROM (
      SELECT p.conv_id, g.i, {'c': z.c + 4, 'e': z.e || 'D'} AS z,
             least({'c': s.c + 4, 'e': s.e || 'D'}, CASE WHEN ok AND first = 's' THEN {'c': z.c + cut, 'e': z.e || 'K'} END) AS s,
             least({'c': u.c + 4, 'e': u.e || 'D'}, CASE WHEN ok AND first = 'u' THEN {'c': least(z, s, a).c + cut, 'e': least(z, s, a).e || 'K'} END, CASE WHEN ok THEN {'c': least(z, s, a).c + cut + 3, 'e': least(z, s, a).e || 'R'} END) AS u,
             least({'c': a.c + 4, 'e': a.e || 'D'}, CASE WHEN ok AND first = 'a' THEN {'c': u.c + cut, 'e': u.e || 'K'} END, CASE WHEN ok THEN {'c': u.c + cut + 3, 'e': u.e || 'R'} END) AS a
      FROM dp p JOIN g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = p.i + 1))),
b AS (SELECT c.conv_id, least(z, a) AS e FROM c JOIN dp ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = c.n),
step AS (SELECT conv_id, p, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM (SELECT conv_id, p, substr(e.e, p, 1) AS edit FROM (SELECT conv_id, e, unnest(range(1, length(e.e) + 1)) AS p FROM b))),
kept AS (SELECT step.conv_id, p, edit, role, text, first, row_number() OVER (PARTITION BY step.conv_id ORDER BY p) AS o,
                max(CASE WHEN edit = 'K' AND first = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY step.conv_id) AS sys
         FROM step LEFT JOIN f ON step.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = step.i AND edit <> 'I' WHERE edit <> 'D'),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.e.c, 0)::BIGINT AS cost, coalesce(b.e.e, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
      FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT doc_id, item_id, i, n FROM x JOIN g USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, range(0, 10) AS r(k) WHERE k < n GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
