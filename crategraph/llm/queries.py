"""The queries of the subpackage, each an operator applied to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crategraph.llm import alignment, decontaminate, language_model, mixing, near_dedup, personal_data, quality_classifier, quality_rules, resampling, sharding, toxicity, url_filter, warc
from crategraph.shared import table

#: Score from which a document is toxic.
TOXIC = 0.3
#: (host, path, verdict) of the url rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: Bytes of text in a shard.
SHARD_BYTES = 32 << 20


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_extendible_hashing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, limit=SHARD_BYTES).drop("text")


def op4_bag_min_hash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.realise(docs, mixing.plan(docs, repetition_limit=4.0))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.fit(docs))


def op10_nearest_example_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=TOXIC)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_bootstrapped_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.extract(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_spaced_seed_decontamination, op2_host_quality_rules, op3_extendible_hashing_shards, op4_bag_min_hash_classes, op5_temperature_mixing, op6_warc_round_trip, op7_random_indexing_quality, op8_bloom_cascade_urls, op9_brown_class_scores, op10_nearest_example_toxicity, op11_cross_tokenizer_alignment, op12_bootstrapped_personal_data, op13_importance_resampling)}


def shard_sql(limit: int) -> str:
    """SQL of ``sharding.shard`` for tables in which no 60 bits are shared by rows that exceed the limit."""
    return f"""
WITH h AS (
  SELECT row_number() OVER () AS rid, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
e AS (SELECT rid, d, h >> (60 - d) AS p, n_bytes FROM h, range(0, 61) AS r(d)),
s AS (SELECT d, p, sum(n_bytes)::BIGINT AS b FROM e GROUP BY d, p HAVING sum(n_bytes) <= {limit} OR count(*) = 1 OR d = 60),
leaf AS (SELECT rid, min(d) AS depth, arg_min(p, d) AS p, arg_min(b, d) AS b FROM e JOIN s USING (d, p) GROUP BY rid)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(ltrim(bin(p), '0'), depth::INT, '0') END AS shard, depth::INT AS depth, b AS shard_bytes, n_bytes
FROM h JOIN leaf USING (rid)
"""


def personal_data_sql(support: int = personal_data.SUPPORT, confidence: float = personal_data.CONFIDENCE, rounds: int = personal_data.ROUNDS) -> str:
    """SQL of ``personal_data.extract`` with its rounds written out."""
    email, domain = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+", r"(?:\.[A-Za-z0-9-]+)"
    plain = {"email": email + domain + "+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    some = "|".join([email + domain + "*", plain["phone"], plain["ip"], r"[0-9](?:[\x20-]?[0-9]){4,}", "(?:[A-Za-z_.-]*[0-9]){5}[A-Za-z0-9_.-]*"])
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum([CASE WHEN k % 2 = 1 THEN v ELSE 2 * v - CASE WHEN v > 4 THEN 9 ELSE 0 END END FOR v, k IN [x::INT FOR x IN string_split(reverse({digits}), '')]]) % 10 = 0"
    good = {
        "email": "true",
        "ip": "len([x FOR x IN string_split(m, '.') IF coalesce(TRY_CAST(x AS HUGEINT), 256) > 255]) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    made = " UNION ALL ".join(f"SELECT rid, '{k}' AS kind, regexp_extract_all(t, '{p}') AS f, string_split_regex(t, '{p}') AS s FROM d" for k, p in [*plain.items(), ("", some)])
    steps = "".join(
        f"""
e{r} AS (SELECT pattern, kind, sum(score) AS mass FROM edge JOIN i{r - 1} USING (value) GROUP BY ALL HAVING count(DISTINCT value) >= {support}),
a{r} AS (SELECT pattern, kind, round(mass / (n + 1), 9) AS confidence FROM e{r} JOIN n USING (pattern) WHERE round(mass / (n + 1), 9) >= {confidence}),
s{r} AS (SELECT rid, "start", value, kind, max(confidence) AS c FROM edge JOIN a{r} USING (pattern) WHERE value IN (FROM unknown) AND seed IS NULL GROUP BY ALL),
i{r} AS (SELECT * FROM i0 UNION ALL SELECT value, kind, round(sum(c) / any_value(n), 9) AS score FROM s{r} JOIN total USING (value) GROUP BY ALL HAVING round(sum(c) / any_value(n), 9) >= {confidence}),"""
        for r in range(1, rounds + 1)
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({made}),
y AS (SELECT rid, kind, f, s, unnest(range(1, len(f) + 1)) AS i FROM x),
z AS (SELECT rid, kind, f[i] AS m, length(s[i]) AS n, right(s[i], {personal_data.TAIL}) AS tail, sum(length(s[i]) + length(f[i])) OVER (PARTITION BY rid, kind ORDER BY i)::BIGINT AS "end" FROM y),
z2 AS (SELECT *, "end" - length(m) AS "start", {' '.join(f"{'CASE' if k == 'email' else ''} WHEN kind = '{k}' THEN {g}" for k, g in good.items())} END AS good,
  {' '.join(f"{'CASE' if k == 'email' else ''} WHEN regexp_full_match(m, '{plain[k]}') AND {g} THEN '{k}'" for k, g in good.items())} END AS seed,
  regexp_replace(tail, '["''(\[<{{]+$', '') AS bare FROM z),
base AS (SELECT rid, kind, "start", "end" FROM z2 WHERE kind <> '' AND good),
c0 AS (SELECT *, regexp_extract_all(lower(bare), '\n|[^\x20\x09-\x0D:=]*[:=]|[^\x20\x09-\x0D:=]+')[CASE WHEN n > {personal_data.TAIL} THEN 2 ELSE 1 END:] AS w FROM z2 WHERE kind = ''),
c AS (
  SELECT rid, "start", "end", seed, lower(regexp_replace(m, CASE WHEN contains(m, '@') THEN '[^A-Za-z0-9@.]' ELSE '[^A-Za-z0-9]' END, '', 'g')) AS value,
         CASE WHEN regexp_matches(bare, '[\x20\x09-\x0D:=]$') AND w[-1] <> chr(10) THEN w[-1] END AS one, CASE WHEN len(w) > 1 AND w[-2] <> chr(10) THEN w[-2] END AS two
  FROM c0),
edge AS (SELECT rid, "start", value, seed, one AS pattern FROM c WHERE one IS NOT NULL UNION ALL SELECT rid, "start", value, seed, two || ' ' || one FROM c WHERE one IS NOT NULL AND two IS NOT NULL),
i0 AS (SELECT DISTINCT value, seed AS kind, 1.0::DOUBLE AS score FROM c WHERE seed IS NOT NULL),
unknown AS (SELECT DISTINCT value FROM c WHERE value NOT IN (SELECT value FROM i0)),
total AS (SELECT value, count(*) AS n FROM c WHERE value IN (FROM unknown) GROUP BY value),
w AS (SELECT regexp_extract_all(lower(t), '\n|[^\x20\x09-\x0D:=]*[:=]|[^\x20\x09-\x0D:=]+') AS w FROM d),
o AS (SELECT w[i] AS one, CASE WHEN i > 1 THEN w[i - 1] END AS two FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w)),
n AS (SELECT pattern, count(*) AS n FROM (SELECT one AS pattern FROM o UNION ALL SELECT two || ' ' || one FROM o) WHERE pattern IN (SELECT pattern FROM edge) GROUP BY pattern),{steps}
found AS (
  SELECT rid, coalesce(v.kind, h.kind) AS kind, "start", "end"
  FROM c LEFT JOIN (SELECT value, arg_min(kind, {{s: -score, k: list_position(['email', 'ip', 'card', 'phone'], kind)}}) AS kind FROM i{rounds} GROUP BY value) v USING (value)
  LEFT JOIN (SELECT rid, "start", arg_min(kind, {{s: -c, k: list_position(['email', 'ip', 'card', 'phone'], kind)}}) AS kind FROM s{rounds} GROUP BY ALL) h USING (rid, "start")
  WHERE seed IS NULL AND coalesce(v.kind, h.kind) IS NOT NULL),
span AS (SELECT *, true AS own FROM base UNION ALL SELECT *, false FROM found f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = f.rid AND b."start" < f."end" AND b."end" > f."start")),
g AS (
  SELECT rid, count(*) FILTER (own AND kind = 'email') AS e, count(*) FILTER (own AND kind = 'ip') AS i, count(*) FILTER (own AND kind = 'card') AS c, count(*) FILTER (own AND kind = 'phone') AS p, count(*) FILTER (NOT own) AS found,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), "start") FILTER (own) AS b,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), "start") AS a
  FROM span GROUP BY rid)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(found, 0) AS n_found
FROM d LEFT JOIN g USING (rid)
"""


ORACLE_SQL = {
    "op2_host_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
starts AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
cover AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM starts) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, host, len(w)::BIGINT AS n_words, len(l)::BIGINT AS n_lines,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cover USING (rid)),
f AS (
  SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, n_symbols > 0.1::DOUBLE * n_words AS f3,
         n_dup_lines > 0.3::DOUBLE * n_lines AS f4,
         n_words > 0 AND (word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15) AS f5
  FROM m),
long AS (SELECT rid, host, r.k AS k, r.v AS v FROM f, LATERAL (SELECT unnest([{k: 'short', v: f1}, {k: 'repeats', v: f2}, {k: 'symbols', v: f3}, {k: 'duplicate_lines', v: f4}, {k: 'word_length', v: f5}]) AS r)),
h AS (SELECT host, k, count(*) AS n, sum(v::INT) AS x FROM long WHERE host IS NOT NULL GROUP BY host, k),
p0 AS (SELECT k, (sum(x) + 0.5::DOUBLE) / (sum(n) + 1) AS mean, var_pop(x / n) AS v, avg(1.0::DOUBLE / n) AS inv FROM h GROUP BY k),
p AS (SELECT k, mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-9) - 1, 1), 1e4) AS s FROM p0),
rates AS (SELECT host, k, (x + mean * s) / (n + s) AS rate FROM h JOIN p USING (k)),
each AS (
  SELECT long.rid, long.k, long.v, long.host, coalesce(rate, mean) AS rate
  FROM long JOIN p USING (k) LEFT JOIN rates ON rates.host = long.host AND rates.k = long.k),
v AS (
  SELECT rid, CASE WHEN max(rate) >= 0.5 AND max(host) IS NOT NULL THEN 'blocked' WHEN bool_or(v AND rate >= 0.005) THEN 'rule' ELSE 'fine' END AS host_verdict,
         max(CASE WHEN k = 'short' THEN rate END) AS r1, max(CASE WHEN k = 'repeats' THEN rate END) AS r2, max(CASE WHEN k = 'symbols' THEN rate END) AS r3,
         max(CASE WHEN k = 'duplicate_lines' THEN rate END) AS r4, max(CASE WHEN k = 'word_length' THEN rate END) AS r5
  FROM each GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND host_verdict = 'fine' AS kept, host_verdict, round(r1, 6) AS rate_short, round(r2, 6) AS rate_repeats,
       round(r3, 6) AS rate_symbols, round(r4, 6) AS rate_duplicate_lines, round(r5, 6) AS rate_word_length
FROM f JOIN v USING (rid)
""",
    "op3_extendible_hashing_shards": shard_sql(SHARD_BYTES),
    "op6_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY d)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.first IS NOT NULL AND coalesce(page_id > g.first, true) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first IS NOT NULL AND coalesce(page_id > g.first, true) THEN g.first END AS refers_to
FROM p LEFT JOIN g USING (d)
""",
    "op8_bloom_cascade_urls": r"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hit AS (
  SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hit USING (rid)
""",
    "op12_bootstrapped_personal_data": personal_data_sql(),
    "op13_importance_resampling": r"""
WITH step AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce([i] || [0 FOR k IN range(8)], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)::BIGINT AS c FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT rid, unnest(w) AS w FROM d),
known AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT FOR k IN range(strlen(w))], lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS h
  FROM (SELECT w FROM f UNION SELECT w FROM b), step),
s AS (SELECT h, count(*) AS n FROM f JOIN known USING (w) GROUP BY h),
t AS (SELECT h, count(*) AS n FROM b JOIN known USING (w) GROUP BY h),
total AS (SELECT (SELECT count(*) FROM f) + 10000 AS s, (SELECT count(*) FROM b) + 10000 AS t),
gain AS (SELECT s.h, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * total.s::DOUBLE / ((s.n + 1)::DOUBLE * total.t::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (h), total),
w AS (SELECT rid, sum(g)::BIGINT AS weight FROM f JOIN known USING (w) JOIN gain USING (h) GROUP BY rid),
x AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (rid)
""",
}
