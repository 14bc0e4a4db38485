"""Registered queries of the training-data operators, with DuckDB texts where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from labelspark.llm import (
    byte_bpe, decontamination, exact_dedup, fill_in_middle, html_extraction, language_id, mixing, ngram_join, secret_scan, substring_dedup,
    suffix_dedup, url_filter, vector_codes,
)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def captures(spark, sf_dir):
    """Pages with a fetch time made from their id."""
    day = F.timestamp_add("DAY", (F.col("page_id") * 7919 % 730).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_add("HOUR", (F.col("page_id") % 24).cast("int"), day).alias("fetched_at"))


def list_entries(spark, sf_dir):
    """Dated entries about the hosts of the pages: some blocked twice, some domains for a while, one
    section allowed."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    hosts = _table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.min("page_id").alias("m")).filter("host <> ''")
    domain = F.substring_index("host", ".", -3)
    plan = [
        ("block", "host", F.col("host"), "add", 31, 600, 0, "m % 3 = 0"), ("block", "host", F.col("host"), "remove", 31, 600, 90, "m % 3 = 0"),
        ("block", "host", F.col("host"), "add", 31, 600, 200, "m % 3 = 0"), ("allow", "prefix", F.concat("host", F.lit("/en")), "add", 17, 600, 0, "m % 2 = 0"),
        ("block", "domain", domain, "add", 13, 700, 0, "m % 5 = 1"), ("block", "domain", domain, "remove", 13, 700, 60, "m % 5 = 1"),
        ("watch", "host", F.col("host"), "add", 11, 500, 0, "m % 4 < 3"),
    ]
    events = [
        F.when(F.expr(keep), F.struct(
            F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"),
            F.timestamp_add("DAY", (F.col("m") * factor % span + later).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("at"),
        ))
        for name, kind, pattern, action, factor, span, later, keep in plan
    ]
    return hosts.select(F.explode(F.array_compact(F.array(*events))).alias("e")).select("e.*")


def op4_url_filter(spark, sf_dir):
    found = url_filter.url_filter(captures(spark, sf_dir), list_entries(spark, sf_dir))
    return found.select(
        "page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "n_active",
        F.array_join("lists", ",").alias("lists"), F.date_format("first_since", "yyyy-MM-dd").alias("first_since"), "blocked",
    )


def op5_decontamination(spark, sf_dir):
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _removed():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed")


def op6_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_bytes", _removed(), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_secret_scan(spark, sf_dir):
    rows = secret_scan.secret_scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )


def op8_html_extraction(spark, sf_dir):
    rows = html_extraction.extract_pages(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_source_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark, sf_dir):
    rows = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", _removed(), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark, sf_dir):
    rows = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fill_in_middle.restore()).alias("restored_sha256"),
    )


def op12_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks)
    return rows.select(
        "doc_id", "n_tokens", F.sha2("shard", 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decode("ids", ranks), 256).alias("decoded_sha256"),
    )


def op13_vector_codes(spark, sf_dir):
    rows, codebooks = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.fingerprint(codebooks)).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_language_id, op3_exact_dedup, op4_url_filter, op5_decontamination, op6_suffix_dedup, op7_secret_scan,
        op8_html_extraction, op9_source_mixing, op10_substring_dedup, op11_fill_in_middle, op12_byte_bpe,
        op13_vector_codes,
    )
}

_EVENTS = """
hosts AS (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, min(page_id) AS m FROM pages GROUP BY 1),
named AS (SELECT host, m, array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:3]), '.') AS domain FROM hosts WHERE host <> ''),
events AS (
  SELECT 'block' AS list, 'host' AS kind, host AS pattern, false AS removed, DATE '2024-01-01' + (m * 31 % 600)::INT AS d FROM named WHERE m % 3 = 0
  UNION ALL SELECT 'block', 'host', host, true, DATE '2024-01-01' + (m * 31 % 600 + 90)::INT FROM named WHERE m % 3 = 0
  UNION ALL SELECT 'block', 'host', host, false, DATE '2024-01-01' + (m * 31 % 600 + 200)::INT FROM named WHERE m % 3 = 0
  UNION ALL SELECT 'allow', 'prefix', host || '/en', false, DATE '2024-01-01' + (m * 17 % 600)::INT FROM named WHERE m % 2 = 0
  UNION ALL SELECT 'block', 'domain', domain, false, DATE '2024-01-01' + (m * 13 % 700)::INT FROM named WHERE m % 5 = 1
  UNION ALL SELECT 'block', 'domain', domain, true, DATE '2024-01-01' + (m * 13 % 700 + 60)::INT FROM named WHERE m % 5 = 1
  UNION ALL SELECT 'watch', 'host', host, false, DATE '2024-01-01' + (m * 11 % 500)::INT FROM named WHERE m % 4 < 3),
one AS (SELECT list, kind, pattern, d, bool_or(removed) AS removed FROM events GROUP BY ALL),
spans AS (SELECT *, lead(d) OVER (PARTITION BY list, kind, pattern ORDER BY d) AS until FROM one),
caps AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id * 7919 % 730)::INT) + to_hours((page_id % 24)::INT) AS t,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS steps
  FROM pages),
hits AS (
  SELECT DISTINCT c.page_id, c.url, c.t, s.list, s.kind, s.pattern, s.d
  FROM caps c JOIN spans s ON NOT s.removed AND s.d <= c.t AND (s.until IS NULL OR c.t < s.until) AND c.host <> '' AND CASE s.kind
    WHEN 'host' THEN s.pattern = c.host
    WHEN 'domain' THEN s.pattern = c.host OR (s.pattern LIKE '%.%' AND ends_with(c.host, '.' || s.pattern))
    ELSE list_contains(list_transform(range(0, len(c.steps) + 1), lambda i: c.host || '/' || array_to_string(c.steps[1:i], '/')), s.pattern) END),
lists AS (
  SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, min(d) AS first,
    bool_or(list = 'block') AND NOT bool_or(list = 'allow') AS blocked FROM hits GROUP BY 1)
"""

_WORDS = "SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents"

ORACLE = {
    "op1_ngram_join": f"""
WITH RECURSIVE words AS ({_WORDS}),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c * 10 >= 8 * (x.n + y.n - c)
  UNION SELECT p.doc_id, q.doc_id FROM documents p JOIN documents q ON coalesce(p.text, '') = coalesce(q.text, '') AND p.doc_id <> q.doc_id),
reach AS (SELECT a AS doc_id, a AS low FROM links UNION SELECT l.a, r.low FROM links l JOIN reach r ON l.b = r.doc_id WHERE r.low < l.a)
SELECT d.doc_id, least(d.doc_id, coalesce(r.low, d.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links FROM documents d
LEFT JOIN (SELECT doc_id, min(low) AS low FROM reach GROUP BY 1) r USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY 1) l USING (doc_id)
""",
    "op3_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)
""",
    "op4_url_filter": f"""
WITH {_EVENTS.strip()}
SELECT c.page_id, c.url, strftime(c.t, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists,
  strftime(first, '%Y-%m-%d') AS first_since, coalesce(blocked, false) AS blocked FROM caps c LEFT JOIN lists USING (page_id)
""",
    "op6_suffix_dedup": """
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM t, unnest(range(0, length(x) // 2 - 49)) AS g(i)),
first AS (SELECT s, min(doc_id) AS m FROM w GROUP BY 1 HAVING count(*) > 1),
dup AS (SELECT doc_id, i FROM w JOIN first USING (s) WHERE m < doc_id),
edges AS (SELECT doc_id, i, coalesce(i - lag(i) OVER o > 50, true) AS head FROM dup WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edges),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY 1),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY a) AS k FROM gaps JOIN t USING (doc_id) GROUP BY 1),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, x))) AS kept_sha256 FROM t LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op10_substring_dedup": f"""
WITH words AS ({_WORDS}),
win AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS s FROM words, unnest(range(1, len(w) - 48)) AS g(i)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN first USING (s), unnest(range(0, 50)) AS g(j) WHERE m < doc_id),
each AS (SELECT doc_id, p, w[p] AS x FROM words, unnest(range(1, len(w) + 1)) AS g(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op11_fill_in_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
    list_transform(range(0, 4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS d FROM t),
c AS (
  SELECT *, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
      WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256 FROM p
""",
}
