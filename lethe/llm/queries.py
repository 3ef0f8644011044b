"""Queries of the operators over the whole tables of ``sf_dir``, and the SQL
of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm.common import digest, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_SQL_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL_KEY = (f"translate(trim(l, {_SQL_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP1_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
keyed AS (SELECT doc_id, i, l, {_SQL_KEY} AS k FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, i, l, r.k IS NOT NULL AND doc_id <> keeper AS dropped
  FROM keyed LEFT JOIN repeated r ON keyed.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@register("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.line_dedup import dedup_lines
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))


@register("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lethe.llm.byte_bpe import encode_decode
    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                         public_tokenizers.PATTERN)


@register("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.simhash import near_duplicates
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
phrases AS (
  SELECT DISTINCT n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS p, item_id
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (
  SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, windows.n, i, item_id FROM windows JOIN phrases ON windows.n = phrases.n AND windows.p = phrases.p),
hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


@register("op6_decontaminate", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.decontaminate import mark_contamination
    out = mark_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"),
                             read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      digest(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.toxicity import held_out, learn, score_toxicity
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, i, md5(list_aggregate(w[i:i + 49], 'string_agg', ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS owner FROM starts GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM starts JOIN firsts ON starts.h = firsts.h WHERE owner < doc_id),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed,
  sha256(coalesce(list_aggregate(CASE WHEN n IS NULL THEN w
    ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(ps, k)] END, 'string_agg', ' '), '')) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id"""


@register("op2_substring_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.substring_dedup import dedup_substrings
    out = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", digest(F.col("text")).alias("kept_sha256"))


@register("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.sharding import assign_shards
    return assign_shards(read(spark, sf_dir, "documents"), 40)


@register("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.language_id import identify, learn
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs))


def _op5_sql() -> str:
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    rules = [("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"),
             ("net", "/fr/", "block"), ("com", "/", "allow")]  # the longest first
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules]
    case = lambda value: "CASE " + " ".join(f"WHEN {f} THEN '{value(r)}'" for f, r in zip(fits, rules)) + " END"
    levels, below = [], None
    for k in range(5):
        shorter = ("0.001", "0.001", "") if below is None else ("l.pa", "l.pb", f"JOIN {below} l ON l.s = substr(n.s, 2, {k})")
        levels.append(f"""
n{k} AS (SELECT substr(g, {5 - k}, {k + 1}) AS s, sum(a) AS a, sum(b) AS b FROM strings GROUP BY 1),
c{k} AS (SELECT substr(s, 1, {k}) AS c, sum(a) AS ca, sum(b) AS cb FROM n{k} GROUP BY 1),
l{k} AS (SELECT n.s, (a + 2.0::DOUBLE * {shorter[0]}::DOUBLE) / (ca + 2.0::DOUBLE) AS pa,
                (b + 2.0::DOUBLE * {shorter[1]}::DOUBLE) / (cb + 2.0::DOUBLE) AS pb
         FROM n{k} n JOIN c{k} ON c{k}.c = substr(n.s, 1, {k}) {shorter[2]}),""")
        below = f"l{k}"
    return f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {low}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS told FROM p),
-- CRC-32 of the URL's bytes, by its table.
tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab
        FROM (SELECT unnest(range(0, 256)) AS n)),
urls AS (
  SELECT url, rule, told, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(url)),
           lambda i: CAST('0x' || substr(hex(url), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
           lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0 AS held,
    translate(regexp_replace(url, '(?s)^.*?://', ''), {low}) AS body
  FROM (SELECT DISTINCT url, rule, told FROM ruled), tab),
cut_up AS (
  SELECT url, rule, told, held, substr(repeat(chr(2), 4) || body || chr(3), CAST(i AS INTEGER), 5) AS g
  FROM (SELECT *, unnest(range(1, length(body) + 2)) AS i FROM urls)),
strings AS (
  SELECT g, sum(CASE WHEN told = 'allow' AND NOT held THEN 1 ELSE 0 END) AS a,
         sum(CASE WHEN told = 'block' AND NOT held THEN 1 ELSE 0 END) AS b FROM cut_up GROUP BY g),{"".join(levels)}
scores AS (SELECT url, told, avg(ln(pa / pb)) AS score FROM cut_up JOIN l4 ON l4.s = g
           WHERE rule IS NULL OR held GROUP BY url, told),
bins AS (SELECT round(greatest(-10.0::DOUBLE, least(10.0::DOUBLE, score)), 2) AS bin, count(*) FILTER (WHERE told = 'allow') AS a,
                count(*) FILTER (WHERE told = 'block') AS b FROM scores WHERE told IS NOT NULL GROUP BY 1),
gains AS (SELECT bin, coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE
                      / (sum(a) OVER ())::DOUBLE
                      + coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE
                      / (sum(b) OVER ())::DOUBLE AS gain, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM bins),
cut AS (SELECT coalesce(max(bin), 0) AS cut
        FROM (SELECT bin FROM gains WHERE na > 0 AND nb > 0 ORDER BY gain DESC, abs(bin), bin LIMIT 1))
SELECT page_id, host, path, r.rule, coalesce(r.told, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled r LEFT JOIN scores ON scores.url = r.url AND r.rule IS NULL, cut"""


@register("op5_url_filter", _op5_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.url_filter import judge_urls
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).drop("score")


@register("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.quality_rules import apply_rules, learn_rules
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, learn_rules(docs, read(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
corpus AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, coalesce(sum(len(ts)), 0)::BIGINT AS n_all FROM docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, corpus GROUP BY term, n_docs),
gains AS (
  SELECT r, doc_id, held.term,
    w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all))) AS gain
  FROM held JOIN weights ON held.term = weights.term, corpus),
scores AS (
  SELECT item_id, r, doc_id, sum(gain)::BIGINT AS score
  FROM wanted JOIN gains ON wanted.term = gains.term GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10"""


@register("op11_lexical_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.lexical_search import search
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.whitening import whiten
    out = whiten(read(spark, sf_dir, "embeddings"), 4)
    each = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened",
                       F.element_at("explained", F.col("k") + 1).alias("explained"), "identity_error")


@register("op13_fingerprints")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.llm.fingerprints import compare_edited
    return compare_edited(read(spark, sf_dir, "documents"))
