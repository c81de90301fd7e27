"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cohesia.runtime import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers ``f``; its result is written and the tables of its way there are deleted."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settled(spark, lambda: f(spark, sf_dir), f.__name__)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.simhash import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


#: Fixed rules of the contract: (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


_RULE_FITS = "\n".join(
    f"    WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN '{host}{path}'"
    for _, host, path in sorted(URL_RULES, key=lambda r: (-len(r[1]), -len(r[2])))
)
_RULE_SAYS = "\n".join(f"    WHEN '{host}{path}' THEN '{verdict}'" for verdict, host, path in URL_RULES)
SQL["op3_url_filters"] = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(r, ''), '^[^/]*(.*)$', 1, 's') AS path FROM rest
), fits AS (
  SELECT *, CASE
{_RULE_FITS}
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE rule
{_RULE_SAYS}
    ELSE 'allow' END AS verdict
FROM fits
"""


@query
def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


SQL["op8_exact_topk_search"] = """
WITH usable AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.r <> q.r
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op10_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS w
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS u(i)
), hits AS (
  SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (n, w)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS u(j) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


@query
def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.mixing import sample

    return sample(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op6_mixing_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM totals
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, (cap::DOUBLE / weight, place)) FROM l WHERE weight * level <= cap)) AS target FROM l
), e0 AS (
  SELECT d.source, length(bin(size)) AS digits, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, any_value(target) AS target
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY 1, 2
), v AS (
  SELECT *, (target - (coalesce(sum(words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)::DOUBLE)
            / (sum(words * digits) OVER (PARTITION BY source ORDER BY digits))::DOUBLE AS level FROM e0
), e AS (
  SELECT *, CASE WHEN target < source_size * 3 THEN least(coalesce((max(CASE WHEN level * digits <= 3 THEN {'digits': digits, 'level': level} END) OVER (PARTITION BY source)).level * digits, 3), 3) ELSE 3 END AS copies FROM v
), f AS (
  SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS part FROM e
), g AS (
  SELECT *, target - (sum(whole * words) OVER (PARTITION BY source))::DOUBLE AS fill FROM f
), q AS (
  SELECT d.doc_id, d.source, size, whole, part, fill, CASE WHEN part > 0 THEN u / (1 - u) * ((1 - part) / part) END AS odds
  FROM d LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source AND size > 0 AND length(bin(size)) = g.digits
), c AS (
  SELECT doc_id, q.source, size, odds, fill, 0.02::DOUBLE * target AS enough,
         sum(size) OVER (PARTITION BY q.source ORDER BY odds, doc_id ROWS UNBOUNDED PRECEDING) <= least(fill + size / 2, fill + 0.02::DOUBLE * target) AS first
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source WHERE part > 0
), r AS (
  SELECT *, fill - coalesce(sum(size) FILTER (first) OVER (PARTITION BY source), 0) AS rest FROM c
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, length(bin(size)) ORDER BY odds, doc_id) AS nth FROM r WHERE NOT first AND rest > enough AND size <= rest
), o AS (
  SELECT doc_id, source, size, rest, enough, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) DESC, nth) AS i FROM n WHERE nth <= 8
), s AS (
  SELECT source, NULL::BIGINT AS doc_id, max(rest) AS rest, 0 AS i, false AS took FROM o GROUP BY source
  UNION ALL
  SELECT s.source, o.doc_id, CASE WHEN o.size <= s.rest AND s.rest > enough THEN s.rest - o.size ELSE s.rest END, o.i, o.size <= s.rest AND s.rest > enough
  FROM s JOIN o ON o.source IS NOT DISTINCT FROM s.source AND o.i = s.i + 1
), k AS (
  SELECT doc_id FROM c WHERE first UNION ALL SELECT doc_id FROM s WHERE took
), y AS (
  SELECT *, doc_id IN (FROM k) AS taken, fill - coalesce(sum(size) FILTER (doc_id IN (FROM k)) OVER (PARTITION BY source), 0) AS left_over FROM c
), m AS (
  FROM k UNION ALL SELECT arg_min(doc_id, (size, odds, doc_id)) FROM y WHERE NOT taken AND left_over > enough AND size < 2 * left_over GROUP BY source
)
SELECT doc_id, q.size, t.source_size, t.target, (q.size * (coalesce(whole, 0) + CASE WHEN doc_id IN (FROM m) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source
"""


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


SQL["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, pos::BIGINT AS pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
), c AS (
  SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines
), runs AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - a.nw + 25 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM c b JOIN c a ON a.doc_id = b.doc_id AND a.pos <= b.pos AND b.upto - (a.upto - a.nw) >= 25 GROUP BY 1, 3
), texts AS (
  SELECT r.doc_id, s, e, string_agg(line, chr(10) ORDER BY pos) AS run FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.pos BETWEEN s AND e GROUP BY 1, 2, 3
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY run, e - s ORDER BY doc_id, s) AS nth FROM texts
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM firsts WHERE nth > 1
)
SELECT d.doc_id, count(l.pos)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_sha256
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY d.doc_id
"""


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@query
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.resampling import importance

    found = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


SQL["op11_importance_resampling"] = r"""
WITH sums AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), w AS (
  SELECT 's' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 't', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), runs AS (
  SELECT side, doc_id, array_to_string(ws[i:i + n - 1], ' ') AS f, count(*) AS c FROM w, range(1, 4) AS k(n), unnest(range(1, len(ws) - n + 2)) AS u(i) GROUP BY ALL
), hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
                lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295)) % 10000 AS bucket FROM (SELECT DISTINCT f FROM runs), sums
), found AS (
  SELECT side, doc_id, bucket, c FROM runs JOIN hashed USING (f)
), counts AS (
  SELECT bucket, coalesce(sum(c) FILTER (side = 's'), 0)::BIGINT AS s, coalesce(sum(c) FILTER (side = 't'), 0)::BIGINT AS t FROM found GROUP BY bucket
), totals AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, totals
), weights AS (
  SELECT doc_id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(ws) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (doc_id) WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER (PARTITION BY n >= 20) // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND r <= drawn THEN r END AS rank FROM ranked
"""


@query
def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohesia.llm.audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op12_filter_interaction_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents
), firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text
), said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 3 * length(d.text),
                regexp_matches(d.text, '[#$%&*|]'), doc_id > least] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN firsts USING (text) LEFT JOIN said USING (doc_id)
), n AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, fails
), f AS (SELECT unnest(range(1, 6)) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM f a, f b, f c, f e, f g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5
), steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders
), cells AS (
  SELECT part, o, step, o[step] AS filter,
         sum(n) FILTER (fails[o[step]] AND NOT list_contains(list_transform(o[1:step - 1], lambda i: fails[i]), true)) AS removed,
         sum(good) FILTER (fails[o[step]] AND NOT list_contains(list_transform(o[1:step - 1], lambda i: fails[i]), true)) AS good_lost,
         sum(toxic) FILTER (fails[o[step]] AND NOT list_contains(list_transform(o[1:step - 1], lambda i: fails[i]), true)) AS toxic_lost,
         sum(n) FILTER (NOT list_contains(list_transform(o[1:step], lambda i: fails[i]), true)) AS kept,
         sum(n) FILTER (fails[o[step]]) AS failing,
         sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS alone
  FROM steps, n GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       (coalesce(failing, 0) - coalesce(removed, 0))::BIGINT AS redundant, coalesce(alone, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley
FROM cells
"""


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cohesia.llm.packing import pack

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        found = pack(table(spark, sf_dir, "documents"), file.read())
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)
