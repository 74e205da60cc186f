"""The queries of this subpackage and their SQL; corpus_pipeline.py holds the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from daytrace.llm import byte_bpe, divergence, embedding_dedup, langid, line_templates, minhash, mixing, packing, quality_lm, quality_rules, substring_dedup, url_filters, vector_codes
from daytrace.llm.common import table

#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality_lm.classify(table(spark, sf_dir, "documents"), trusted)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dropped_lines(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("position"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_runs(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filters.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH s AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM s),
r(v, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, host, path, v, rh || rp AS rule,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""



def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS words FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(words)::HUGEINT AS words FROM g GROUP BY lang), v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (words + 2 * v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (coalesce(sum(n), 0)::HUGEINT + 2) // (any_value(l.words) + 2 * any_value(v)) AS q FROM k JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, term) GROUP BY ALL),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""

def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """The rounds written out; a part's entry is found by row number over squared distances in whole numbers."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS HUGEINT)"
    near = """SELECT i, part, entry, d FROM (SELECT x.i, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN {b} b USING (part, pos) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY i, part ORDER BY d, entry) = 1"""
    steps = ["""k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
y AS (SELECT i, len(e) // 8 AS w, unnest(range(len(e))) AS p, unnest(e) AS x FROM k), x AS (SELECT i, p // w AS part, p % w AS pos, CAST(floor(4096 * x) AS HUGEINT) AS v FROM y),
b0 AS (SELECT part, i AS entry, pos, v FROM x WHERE i < 16)"""]
    for r in range(1, vector_codes.ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(b=f'b{r - 1}')})")
        steps.append(f"m{r} AS (SELECT x.part, a.entry, pos, CAST(sum(v) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM x JOIN a{r} a ON a.i = x.i AND a.part = x.part GROUP BY ALL)")
        steps.append(f"b{r} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce({floor}, b.v) AS v FROM b{r - 1} b LEFT JOIN m{r} m USING (part, entry, pos))")
    last = f"b{vector_codes.ROUNDS}"
    return f"""WITH {", ".join(steps)},
a AS ({near.format(b=last)}), c AS (SELECT i, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM {last}) AS codebooks_sha256 FROM k JOIN c USING (i)"""


OP12_SQL = _op12_sql()

def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, byte_bpe.SPACED)
    coded = byte_bpe.decode(coded.drop("text"), ranks)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * n AS cap FROM r),
o AS (SELECT *, row_number() OVER x AS nr, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW x AS (ORDER BY cap / w, rank)),
f AS (SELECT min(nr) AS nr FROM o WHERE cap > level * w),
t AS (SELECT o.source, o.n, o.rank, o.w, CASE WHEN o.nr >= f.nr THEN (SELECT level FROM o, f WHERE o.nr = f.nr) * o.w ELSE o.cap END AS target FROM o, f),
c AS (SELECT d.*, t.n, t.w, t.rank, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, before + size <= target AS one, n + before + size <= target AS two FROM c),
l AS (SELECT source, any_value(target) - sum(size * (one::INT + two::INT)) AS remains FROM k GROUP BY source),
b AS (SELECT k.source, arg_min(doc_id, (abs(size - remains), h, doc_id)) AS fill FROM k JOIN l ON k.source IS NOT DISTINCT FROM l.source
      WHERE one::INT + two::INT < greatest(1, ceil(target / n)) AND abs(size - remains) < remains GROUP BY k.source),
p AS (SELECT k.*, coalesce(b.fill = doc_id, false) AS extra FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source),
u AS (SELECT *, CASE WHEN one THEN before + size / 2.0::DOUBLE WHEN two THEN n + before + size / 2.0::DOUBLE WHEN extra THEN target - size / 2.0::DOUBLE END / greatest(target, 1) AS place,
             [1.5, 1.0, 0.5][rank % 3 + 1]::DOUBLE AS a, [0.5, 1.0, 1.5][rank % 3 + 1]::DOUBLE AS z FROM p),
v AS (SELECT *, least(1, greatest(0, place)) AS wanted, (a + 1) / 4 AS half, 2 * (1 - a) AS s1, 2 * (z - 1) AS s2 FROM u)
SELECT doc_id, size, n AS source_size, target, CAST(size * (one::INT + two::INT + extra::INT) AS BIGINT) AS taken,
       round(CASE WHEN place IS NULL THEN NULL WHEN wanted <= half THEN CASE WHEN wanted <= 0 THEN 0 ELSE 2 * wanted / (a + sqrt(greatest(0, a * a + 2 * s1 * wanted))) END
            ELSE 0.5 + 2 * (wanted - half) / (1 + sqrt(greatest(0, 1 + 2 * s2 * (wanted - half)))) END, 6) AS position
FROM v
"""

OP8_SQL = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN m ON v.vec_id = m.a
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k:k + 4], ' ')) AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(b, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES = {"op4_mixing": OP4_SQL, "op8_embedding_near_dedup": OP8_SQL, "op9_url_filters": OP9_SQL, "op10_minhash_near_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_vector_codes": OP12_SQL}
