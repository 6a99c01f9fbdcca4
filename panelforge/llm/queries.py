"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import prepare
from panelforge.llm.exact_dedup import exact_dedup
from panelforge.llm.fim import fill_in_middle
from panelforge.llm.langid import language_id
from panelforge.llm.license_join import PHRASES, TEMPLATES, license_scan
from panelforge.llm.minhash import near_dedup
from panelforge.llm.mixing import mix
from panelforge.llm.nn_descent import near_vectors
from panelforge.llm.packing import pack
from panelforge.llm.role_repair import repair_roles
from panelforge.llm.secret_scan import secret_scan
from panelforge.llm.spelling import spelling_variants
from panelforge.llm.toxicity import toxicity
from panelforge.llm.url_tree import judge_urls

REGISTRY: dict = {}
ORACLE: dict = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_golomb_exact_dedup(spark, sf_dir):
    """Exact copies of whole documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op6_golomb_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


@query
def op8_water_filling_mix(spark, sf_dir):
    """Words each document gives to a mix with weights 5, 2, 1 per source."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE["op8_water_filling_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('0:' || doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w,
             3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, cap / w AS r,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
l AS (SELECT (total - spent)::DOUBLE AS lf, ws AS lw FROM o WHERE (total - spent) * w <= cap * ws
      ORDER BY r, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, lf * w / lw) AS target FROM o, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats,
      round(target)::BIGINT AS goal FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.repeats, p.goal - p.repeats * p.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (repeats * size + greatest(0, least(size, rest - start)))::BIGINT AS taken, repeats
FROM c
"""


@query
def op10_hierarchical_packing(spark, sf_dir):
    """Pieces of all documents in windows of 4096 ids and shorter tiers."""
    return pack(table(spark, sf_dir, "documents"))


@query
def op5_hyperdimensional_language(spark, sf_dir):
    """Language of every document from letter n-gram profiles."""
    return language_id(table(spark, sf_dir, "documents"))


@query
def op7_kneser_ney_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_randomness_secret_scan(spark, sf_dir):
    """Secrets in every document: fixed patterns and random-looking runs."""
    return secret_scan(table(spark, sf_dir, "documents"))


@query
def op9_bbit_minhash_near_dedup(spark, sf_dir):
    """Near copies among all documents (5-word shingles, similarity 0.85)."""
    return near_dedup(table(spark, sf_dir, "documents"))


@query
def op1_nn_descent_near_dedup(spark, sf_dir):
    """Near copies among all embeddings of a label (cosine 0.98)."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_path_template_filter(spark, sf_dir):
    """Verdict for every page url."""
    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op2_role_repair(spark, sf_dir):
    """Cheapest legal reading of every conversation, turn by turn."""
    return repair_roles(table(spark, sf_dir, "conversations"))


@query
def op11_piece_table_fim(spark, sf_dir):
    """Fill-in-middle sequences of all documents, as digests."""
    return fill_in_middle(table(spark, sf_dir, "documents"))


ORACLE["op11_piece_table_fim"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1) AS h1, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1) AS h2,
             ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS h4 FROM d),
f AS (SELECT *, least(h1, h2)::BIGINT AS a, greatest(h1, h2)::BIGINT AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                  WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
                          WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                          ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a)
                     END AS output FROM f),
r AS (SELECT *, instr(output, '<P>') AS p, instr(output, '<S>') AS s, instr(output, '<M>') AS m FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                        WHEN 'psm' THEN substr(output, 4, s - 4) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
                        ELSE substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, 4, p - 4)
              END) AS restored_sha256
FROM r
"""


@query
def op12_license_set_join(spark, sf_dir):
    """License phrases and notices in all documents."""
    return license_scan(table(spark, sf_dir, "documents"))


def _values(rows) -> str:
    return ", ".join("(%s)" % ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) for r in rows)


# Every block against every template, without order or filters.
ORACLE["op12_license_set_join"] = r"""
WITH word AS MATERIALIZED (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS re, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up,
                                  'abcdefghijklmnopqrstuvwxyz' AS low),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
raw(label, thr, body) AS (VALUES %s),
t0 AS (SELECT row_number() OVER () AS no, label, thr,
              regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
t AS (SELECT no, label, list_distinct(w) AS tw, ceil(thr * len(list_distinct(w)) - 1e-9) AS need,
             (2 * pow(2, ceil(log2(len(w)))))::BIGINT AS win FROM t0),
b AS (SELECT uid, win, list_distinct(w[s + 1 : s + win]) AS b
      FROM (SELECT uid, w, win, unnest(generate_series(0, len(w) - 1, win // 2)) AS s
            FROM d, (SELECT DISTINCT win FROM t) WHERE len(w) > 0)),
m AS (SELECT uid, label, len(list_intersect(b, tw)) / len(tw) AS c FROM b JOIN t USING (win)
      WHERE len(list_intersect(b, tw)) >= need),
ph(label, p) AS (VALUES %s),
ps AS (SELECT label, string_split(p, ' ') AS p FROM ph),
h AS (SELECT uid, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS pos FROM d, ps),
base AS (SELECT uid, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
         FROM h GROUP BY uid),
al AS (SELECT uid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS best
       FROM (SELECT uid, label, c FROM m UNION ALL SELECT uid, label, 1.0 FROM h) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a AS first_word, base.z AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, coalesce(best, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (uid) LEFT JOIN al USING (uid)
""" % (_values(TEMPLATES), _values(PHRASES))


@query
def op13_fst_spelling_variants(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))


# crc32 of every (document, run) byte by byte, all pairs through deleted letters.
ORACLE["op13_fst_spelling_variants"] = r"""
WITH RECURSIVE
tab AS (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) g(i)),
occ AS (SELECT doc_id, w, count(*) AS n FROM (
          SELECT doc_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
          FROM documents) WHERE length(w) >= 5 GROUP BY ALL),
num AS MATERIALIZED (SELECT row_number() OVER () AS id, w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM occ),
crc AS (SELECT id, h, 0 AS i, 4294967295 AS c FROM num
        UNION ALL
        SELECT id, h, crc.i + 1, xor(c >> 8, v) FROM crc
        JOIN tab ON tab.i = xor(c, ('0x' || substr(h, 2 * crc.i + 1, 2))::BIGINT) & 255 WHERE 2 * crc.i < length(h)),
cut AS (SELECT w, n, xor(c, 4294967295) AS hash FROM crc JOIN num USING (id) WHERE 2 * i = length(crc.h)),
voc AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN hash % 97 = 0 THEN substr(w, 1, hash % length(w)) || substr(w, hash % length(w) + 2) ELSE w END AS word, n
    FROM cut) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest
        FROM (SELECT word, n, unnest(range(length(word))) AS k FROM voc)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM del a JOIN del b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT v.word, v.n, d.word, d.n FROM voc v JOIN del d ON v.word = d.rest
  UNION SELECT d.word, d.n, v.word, v.n FROM voc v JOIN del d ON v.word = d.rest),
best AS MATERIALIZED (
  SELECT word, n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near)
  WHERE r = 1),
way AS (SELECT word, word AS root FROM voc
        UNION ALL SELECT way.word, best.form FROM way JOIN best ON way.root = best.word WHERE best.form IS NOT NULL),
ends AS (SELECT way.word, root FROM way LEFT JOIN best ON root = best.word WHERE form IS NULL)
SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM voc LEFT JOIN best USING (word) JOIN ends USING (word)
"""
