"""The registered queries of the operators, and SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, binary, bpe, clusters, decontam, language, lexical, licenses, linededup, neardup, pii, quality, sharding
from .common import fold_of, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=40).drop("position")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.encode_files(table(spark, sf_dir, "documents"), end_id=2)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(table(spark, sf_dir, "embeddings"), dim=64, k=40, rounds=5, scale=256, seed="2")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.drop_repeated(table(spark, sf_dir, "documents"), least_docs=5, least_chars=40)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after the other, every vector against every centroid."""
    parts = [
        "kept AS (SELECT row_number() OVER () AS no, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "v AS MATERIALIZED (SELECT no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM v ORDER BY c LIMIT {k})",
    ]
    near = "AS MATERIALIZED (SELECT no, vec_id, v, min(struct_pack(d := d, c := c)) AS b FROM (SELECT no, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM v, c{0}) GROUP BY ALL)"
    for i in range(rounds):
        parts.append(f"a{i} {near.format(i)}")
        parts.append(f"s{i} AS (SELECT b.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) r(j) GROUP BY ALL)")
        parts.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM s{i} GROUP BY c)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN m{i} n USING (c))")
    parts.append(f"l {near.format(rounds)}")
    return f"""WITH {", ".join(parts)} SELECT vec_id, b.c::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia,
    (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM l JOIN c{rounds} ON b.c = c"""


UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

LEXICAL_SQL = rf"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM len),
post AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, size),
m AS (SELECT doc_id, 25 + (75 * n * docs) // l AS m FROM len, size),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN post USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

LINES_SQL = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPER}, {LOWER}) AS key FROM d, unnest(range(1, len(lines) + 1)) t(i)),
often AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, last IS NOT NULL AND doc_id <> last AS gone FROM l LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


OPERATORS = (op1_sharding, op2_licenses, op3_language, op4_binary, op5_neardup, op6_ann, op7_bpe, op8_pii, op9_quality, op10_decontam, op11_clusters, op12_lexical, op13_lines)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE_SQL = {"op2_licenses": licenses.oracle(), "op11_clusters": clusters_sql(), "op12_lexical": LEXICAL_SQL, "op13_lines": LINES_SQL}
