"""Search, documents and vectors on the driver's tables: `documents` is the corpus, its `lang` the type."""

import uuid

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import folds, index, listing, search, vectors
from ..sources.store import shared_folder, table
from . import ORACLE_SQL, QUERIES, query

EXACT_QUERY, PREFIX_QUERY, FUZZY_QUERY, HYBRID_QUERY = "clown disgusting clown", "disg clow", "disgustng clwn", "clown disg thti idoit"

TOK = "tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)"
INDEX = f"""{TOK}, len AS (SELECT id, count(*) AS n_tokens FROM tok GROUP BY id),
post AS (SELECT id, token, count(*) AS n, any_value(n_tokens) AS n_tokens, count(*) / any_value(n_tokens)::DOUBLE AS tf FROM tok JOIN len USING (id) GROUP BY id, token),
size AS (SELECT greatest(count(*), 1) AS docs FROM len),
idf AS (SELECT token, count(*) AS df, ln(any_value(docs) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM post, size GROUP BY token),
norm AS (SELECT id, CASE WHEN sqrt(sum((tf * idf) * (tf * idf))) = 0 THEN 1 ELSE sqrt(sum((tf * idf) * (tf * idf))) END AS norm FROM post JOIN idf USING (token) GROUP BY id)"""


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), "text")


def indexed(spark, sf_dir):
    c = corpus(spark, sf_dir)
    p = index.postings(c)
    return c, p, index.idf(p, index.corpus_size(c))


STORES: dict = {}


def new_store(spark) -> index.Store:
    return index.Store(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")


def store(spark, sf_dir) -> index.Store:
    """The stored index of the documents; the first query of a session builds it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in STORES:
        c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), "text", F.create_map(F.lit("source"), "source").alias("metadata"))
        STORES[key] = new_store(spark).add(c, "2024-01-01 00:00:00")
    return STORES[key]


@query(f"WITH {TOK} SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT token) AS vocabulary, (SELECT count(*) FROM documents) AS total_indexed, 0::BIGINT AS total_removed FROM tok")
def index_build(spark, sf_dir):
    """Builds the index, always anew; the searches read it."""
    STORES.pop((spark.sparkContext.applicationId, sf_dir), None)
    return store(spark, sf_dir).stats()


def search_sql(text: str, type_: str | None = None, fuzzy: bool = True, most: int = 2, k: int = 10) -> str:
    q = search.tokens_of(text)
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(q))
    near = f"min(CASE WHEN levenshtein(v.token, q.qt) <= {most} THEN levenshtein(v.token, q.qt) END)" if fuzzy else "NULL::BIGINT"
    kind = f"JOIN documents d ON d.doc_id = p.id AND d.lang = '{type_}'" if type_ else ""
    return f"""WITH {INDEX}, q(pos, qt) AS (VALUES {rows}),
    hit AS (SELECT v.token, bool_or(v.token = q.qt) AS exact, bool_or(starts_with(v.token, q.qt)) AS prefix, {near} AS dist FROM idf v, q GROUP BY v.token HAVING bool_or(starts_with(v.token, q.qt)) OR {near} IS NOT NULL),
    cand AS (SELECT p.id, bool_or(exact) AS exact, bool_or(prefix) AS prefix, min(dist) AS dist FROM post p JOIN hit h ON p.token = h.token {kind} GROUP BY p.id),
    qw AS (SELECT qt, coalesce(idf, 0) / {len(q)} AS w FROM q LEFT JOIN idf ON token = qt),
    qn AS (SELECT CASE WHEN sqrt(sum(w * w)) = 0 THEN 1 ELSE sqrt(sum(w * w)) END AS q_norm FROM qw),
    dot AS (SELECT p.id, sum(w * (p.tf * i.idf)) AS dot FROM post p JOIN qw ON p.token = qt JOIN idf i ON i.token = p.token GROUP BY p.id),
    raw AS (SELECT c.*, coalesce(dot, 0) / (q_norm * norm) AS raw FROM cand c LEFT JOIN dot USING (id) JOIN norm USING (id), qn)
    SELECT r.id, d.lang AS type, round(raw + CASE WHEN exact THEN 0.25 WHEN prefix THEN 0.15 ELSE -0.1 * dist END, 6) AS score, round(raw, 6) AS tfidf,
           CASE WHEN exact THEN 'exact' WHEN prefix THEN 'prefix' ELSE 'fuzzy(editDistance=' || dist || ')' END AS match_type
    FROM raw r JOIN documents d ON d.doc_id = r.id ORDER BY score DESC, r.id LIMIT {k}"""


def _search(name, text, **options):
    def run(spark, sf_dir):
        return search.search(store(spark, sf_dir).tables(), text, **options).select("id", "type", "score", "tfidf", "match_type")

    QUERIES[name] = run
    ORACLE_SQL[name] = search_sql(text, options.get("type"), options.get("fuzzy", True), options.get("max_distance", 2), options.get("top_k", 10))


_search("search_exact", EXACT_QUERY, fuzzy=False)
_search("search_prefix", PREFIX_QUERY, fuzzy=False)
_search("search_fuzzy", FUZZY_QUERY)
_search("search_hybrid", HYBRID_QUERY, top_k=50)
_search("search_hybrid_typed", HYBRID_QUERY, type="en", top_k=20, max_distance=1)


@query("SELECT r.*, d.source, len(t)::INT AS token_count, len(list_distinct(t))::INT AS unique_tokens, TIMESTAMP '2024-01-01 00:00:00' AS indexed_at FROM (" + search_sql(HYBRID_QUERY, None, True, 2, 10) + ") r JOIN (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) d ON d.doc_id = r.id")
def search_rows(spark, sf_dir):
    """The whole entries of the best, with their metadata."""
    return search.search(store(spark, sf_dir).tables(), HYBRID_QUERY).withColumn("source", F.col("metadata")["source"]).drop("metadata").withColumn("indexed_at", F.col("indexed_at").cast("timestamp_ntz"))


@query("SELECT doc_id AS id, lang AS type FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' of the ')")
def search_phrase(spark, sf_dir):
    return search.phrase(store(spark, sf_dir).tables(), "Of the")


@query("SELECT doc_id AS id, lang AS type FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' is the is ') OR contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' the the the ')")
def search_phrase_repeated(spark, sf_dir):
    """Phrases that hold a word twice or thrice."""
    own = store(spark, sf_dir).tables()
    return search.phrase(own, "is the is").union(search.phrase(own, "The, the the")).distinct()


@query("WITH w AS (SELECT doc_id AS id, lang AS type, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), t AS MATERIALIZED (SELECT * FROM w WHERE list_has_all(t, ['of', 'is', 'the'])) SELECT id, type FROM t WHERE len(list_filter(range(1, len(t) + 1), lambda i: list_has_all(t[i : i + 5], ['of', 'is', 'the']))) > 0")
def search_near(spark, sf_dir):
    return search.near(store(spark, sf_dir).tables(), "of is the", within=6)


@query("WITH tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) SELECT id, len(t)::INT AS token_count, len(list_distinct(t))::INT AS unique_tokens FROM tok")
def token_stats(spark, sf_dir):
    return index.token_stats(corpus(spark, sf_dir))


@query(f"WITH {INDEX} SELECT id, token, n, round(tf, 9) AS tf FROM post")
def term_frequency(spark, sf_dir):
    return index.postings(corpus(spark, sf_dir)).select("id", "token", "n", F.round("tf", 9).alias("tf"))


@query(f"WITH {INDEX} SELECT token, df, round(idf, 9) AS idf FROM idf")
def idf_table(spark, sf_dir):
    return indexed(spark, sf_dir)[2].select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {INDEX} SELECT id, round(norm, 9) AS norm FROM norm")
def doc_norms(spark, sf_dir):
    _, p, w = indexed(spark, sf_dir)
    return index.norms(p, w).select("id", F.round("norm", 9).alias("norm"))


def many_sql(queries: str, skip_self: str, k: int) -> str:
    return f"""WITH {INDEX}, qs AS ({queries}),
    qt AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM qs),
    ql AS (SELECT query_id, count(*) AS l FROM qt GROUP BY query_id),
    q AS (SELECT query_id, token, count(*) AS n, any_value(l) AS l FROM qt JOIN ql USING (query_id) GROUP BY query_id, token),
    t AS (SELECT DISTINCT token FROM q),
    reach AS (SELECT v.token AS vt, t.token AS qt FROM idf v JOIN t ON starts_with(v.token, t.token)),
    touched AS (SELECT p.id, r.qt, bool_or(r.vt = r.qt) AS exact FROM post p JOIN reach r ON p.token = r.vt GROUP BY p.id, r.qt),
    cand AS (SELECT q.query_id, x.id, bool_or(x.exact) AS exact FROM q JOIN touched x ON x.qt = q.token GROUP BY q.query_id, x.id),
    w AS (SELECT query_id, q.token, n, idf / l AS share FROM q JOIN idf USING (token)),
    qn AS (SELECT query_id, sqrt(sum(n * share * share)) AS q_norm FROM w GROUP BY query_id),
    dot AS (SELECT w.query_id, p.id, sum(w.n * w.share * (p.tf * i.idf)) AS dot FROM post p JOIN w ON p.token = w.token JOIN idf i ON i.token = p.token GROUP BY w.query_id, p.id),
    raw AS (SELECT c.*, coalesce(dot, 0) / (coalesce(nullif(q_norm, 0), 1) * norm) AS raw FROM cand c LEFT JOIN dot USING (query_id, id) LEFT JOIN qn USING (query_id) JOIN norm USING (id) {skip_self}),
    s AS (SELECT query_id, id, round(raw + CASE WHEN exact THEN 0.25 ELSE 0.15 END, 6) AS score, round(raw, 6) AS tfidf, CASE WHEN exact THEN 'exact' ELSE 'prefix' END AS match_type FROM raw)
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY rank <= {k}"""


@query(many_sql("SELECT item_id AS query_id, text FROM benchmark", "", 10))
def search_batch(spark, sf_dir):
    return search.search_many(store(spark, sf_dir).tables(), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def many_fuzzy_sql(queries: str, k: int, most: int) -> str:
    """The same with fuzzy matches, every token of the queries against every token of the vocabulary."""
    exact = many_sql(queries, "", k)
    tail = exact.index("reach AS (")
    return exact[:tail] + f"""hit AS (SELECT v.token AS vt, t.token AS qt, starts_with(v.token, t.token) AS prefix, CASE WHEN length(v.token) BETWEEN length(t.token) - {most} AND length(t.token) + {most} AND levenshtein(v.token, t.token) <= {most} THEN levenshtein(v.token, t.token) END AS dist FROM idf v, t),
    reach AS (SELECT * FROM hit WHERE prefix OR dist IS NOT NULL),
    touched AS (SELECT p.id, r.qt, bool_or(r.vt = r.qt) AS exact, bool_or(prefix) AS prefix, min(dist) AS dist FROM post p JOIN reach r ON p.token = r.vt GROUP BY p.id, r.qt),
    cand AS (SELECT q.query_id, x.id, bool_or(x.exact) AS exact, bool_or(x.prefix) AS prefix, min(dist) AS dist FROM q JOIN touched x ON x.qt = q.token GROUP BY q.query_id, x.id),
    w AS (SELECT query_id, q.token, n, idf / l AS share FROM q JOIN idf USING (token)),
    qn AS (SELECT query_id, sqrt(sum(n * share * share)) AS q_norm FROM w GROUP BY query_id),
    dot AS (SELECT w.query_id, p.id, sum(w.n * w.share * (p.tf * i.idf)) AS dot FROM post p JOIN w ON p.token = w.token JOIN idf i ON i.token = p.token GROUP BY w.query_id, p.id),
    raw AS (SELECT c.*, coalesce(dot, 0) / (coalesce(nullif(q_norm, 0), 1) * norm) AS raw FROM cand c LEFT JOIN dot USING (query_id, id) LEFT JOIN qn USING (query_id) JOIN norm USING (id)),
    s AS (SELECT query_id, id, round(raw + CASE WHEN exact THEN 0.25 WHEN prefix THEN 0.15 ELSE -0.1 * dist END, 6) AS score, round(raw, 6) AS tfidf, CASE WHEN exact THEN 'exact' WHEN prefix THEN 'prefix' ELSE 'fuzzy(editDistance=' || dist || ')' END AS match_type FROM raw)
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY rank <= {k}"""


@query(many_fuzzy_sql("SELECT item_id AS query_id, text FROM benchmark", 10, 2))
def search_batch_fuzzy(spark, sf_dir):
    return search.search_many(store(spark, sf_dir).tables(), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), fuzzy=True)


MISSPELT = "regexp_replace(t, '^(.)(.)(.*)$', '\\2\\1\\3') || 'q'"


@query(many_fuzzy_sql(f"SELECT item_id AS query_id, string_agg(w, ' ') AS text FROM (SELECT DISTINCT item_id, {MISSPELT} AS w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark) WHERE length(t) BETWEEN 5 AND 9) GROUP BY item_id", 10, 3))
def search_batch_misspelt(spark, sf_dir):
    """Words of the benchmark with their first letters exchanged and another letter at the end: hardly one matches but by edits."""
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokenize(F.col("text"))).alias("t")).filter("length(t) between 5 and 9")
    wrong = t.select("query_id", F.concat(F.regexp_replace("t", "^(.)(.)(.*)$", "$2$1$3"), F.lit("q")).alias("w")).distinct()
    return search.search_many(store(spark, sf_dir).tables(), wrong.groupBy("query_id").agg(F.array_join(F.collect_list("w"), " ").alias("text")), fuzzy=True, max_distance=3)


@query("SELECT rank, id, score, tfidf, match_type FROM (" + many_sql("SELECT doc_id AS query_id, text FROM documents WHERE doc_id = 7", "WHERE query_id <> id", 5) + ")")
def similar_documents(spark, sf_dir):
    return search.similar(store(spark, sf_dir).tables(), 7, 5)


@query(f"WITH {TOK} SELECT DISTINCT token FROM tok WHERE starts_with(token, 'clo') ORDER BY token LIMIT 10")
def suggest(spark, sf_dir):
    return search.suggest(store(spark, sf_dir).tables().vocabulary, "CLO", 10)


@query(f"""WITH {INDEX}, q(position, query_token) AS (VALUES (0, 'clown'), (1, 'disg'), (2, 'clown'), (3, 'zzzz')),
b AS (SELECT query_token, count(DISTINCT id) AS n FROM post JOIN (SELECT DISTINCT query_token FROM q) ON starts_with(token, query_token) GROUP BY query_token)
SELECT q.position::INT AS position, q.query_token, round(coalesce(idf, 0), 4) AS idf, coalesce(df, 0) AS document_frequency, coalesce(n, 0) AS prefix_matches FROM q LEFT JOIN idf ON token = q.query_token LEFT JOIN b USING (query_token)""")
def explain_tokens(spark, sf_dir):
    return search.explain(store(spark, sf_dir).tables(), "clown disg clown zzzz")


@query(f"WITH {INDEX}, t AS (SELECT token, round(idf, 4) AS r FROM idf ORDER BY r DESC, token LIMIT 10) SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM idf) AS vocabulary, (SELECT string_agg(token, ' ' ORDER BY r DESC, token) FROM t) AS top_terms")
def explain_totals(spark, sf_dir):
    return search.explain_totals(store(spark, sf_dir).tables(), 10)


@query(f"WITH {INDEX} SELECT token, round(idf, 4) AS idf FROM idf ORDER BY idf.idf DESC, token LIMIT 10")
def top_terms(spark, sf_dir):
    return index.top_terms(store(spark, sf_dir).tables().vocabulary, 10)


@query("""WITH left_ AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'replaced ' || text ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'fr'), tok AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM left_)
SELECT (SELECT count(*) FROM left_) AS documents, count(DISTINCT token) AS vocabulary, (SELECT count(*) + count(*) FILTER (lang = 'de') FROM documents) AS total_indexed, (SELECT count(*) FILTER (lang = 'fr') FROM documents) AS total_removed FROM tok""")
def index_stats(spark, sf_dir):
    """After all documents were added, one language added again with another text, and another language removed."""
    c = corpus(spark, sf_dir)
    again = c.filter("type = 'de'").withColumn("text", F.concat(F.lit("replaced "), "text"))
    return new_store(spark).add(c).add(again).remove(c.filter("type = 'fr'")).stats()


@query("SELECT * FROM (" + search_sql("replaced disg", None, False, 2, 50).replace("documents", "after_").replace("WITH ", "WITH after_ AS (SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'replaced ' || text ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'fr'), ", 1) + ")")
def search_after_changes(spark, sf_dir):
    """A search of the index after documents were replaced and removed: nothing of the old texts counts."""
    c = corpus(spark, sf_dir)
    again = c.filter("type = 'de'").withColumn("text", F.concat(F.lit("replaced "), "text"))
    changed = new_store(spark).add(c).remove(c.filter("type = 'fr'")).add(again)
    return search.search(changed.tables(), "replaced disg", 50, fuzzy=False).select("id", "type", "score", "tfidf", "match_type")


@query(f"WITH {TOK} SELECT token, levenshtein(token, 'disgusting')::INT AS distance FROM (SELECT DISTINCT token FROM tok) WHERE levenshtein(token, 'disgusting') <= 4")
def fuzzy_match(spark, sf_dir):
    return search.fuzzy_match(store(spark, sf_dir).tables().vocabulary, "disgusting", 4)


@query(f"WITH {TOK}, q(t) AS (VALUES ('clwn'), ('idoit')) SELECT id, min(levenshtein(token, t))::INT AS distance FROM tok, q WHERE levenshtein(token, t) <= 2 GROUP BY id")
def bulk_fuzzy_min(spark, sf_dir):
    return search.fuzzy_documents(index.postings(corpus(spark, sf_dir)), "clwn idoit", 2)


@query(f"""WITH {TOK}, b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM benchmark), v AS (SELECT DISTINCT token AS b FROM tok)
SELECT a, v.b, levenshtein(a, v.b)::INT AS distance FROM b JOIN v ON length(v.b) BETWEEN length(a) - 1 AND length(a) + 1 AND a <> v.b AND levenshtein(a, v.b) <= 1""")
def fuzzy_vocab_pairs(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct()
    return search.fuzzy_pairs(words, store(spark, sf_dir).tables().vocabulary, 1)


@query("""WITH RECURSIVE p AS (SELECT DISTINCT p_name AS a, 'small bolt' AS b FROM part),
r AS (SELECT a, b, 1 AS i, []::BIGINT[] AS used, '' AS l, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS w FROM p
UNION ALL SELECT a, b, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN l ELSE l || a[i] END, w
FROM (SELECT *, list_filter(range(greatest(1, i - w)::BIGINT, (least(length(b), i + w) + 1)::BIGINT), lambda j: NOT list_contains(used, j) AND b[j] = a[i])[1] AS j FROM r WHERE i <= length(a))),
d AS (SELECT a, b, len(used) AS m, list_sum(list_transform(range(1, len(used) + 1), lambda k: CASE WHEN l[k] <> b[list_sort(used)[k]] THEN 0.5 ELSE 0 END)) AS t FROM r WHERE i = length(a) + 1),
s AS (SELECT a, CASE WHEN a = b THEN 1 WHEN m = 0 THEN 0 ELSE (m / length(a)::DOUBLE + m / length(b)::DOUBLE + (m - t) / m::DOUBLE) / 3 END AS j,
CASE WHEN a[1:4] = b[1:4] THEN 4 WHEN a[1:3] = b[1:3] THEN 3 WHEN a[1:2] = b[1:2] THEN 2 WHEN a[1:1] = b[1:1] THEN 1 ELSE 0 END AS same FROM d)
SELECT a, round(j, 6) AS jaro, round(j + same * 0.1 * (1 - j), 6) AS jaro_winkler FROM s""")
def jaro(spark, sf_dir):
    """Half transpositions count, which the SQL engine's own function leaves out."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    return p.select("a", F.round(S.jaro_similarity("a", F.lit("small bolt")), 6).alias("jaro"), F.round(S.jaro_winkler_similarity("a", F.lit("small bolt")), 6).alias("jaro_winkler"))


MD = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#+\s*', '', 'g'), '\*\*|__|\\+|_|~~', '', 'g'), '`{1,3}[^`]*`{1,3}', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT doc_id, md5({MD}) AS digest, length({MD})::INT AS chars FROM documents")
def strip_markdown(spark, sf_dir):
    t = T.strip_markdown(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("chars"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS digest FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest"))


NAMES = "CASE doc_id % 5 WHEN 0 THEN 'notes.MD' WHEN 1 THEN 'a.markdown' WHEN 2 THEN 'a.html' WHEN 3 THEN 'x/b.txt' ELSE 'Makefile' END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'MARKDOWN' WHEN doc_id % 5 = 2 THEN 'HTML' ELSE 'TEXT' END AS document_type FROM documents")
def document_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.document_type(F.expr(NAMES)).alias("document_type"))


W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({W})::INT AS word_count, ceil(len({W}) / 450.0)::INT AS chunk_count FROM documents")
def word_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).alias("word_count"), F.size(T.chunks(t)).alias("chunk_count"))


CHUNK = f"SELECT doc_id, i::INT AS chunk_index, array_to_string(w[i * 450 + 1 : i * 450 + 500], ' ') AS content FROM (SELECT doc_id, {W} AS w FROM documents) d, unnest(range(0, ceil(len(w) / 450.0)::BIGINT)) r(i)"


@query(f"SELECT doc_id, chunk_index, md5(content) AS digest FROM ({CHUNK})")
def chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_index", "content")).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(f"SELECT doc_id, chunk_index, content[1:500] AS preview FROM ({CHUNK})")
def chunk_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunk_previews(F.col("text"))).alias("chunk_index", "preview"))


@query(f"SELECT doc_id, md5(array_to_string(({W})[1:500], ' ')) AS digest FROM documents")
def text_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.text_preview(F.col("text"))).alias("digest"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), r AS (SELECT doc_id, i, ('0x' || substr(h, 2 * (i % 32) + 1, 2))::INT / 255.0::DOUBLE * 2 - 1 AS x FROM h, unnest(range(0, 128)) t(i)),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM r GROUP BY doc_id) SELECT doc_id, i::INT AS at, round(x / n, 6) AS value FROM r JOIN n USING (doc_id)""")
def stub_embedding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.stub_embedding(F.col("text"))).alias("at", "value")).select("doc_id", "at", F.round("value", 6).alias("value"))


def vector_table(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"SELECT b.vec_id AS id, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, sf_dir):
    v = vector_table(spark, sf_dir)
    q = v.filter("id = 3").select("vector").first()["vector"]
    return vectors.top_similar(v, q, 10)


@query(f"SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 5")
def vector_topk_batch(spark, sf_dir):
    v = vector_table(spark, sf_dir)
    return vectors.top_similar_many(v, v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), 5)


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facets(spark, sf_dir):
    return listing.facets(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 20")
def paginate(spark, sf_dir):
    return listing.page(listing.where(table(spark, sf_dir, "documents"), lang="de").select("doc_id", "lang", "n_chars"), 3, 10, "-n_chars", "doc_id")


@query("SELECT count(*) AS total_items, ceil(count(*) / 25.0)::BIGINT AS total_pages FROM documents")
def page_totals(spark, sf_dir):
    return listing.page_count(table(spark, sf_dir, "documents"), 25)


@query("SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return listing.duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, regexp_replace(text, '(clown|idiot)', '<em>\\1</em>', 'gi') AS marked FROM documents WHERE regexp_matches(text, 'clown|idiot', 'i')")
def highlight(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike("(?i)clown|idiot"))
    return d.select("doc_id", T.highlight(F.col("text"), "clown|idiot").alias("marked"))


@query("SELECT lang, count(*) AS documents, round(avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END), 6) AS coverage, round(avg(l.quality), 6) AS quality, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def quality_metrics(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("labelled", F.lit(1))
    return d.join(l, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("documents"), F.round(F.avg(F.coalesce("labelled", F.lit(0))), 6).alias("coverage"), F.round(F.avg("quality"), 6).alias("quality"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest")
    )


@query(f"""WITH lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({search_sql("clown idiot", None, False, 2, 50)})),
vec AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT b.vec_id AS id, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY score DESC, id LIMIT 50))
SELECT id, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score, min(rank)::INT AS best_rank, count(*) AS sources FROM (SELECT * FROM lex UNION ALL SELECT * FROM vec) GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def hybrid_rrf(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank")  # of 50 rows
    v = vector_table(spark, sf_dir)
    q = v.filter("id = 3").select("vector").first()["vector"]
    return listing.fuse({"text": search.search(store(spark, sf_dir).tables(), "clown idiot", 50, fuzzy=False).select("id", rank), "vector": vectors.top_similar(v, q, 50).select("id", rank)})


PLAIN = f"CASE WHEN doc_id % 5 IN (0, 1) THEN {MD} WHEN doc_id % 5 = 2 THEN regexp_replace(text, '<[^>]+>', ' ', 'g') ELSE text END"
PW = W.replace("text", "plain")


@query(f"""WITH p AS (SELECT doc_id, {PLAIN} AS plain FROM documents), w AS (SELECT doc_id, {PW} AS w FROM p),
c AS (SELECT doc_id, w, list_transform(range(0, ceil(len(w) / 450.0)::BIGINT), lambda i: array_to_string(w[i * 450 + 1 : i * 450 + 500], ' ')) AS c FROM w)
SELECT doc_id AS document_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'MARKDOWN' WHEN doc_id % 5 = 2 THEN 'HTML' ELSE 'TEXT' END AS document_type, len(w)::INT AS word_count, len(c)::INT AS chunk_count,
md5(array_to_string(c, '|')) AS chunks_digest, md5(array_to_string(w[1:500], ' ')) AS preview_digest, md5(array_to_string(list_transform(c, lambda x: x[1:500]), '|')) AS previews_digest FROM c""")
def document_pipeline(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("repository_id"), F.expr(NAMES).alias("file_name"), F.col("text").alias("content"))
    joined = lambda c: F.md5(F.array_join(c, "|"))
    return folds.process(d).select("document_id", "document_type", "word_count", "chunk_count", joined("chunks").alias("chunks_digest"), F.md5("text_preview").alias("preview_digest"), joined("chunk_previews").alias("previews_digest"))


@query("""WITH l AS (SELECT doc_id, lang, source, n_chars FROM documents) SELECT doc_id, lang, n_chars FROM l WHERE source = (SELECT min(source) FROM l) AND lang IN ('de', 'en') AND n_chars >= 200 AND n_chars < 2000""")
def tenant_filter(spark, sf_dir):
    """One tenant's documents, its source; the predicate on it is mandatory."""
    d = table(spark, sf_dir, "documents")
    own = d.agg(F.min("source")).first()[0]
    rows = d.withColumnRenamed("source", "organization_id")
    return listing.of_tenant(rows, own, since={"n_chars": 200}, until={"n_chars": 2000}, any_of={"lang": ["de", "en"]}).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id AS id, round(coalesce(quality, 0) * 0.7::DOUBLE + n_chars * 0.001::DOUBLE, 6) AS score FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) ORDER BY score DESC, id LIMIT 10")
def rerank(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "quality", "n_chars")
    return listing.rerank(rows, {"quality": 0.7, "n_chars": 0.001}, 10).select("id", "score")


@query(f"WITH {TOK}, q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark), s AS (SELECT DISTINCT lower(n_name) AS synonym, 'the' AS token FROM nation) SELECT token FROM q UNION SELECT synonym FROM s JOIN q USING (token)")
def query_expansion(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct()
    return listing.expand(q, table(spark, sf_dir, "nation").select(F.lit("the").alias("token"), F.lower("n_name").alias("synonym")).distinct())
