"""The queries of the core operators, each with its SQL for DuckDB where SQL can say it.

All read whole tables. Floating results are rounded alike on both sides; arrays are joined to strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feuillet.functions import text as T
from feuillet.functions.chunking import explode_passages
from feuillet.functions.embedding import with_embedding
from feuillet.operators import build, catalogue, fusion, lexical, metrics, search, sync, vector
from feuillet.plans.numbering import number_rows
from feuillet.plans.shared import new_table_path, write_shared
from feuillet.plans.spread import spread
from feuillet.sources import pages
from feuillet.sources.store import IndexStore, export_rows
from feuillet.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-06-01 00:00:00"  # the clock of the account queries


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


def ged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ged_documents")


# --- text ---------------------------------------------------------------------------------------------------------

WS = r"\t\n\f\r \x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


NORMAL = _strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(extracted_text, '\r\n?', chr(10), 'g'), '[ \t\f\x0b]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
CATEGORY = r"CASE WHEN contains(replace(relative_path, '\', '/'), '/') THEN split_part(replace(relative_path, '\', '/'), '/', 1) ELSE '_root' END"


@query(f"SELECT id, md5({NORMAL}) AS h, length({NORMAL}) AS n FROM ged_documents WHERE extracted_text IS NOT NULL")
def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    t = T.normalize_whitespace("extracted_text")
    return spread(ged(spark, d).where("extracted_text is not null").select("id", "extracted_text")).select("id", F.md5(t).alias("h"), F.length(t).cast("long").alias("n"))


@query("SELECT id, length(extracted_text) > 0 AND length(regexp_replace(extracted_text, '[^\\p{L}]', '', 'g')) / greatest(1, length(extracted_text)) < 0.2 AS garbled FROM ged_documents WHERE extracted_text IS NOT NULL")
def garbled_flag(spark: SparkSession, d: str) -> DataFrame:
    return ged(spark, d).where("extracted_text is not null").select("id", T.looks_garbled("extracted_text").alias("garbled"))


@query(f"""
    WITH t AS (SELECT id, list_filter(list_transform(string_split(extracted_text, chr(10)), lambda x: {_strip('x')}), lambda x: length(x) > 0) AS b,
        list_filter(list_transform(string_split(upper(file_name) || chr(10) || file_name || chr(10) || coalesce(content_hash, ''), chr(10)), lambda x: {_strip('x')}), lambda x: length(x) > 0) AS a
        FROM ged_documents WHERE length({_strip('extracted_text')}) > 0),
    u AS (SELECT id, b, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM t),
    f AS (SELECT id, first(x ORDER BY i) AS x, min(i) AS i FROM u WHERE NOT list_contains(list_transform(b, lambda y: lower(y)), lower(x)) GROUP BY id, lower(x)),
    g AS (SELECT id, string_agg(x, chr(10) ORDER BY i) AS more FROM f GROUP BY id)
    SELECT t.id, length({_strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(t.b, chr(10)) || coalesce(chr(10) || g.more, ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0b]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS n, md5({_strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(t.b, chr(10)) || coalesce(chr(10) || g.more, ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0b]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS h
    FROM t LEFT JOIN g USING (id)""")
def merge_layers(spark: SparkSession, d: str) -> DataFrame:
    rows = ged(spark, d).where(F.length(T.strip("extracted_text")) > 0)
    more = F.concat(F.upper("file_name"), F.lit("\n"), F.col("file_name"), F.lit("\n"), F.coalesce("content_hash", F.lit("")))
    merged = T.merge_text_layers("extracted_text", more)
    return rows.select("id", F.length(merged).cast("long").alias("n"), F.md5(merged).alias("h"))


@query(f"SELECT t AS term, count(*) AS n, count(DISTINCT id) AS rows FROM (SELECT id, unnest(list_filter(regexp_extract_all(lower(extracted_text), '{T.TOKEN}'), lambda x: x NOT IN ({STOP}))) AS t FROM ged_documents) GROUP BY t")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    per = spread(ged(spark, d).select("id", "extracted_text")).select("id", F.explode(T.tokenize("extracted_text")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    return per.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("rows"))


@query(r"SELECT history_id, array_to_string(list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}\p{M}_]+'), lambda x: length(x) > 1), ' ') AS terms FROM search_history GROUP BY ALL")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_history").select("history_id", F.array_join(T.query_terms("query"), " ").alias("terms")).distinct()


@query(f"SELECT {CATEGORY} AS category, count(*) AS n FROM ged_documents GROUP BY 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.category_counts(ged(spark, d))


@query("SELECT id, contains(lower(extracted_text), 'relevé trimestriel') OR (contains(lower(extracted_text), 'relevé') AND contains(lower(extracted_text), 'trimestriel')) AS exact FROM ged_documents WHERE extracted_text IS NOT NULL")
def exact_match_flag(spark: SparkSession, d: str) -> DataFrame:
    q = F.lit("Relevé trimestriel")
    low = F.lower("extracted_text")
    return ged(spark, d).where("extracted_text is not null").select("id", (T.contains_phrase(low, q) | T.contains_all_terms(low, T.query_terms(q))).alias("exact"))


@query(f"""
    WITH p AS (SELECT id, extracted_text AS t, list_min(list_filter([instr(lower(extracted_text), 'taux'), instr(lower(extracted_text), 'intérêt')], lambda x: x > 0)) AS p FROM ged_documents WHERE extracted_text IS NOT NULL),
    s AS (SELECT id, t, p, greatest(0, p - 1 - 90) AS a, least(length(t), greatest(0, p - 1 - 90) + 240) AS b FROM p)
    SELECT id, CASE WHEN p IS NULL THEN substr(t, 1, 240) ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || {_strip('substr(t, a + 1, b - a)')} || CASE WHEN b < length(t) THEN '…' ELSE '' END END AS preview FROM s""")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return ged(spark, d).where("extracted_text is not null").select("id", T.text_preview("extracted_text", T.query_terms(F.lit("Taux intérêt"))).alias("preview"))


@query(f"SELECT history_id, substr(sha256(lower({_strip('query')}) || '|' || top_k || '|' || coalesce(category, '') || '|' || coalesce(file_type, '')), 1, 16) AS k FROM search_history GROUP BY ALL")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_history").select("history_id", T.cache_key(F.col("query"), F.col("top_k"), F.col("category"), F.col("file_type")).alias("k")).distinct()


@query(rf"""SELECT id, lower({_strip('email')}) AS email, array_to_string(list_transform(list_filter(regexp_split_to_array({_strip('full_name')}, '\s+'), lambda x: length(x) > 0)[1:2], lambda x: upper(x[1])), '') AS initials,
    sha256(password_hash) AS token, CAST(length(password_hash) >= 8 AS INT) + CAST(length(password_hash) >= 12 AS INT) + CAST(regexp_matches(password_hash, '[a-z]') AND regexp_matches(password_hash, '[A-Z]') AS INT) + CAST(regexp_matches(password_hash, '[0-9]') AND regexp_matches(password_hash, '[^A-Za-z0-9]') AS INT) AS strength,
    length(password_hash) >= 8 AND regexp_matches(password_hash, '\p{{L}}') AND regexp_matches(password_hash, '\p{{Nd}}') AS accepted FROM users""")
def account_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "users").select("id", T.normalize_email("email").alias("email"), T.initials("full_name").alias("initials"), F.sha2("password_hash", 256).alias("token"), T.password_score("password_hash").alias("strength"), T.password_accepted("password_hash").alias("accepted"))


@query("SELECT id, md5(regexp_replace(extracted_text, '(lot|trois)', '<mark>\\1</mark>', 'gi')) AS h FROM ged_documents WHERE extracted_text IS NOT NULL")
def highlight_terms(spark: SparkSession, d: str) -> DataFrame:
    return ged(spark, d).where("extracted_text is not null").select("id", F.md5(T.highlight("extracted_text", "lot trois")).alias("h"))


@query(r"""SELECT id, upper(regexp_replace(file_type, '^\.', '')) AS label, CAST(make_timestamp(CASE WHEN n >= 1000000000000 THEN n // 1000 ELSE n END * 1000000) AS DATE)::VARCHAR AS modified_on, regexp_replace(file_name, '[^\p{L}\p{N}_-]', '_', 'g') AS safe,
    lower(regexp_extract(relative_path, '(\.[^./\\]+)$', 1)) AS suffix, lower(regexp_extract(relative_path, '(\.[^./\\]+)$', 1)) IN ('.pdf','.gif','.png','.jpg','.jpeg','.bmp','.tiff','.webp','.docx','.pptx','.xlsx') AS supported
    FROM (SELECT *, TRY_CAST(nullif(regexp_extract(modified_at, '^(\d+)(?:\.\d+)?$', 1), '') AS BIGINT) AS n FROM ged_documents)""")
def file_labels(spark: SparkSession, d: str) -> DataFrame:
    return ged(spark, d).select("id", T.file_type_label("file_type").alias("label"), T.epoch_date("modified_at").cast("string").alias("modified_on"), T.safe_name("file_name").alias("safe"), T.file_suffix("relative_path").alias("suffix"), T.is_supported("relative_path").alias("supported"))


@query("""SELECT id, ' — user: ' || coalesce(nullif(full_name, ''), nullif(email, ''), '?') || CASE WHEN email <> '' AND email <> coalesce(nullif(full_name, ''), nullif(email, ''), '?') THEN ' (' || email || ')' ELSE '' END AS suffix FROM users""")
def log_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "users").select("id", T.user_suffix("full_name", "email").alias("suffix"))


@query("SELECT event_id, CASE WHEN value >= 500 THEN 'ERROR' WHEN value >= 400 THEN 'WARNING' ELSE 'INFO' END AS level FROM events")
def log_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.log_level("value").alias("level"))


# --- passages and the lexical index -------------------------------------------------------------------------------

_PY = _strip
CHUNKS = f"""
    WITH RECURSIVE src AS (SELECT id, relative_path, {_strip('extracted_text')} AS t FROM ged_documents WHERE length({_strip('extracted_text')}) > 0),
    w AS (
        SELECT id, 0 AS st, length(t) AS n FROM src
        UNION ALL
        SELECT x.id, greatest(x.e - 150, x.st + 1), x.n FROM (
            SELECT w.id, w.st, w.n, CASE WHEN w.st + 900 >= w.n OR w.n <= 900 THEN w.n
                WHEN instr(reverse(replace(substr(s.t, w.st + 151, 750), chr(13), 'x')), chr(10)) > 0 THEN w.st + 900 - instr(reverse(replace(substr(s.t, w.st + 151, 750), chr(13), 'x')), chr(10)) ELSE w.st + 900 END AS e
            FROM w JOIN src s USING (id)) x WHERE x.e < x.n),
    cut AS (SELECT w.id, s.relative_path, w.st, {_strip('''substr(s.t, w.st + 1, CASE WHEN w.st + 900 >= w.n OR w.n <= 900 THEN w.n
                WHEN instr(reverse(replace(substr(s.t, w.st + 151, 750), chr(13), 'x')), chr(10)) > 0 THEN w.st + 900 - instr(reverse(replace(substr(s.t, w.st + 151, 750), chr(13), 'x')), chr(10)) ELSE w.st + 900 END - w.st)''')} AS text
        FROM w JOIN src s USING (id)),
    numbered AS (SELECT id, relative_path, CAST(row_number() OVER (PARTITION BY id ORDER BY st) - 1 AS INT) AS chunk_no, text FROM cut WHERE length(text) > 0),
    chunks AS (SELECT row_number() OVER (ORDER BY {CATEGORY}, relative_path, id, chunk_no) AS chunk_id, {CATEGORY} AS category, n.* FROM numbered n)"""
LEXICAL = f"""{CHUNKS},
    tok AS (SELECT chunk_id, list_filter(regexp_extract_all(lower(text), '{T.TOKEN}'), lambda x: x NOT IN ({STOP})) AS toks FROM chunks),
    stats AS (SELECT count(*) AS n, coalesce(sum(len(toks)), 0) / greatest(1, count(*)) AS avgdl FROM tok),
    post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM tok) GROUP BY 1, 2),
    dft AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post CROSS JOIN stats GROUP BY term)"""
# A batch of queries: id, text, top_k, category, file type, chunk of `shard` whose vector stands for the query's.
BATCH = [
    (1, "relevé trimestriel", 5, None, None, 3), (2, "franchise contractuelle en cours de révision", 10, None, None, 20), (3, "taux d'intérêt", 5, "Banque", None, 45),
    (4, "délai de carence", 5, None, ".docx", 70), (5, "?", 5, None, None, 3), (6, "registre relié copie certifiée", 20, None, ".pdf", 95),
]
_Q = "q(qid, query, top_k, category, file_type) AS (VALUES " + ", ".join(f"({i}, {s!r}, {k}, {'NULL' if c is None else repr(c)}, {'NULL' if t is None else repr(t)})" for i, s, k, c, t, _ in BATCH).replace('"', "'").replace("'taux d'intérêt'", "'taux d''intérêt'") + ")"
SCORES = f"""{LEXICAL}, {_Q},
    qt AS (SELECT DISTINCT qid, unnest(list_filter(regexp_extract_all(lower(query), '{T.TOKEN}'), lambda x: x NOT IN ({STOP}))) AS term FROM q),
    sc AS (SELECT qid, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM post JOIN qt USING (term) JOIN dft USING (term) CROSS JOIN stats GROUP BY 1, 2)"""


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id (in the order of category, path, number), category, id, relative_path, file_name, file_type, chunk_no, text."""
    rows = ged(spark, d).select("id", "relative_path", "file_name", "file_type", T.category_of("relative_path").alias("category"), F.col("extracted_text").alias("text")).where(F.length("text") > 0)
    return number_rows(explode_passages(spread(rows), "text"), ["category", "relative_path", "id", "chunk_no"], "chunk_id")


def queries_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([x[:5] for x in BATCH], "qid long, query string, top_k int, category string, file_type string")


@query(CHUNKS + " SELECT id, chunk_no, md5(text) AS h, length(text) AS n FROM chunks")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = ged(spark, d).select("id", F.col("extracted_text").alias("text")).where(F.length("text") > 0)
    return explode_passages(spread(rows), "text").select("id", "chunk_no", F.md5("text").alias("h"), F.length("text").cast("long").alias("n"))


@query(CHUNKS + " SELECT chunk_id, id, chunk_no FROM chunks")
def chunk_numbers(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", "id", "chunk_no")


@query(LEXICAL + " SELECT chunk_id, term, tf FROM post")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_index(chunks_of(spark, d)).postings.select("chunk_id", "term", "tf")


@query(LEXICAL + " SELECT term, df, round(idf, 6) AS idf FROM dft")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_index(chunks_of(spark, d)).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(LEXICAL + " SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_index(chunks_of(spark, d)).corpus_stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(SCORES + " SELECT qid, chunk_id, round(score, 6) AS score FROM sc")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25_scores(lexical.build_index(chunks_of(spark, d)), queries_of(spark)).select(F.col("qid").cast("int").alias("qid"), "chunk_id", F.round("score", 6).alias("score"))


# --- vectors ------------------------------------------------------------------------------------------------------

EMB = "(SELECT vec_id AS chunk_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
ASK = (0, 1, 2, 3)


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    rows = table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return rows, [(r[0], list(map(float, r[1]))) for r in rows.where(F.col("chunk_id").isin(*ASK)).select("chunk_id", "embedding").collect()]


_COS = f"c AS (SELECT q.chunk_id AS qid, e.chunk_id, e.label, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 9) AS cosine FROM {EMB} e, {EMB} q WHERE q.chunk_id IN (0, 1, 2, 3))"


@query(f"SELECT chunk_id AS vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)) * x / sqrt(list_dot_product(v, v)))), 6) AS squared, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM {EMB}")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = vector.l2_normalize("embedding")
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"), F.round(F.col("v")[0], 6).alias("first"))


@query(f"WITH {_COS} SELECT qid, chunk_id, round(cosine, 6) AS cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, chunk_id) AS INT) AS rank FROM c) WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _asked(spark, d)
    return vector.top_k(vector.cosines(rows, asked, "embedding", ["chunk_id", "label"]), 10, ["qid"]).select("qid", "chunk_id", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"WITH {_COS} SELECT qid, label, chunk_id, round(cosine, 6) AS cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, label ORDER BY cosine DESC, chunk_id) AS INT) AS rank FROM c) WHERE rank <= 5")
def dense_topk_per_shard(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _asked(spark, d)
    return vector.top_k(vector.cosines(rows, asked, "embedding", ["chunk_id", "label"]), 5, ["qid", "label"]).select("qid", "label", "chunk_id", F.round("cosine", 6).alias("cosine"), "rank")


# Every row whose id is divisible by 50 asks all rows. Cosines stay at nine digits: rounding them twice splits the two engines at a half.
_COS_50 = _COS.replace("q.chunk_id IN (0, 1, 2, 3)", "q.chunk_id % 50 = 0")


def _asked_50(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    rows = table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return rows, [(r[0], r[1]) for r in rows.where("chunk_id % 50 = 0").select("chunk_id", "embedding").collect()]


@query(f"WITH {_COS_50} SELECT qid, chunk_id, cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, chunk_id) AS INT) AS rank FROM c) WHERE rank <= 10")
def dense_topk_50(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _asked_50(spark, d)
    return vector.top_k(vector.best_cosines(rows, asked, "embedding", ["chunk_id"], 10), 10, ["qid"]).select("qid", "chunk_id", "cosine", "rank")


@query(f"WITH {_COS_50} SELECT qid, label, chunk_id, cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, label ORDER BY cosine DESC, chunk_id) AS INT) AS rank FROM c) WHERE rank <= 5")
def dense_topk_per_shard_50(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _asked_50(spark, d)
    return vector.top_k(vector.best_cosines(rows, asked, "embedding", ["chunk_id", "label"], 5, "label"), 5, ["qid", "label"]).select("qid", "label", "chunk_id", "cosine", "rank")


@query("SELECT count(*) AS rows, count(DISTINCT chunk_id) AS chunks FROM shard WHERE len(chunk_vectors) = 384 AND len(list_filter(chunk_vectors, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(chunk_vectors, lambda x: x <> 0)) > 0".replace("count(*)", "count(DISTINCT chunk_id)"))
def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector.usable_vectors(table(spark, d, "shard"), 384).agg(F.count("*").alias("rows"), F.count_distinct("chunk_id").alias("chunks"))


TOKENS = lambda x: f"list_filter(regexp_extract_all(lower({x}), '{T.TOKEN}'), lambda x: x NOT IN ({STOP}))"
BUCKETS = lambda x: f"list_transform({TOKENS(x)}, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 64)"


@query(f"""WITH t AS (SELECT id, {BUCKETS('extracted_text')} AS b FROM ged_documents WHERE length(extracted_text) > 0),
    c AS (SELECT id, bucket, count(*) AS n FROM (SELECT id, unnest(b) AS bucket FROM t) GROUP BY 1, 2)
    SELECT id, CAST(bucket AS INT) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM c""")
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = ged(spark, d).where(F.length("extracted_text") > 0).select("id", F.posexplode(vector.hash_embedding("extracted_text")).alias("bucket", "value"))
    return rows.where("value <> 0").select("id", "bucket", F.round("value", 6).alias("value"))


@query()
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate top-k by lists; the tests measure its recall."""
    rows, asked = _asked_50(spark, d)
    return vector.nearest_by_lists(rows, asked, "embedding", 10).select("qid", "chunk_id", "cosine", "rank")


# --- hybrid search ------------------------------------------------------------------------------------------------

GOOD = "len(chunk_vectors) = 384 AND len(list_filter(chunk_vectors, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(chunk_vectors, lambda x: x <> 0)) > 0"
_ASKED = "qv(qid, vc) AS (VALUES " + ", ".join(f"({b[0]}, {b[5]})" for b in BATCH) + ")"
DENSE = f"""{SCORES}, {_ASKED},
    sh AS (SELECT chunk_id AS vc, any_value(relative_path) AS relative_path, any_value(chunk_no) AS chunk_no, list_transform(any_value(chunk_vectors), lambda x: CAST(x AS DOUBLE)) AS v FROM shard WHERE {GOOD} GROUP BY 1),
    vec AS (SELECT c.chunk_id, c.category, s.v FROM chunks c JOIN sh s ON s.relative_path = c.relative_path AND s.chunk_no = c.chunk_no),
    ask AS (SELECT qid, v FROM qv JOIN sh USING (vc)),
    cosv AS (SELECT a.qid, e.chunk_id, e.category, round(list_dot_product(a.v, e.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(e.v, e.v)), 9) AS cosine FROM vec e, ask a),
    den0 AS (SELECT c.*, row_number() OVER (PARTITION BY c.qid, c.category ORDER BY cosine DESC, chunk_id) AS r, greatest(40, 4 * q.top_k) AS m FROM cosv c JOIN q USING (qid) WHERE q.category IS NULL OR q.category = c.category),
    den AS (SELECT qid, chunk_id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, chunk_id) AS dr FROM den0 WHERE r <= m),
    lex0 AS (SELECT q.qid, c.chunk_id, coalesce(s.score, 0) AS score, greatest(40, 4 * q.top_k) AS m FROM q CROSS JOIN chunks c LEFT JOIN sc s ON s.qid = q.qid AND s.chunk_id = c.chunk_id),
    lex1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS lr, max(score) OVER (PARTITION BY qid) AS ref FROM lex0),
    lex AS (SELECT qid, chunk_id, lr FROM lex1 WHERE lr <= m)"""
FUSED = f"""{DENSE},
    term AS (SELECT qid, lower(query) AS ql, list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: length(x) > 1) AS terms FROM q),
    ex AS (SELECT qid, chunk_id, contains(lower(text), ql) AS ph, contains(lower(text), ql) OR len(list_filter(terms, lambda t: NOT contains(lower(text), t))) = 0 AS ex,
        contains(lower(text), ql) OR (len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains(lower(text), t))) = 0) AS inj FROM term CROSS JOIN chunks),
    f0 AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0) AS v, coalesce(cosine, 0) AS cosine FROM den d FULL OUTER JOIN lex l ON d.qid = l.qid AND d.chunk_id = l.chunk_id),
    f1 AS (SELECT f0.qid, f0.chunk_id, v * CASE WHEN ex THEN 2 ELSE 1 END AS v, cosine, ph, ex, 0 AS pass FROM f0 JOIN ex USING (qid, chunk_id)
        UNION ALL SELECT e.qid, e.chunk_id, 2.0::DOUBLE / (60 + least((SELECT n FROM stats), greatest(40, 4 * q.top_k))), 0, ph, TRUE, 1 FROM ex e JOIN q USING (qid) WHERE inj AND NOT EXISTS (SELECT 1 FROM f0 WHERE f0.qid = e.qid AND f0.chunk_id = e.chunk_id)),
    it AS (SELECT f1.*, c.relative_path, c.category AS cat, c.id, CASE WHEN l.ref > 0 THEN l.score / l.ref ELSE 0 END AS lx, l.ref FROM f1 JOIN chunks c USING (chunk_id) JOIN lex1 l ON l.qid = f1.qid AND l.chunk_id = f1.chunk_id)"""
HYBRID = f"""{FUSED},
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid, relative_path ORDER BY v DESC, pass, chunk_id) AS rn, row_number() OVER (PARTITION BY qid ORDER BY pass, chunk_id) AS ord FROM it),
    dx AS (SELECT *, bool_or(ex) OVER w AS dex, bool_or(ex AND rn <= 3) OVER w AS top, min(CASE WHEN ph THEN rn END) OVER w AS prn, min(ord) OVER w AS ford FROM rk WINDOW w AS (PARTITION BY qid, relative_path)),
    ag AS (SELECT qid, relative_path, any_value(cat) AS cat, any_value(id) AS id, any_value(dex) AS dex, min(ford) AS ford, avg(v) AS mean, max(cosine) AS score, max(lx) AS blx, max(ref) AS ref, min(CASE WHEN rn = 1 THEN chunk_id END) AS chunk_id FROM dx WHERE rn <= 3 OR (dex AND NOT top AND rn = prn) GROUP BY 1, 2),
    rel AS (SELECT ag.*, g.file_name, g.file_type, CASE WHEN dex THEN mean * 3 ELSE mean END AS aggregated,
        100 * CASE WHEN ref > 0 THEN (greatest(0, least(1, (score - 0.1) / 0.65)) + greatest(0, least(1, blx))) / 2 ELSE greatest(0, least(1, (score - 0.1) / 0.65)) END AS rv FROM ag JOIN ged_documents g ON g.id = ag.id),
    pass AS (SELECT rel.*, q.top_k, row_number() OVER (PARTITION BY rel.qid ORDER BY round(aggregated, 12) DESC, ford) AS rank FROM rel JOIN q USING (qid) WHERE (dex OR score >= 0.3) AND (q.file_type IS NULL OR q.file_type = rel.file_type) AND (q.category IS NULL OR q.category = rel.cat))"""


def search_index(spark: SparkSession, d: str) -> fusion.SearchIndex:
    """The index of the catalogue. Passages are written once; in production all of it is stored and loaded."""
    chunks = write_shared(chunks_of(spark, d), "chunks")
    shard = vector.usable_vectors(table(spark, d, "shard"), 384).select("relative_path", "chunk_no", F.col("chunk_vectors").alias("vector"))
    vectors = chunks.select("chunk_id", "category", "relative_path", "chunk_no").join(shard, ["relative_path", "chunk_no"]).select("chunk_id", "category", "vector")
    built = lexical.build_index(chunks)
    path = new_table_path(spark, "postings")
    lexical.bucketed(built.postings).write.partitionBy("bucket").parquet(path)
    return fusion.SearchIndex(chunks, vectors, lexical.LexicalIndex(spark.read.parquet(path), built.term_stats, built.corpus_stats))


def text_index(spark: SparkSession, d: str) -> fusion.SearchIndex:
    """The same index with vectors of the hashing model instead of the stored ones, for searches by text."""
    index = search_index(spark, d)
    vectors = write_shared(with_embedding(index.chunks, "text").select("chunk_id", "category", "vector"), "vectors")
    return fusion.SearchIndex(index.chunks, vectors, index.lexical)


def query_vectors(spark: SparkSession, d: str) -> list[tuple[int, list[float]]]:
    wanted = {b[5] for b in BATCH}
    rows = vector.usable_vectors(table(spark, d, "shard").where(F.col("chunk_id").isin(*wanted)), 384).select("chunk_id", "chunk_vectors").collect()
    known = {r[0]: list(map(float, r[1])) for r in rows}
    return [(b[0], known[b[5]]) for b in BATCH if b[5] in known]


@query(DENSE + " SELECT qid, chunk_id, round(cosine, 6) AS cosine, dr AS dense_rank FROM den")
def dense_rerank(spark: SparkSession, d: str) -> DataFrame:
    found = fusion.dense_ranks(search_index(spark, d), queries_of(spark), query_vectors(spark, d))
    return found.select(F.col("qid").cast("int").alias("qid"), "chunk_id", F.round("cosine", 6).alias("cosine"), F.col("dense_rank").cast("long").alias("dense_rank"))


@query(DENSE + " SELECT qid, chunk_id, lr AS lexical_rank, round(score, 6) AS score, round(ref, 6) AS lexical_ref FROM lex1 WHERE lr <= m")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    index, q = search_index(spark, d), queries_of(spark)
    found = fusion.lexical_ranks(index, q, lexical.bm25_scores(index.lexical, q))
    return found.select(F.col("qid").cast("int").alias("qid"), "chunk_id", F.col("lexical_rank").cast("long").alias("lexical_rank"), F.round("score", 6).alias("score"), F.round("lexical_ref", 6).alias("lexical_ref"))


@query(FUSED + " SELECT qid, chunk_id, round(v, 9) AS value, pass, ex AS exact, ph AS phrase, round(lx, 6) AS lex FROM it")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    index, q = search_index(spark, d), queries_of(spark)
    scores = write_shared(lexical.bm25_scores(index.lexical, q), "scores")
    fused = fusion.fuse(index, q, fusion.dense_ranks(index, q, query_vectors(spark, d)), fusion.lexical_ranks(index, q, scores), scores, index.chunks.count())
    return fused.select(F.col("qid").cast("int").alias("qid"), "chunk_id", F.round("value", 9).alias("value"), "pass", "exact", "phrase", F.round("lex", 6).alias("lex"))


def _searched(spark: SparkSession, d: str) -> DataFrame:
    return fusion.hybrid_search(search_index(spark, d), queries_of(spark), query_vectors(spark, d))


@query(HYBRID + " SELECT qid, CAST(rank AS INT) AS rank, relative_path, file_name, file_type, cat AS category, round(score, 6) AS score, round(aggregated, 6) AS aggregated, round(CASE WHEN dex THEN greatest(rv, 90) ELSE rv END, 4) AS relevance FROM pass WHERE rank <= top_k")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d).select(F.col("qid").cast("int").alias("qid"), "rank", "relative_path", "file_name", "file_type", "category", F.round("score", 6).alias("score"), F.round("aggregated", 6).alias("aggregated"), F.round("relevance", 4).alias("relevance"))


PREVIEWED = f"""{HYBRID},
    shown AS (SELECT p.*, c.text, list_min(list_filter(list_transform(t.terms, lambda y: instr(lower(c.text), y)), lambda y: y > 0)) AS spot FROM pass p JOIN chunks c USING (chunk_id) JOIN term t ON t.qid = p.qid WHERE rank <= top_k),
    clip AS (SELECT *, greatest(0, spot - 1 - 90) AS a, least(length(text), greatest(0, spot - 1 - 90) + 240) AS b FROM shown)
    SELECT file_name, cat AS category, file_type, round(score, 4) AS score, round(aggregated, 6) AS aggregated, round(CASE WHEN dex THEN greatest(rv, 90) ELSE rv END, 1) AS relevance_pct,
        CASE WHEN spot IS NULL THEN substr(text, 1, 240) ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || {_strip('substr(text, a + 1, b - a)')} || CASE WHEN b < length(text) THEN '…' ELSE '' END END AS text_preview FROM clip"""


@query(PREVIEWED)
def search_export(spark: SparkSession, d: str) -> DataFrame:
    return export_rows(_searched(spark, d))


@query(HYBRID + ", best AS (SELECT qid, max(aggregated) AS b FROM pass WHERE rank <= top_k GROUP BY 1) SELECT qid, CAST(rank AS INT) AS rank, round(round(aggregated / b * 1000) / 10, 1) AS relative FROM pass JOIN best USING (qid) WHERE rank <= top_k")
def relative_scores(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.relative_scores(_searched(spark, d)).select(F.col("qid").cast("int").alias("qid"), "rank", F.round("relative", 1).alias("relative"))


ASKED_TEXTS = [(i, q, 1, None, None) for i, q in fusion.suggestion_queries(["relevé", "caution", "trimestriel"])]
_VECTOR = lambda x: f"list_transform(range(64), lambda y: CAST(len(list_filter({BUCKETS(x)}, lambda z: z = y)) AS DOUBLE))"


def by_text(sql: str, asked: list[tuple]) -> str:
    """The SQL of a hybrid search with other queries, and vectors of the hashing model on both sides."""
    values = "q(qid, query, top_k, category, file_type) AS (VALUES " + ", ".join(f"({i}, '{q}', {k}, NULL::VARCHAR, NULL::VARCHAR)" for i, q, k, _, _ in asked) + ")"
    parts = {
        _Q: values,
        sql[sql.index("vec AS (SELECT c.chunk_id"): sql.index("ask AS (")]: f"vec AS (SELECT chunk_id, category, {_VECTOR('text')} AS v FROM chunks),\n    ",
        "ask AS (SELECT qid, v FROM qv JOIN sh USING (vc))": f"ask AS (SELECT qid, {_VECTOR('query')} AS v FROM q)",
        "/ sqrt(list_dot_product(a.v, a.v) * list_dot_product(e.v, e.v)), 9)": "/ greatest(1e-300, sqrt(list_dot_product(a.v, a.v) * list_dot_product(e.v, e.v))), 9)",
    }
    for old, new in parts.items():
        assert old in sql
        sql = sql.replace(old, new)
    return sql


@query(by_text(HYBRID, ASKED_TEXTS) + " SELECT q.query AS term, file_name, relative_path, round(score, 6) AS score FROM pass JOIN q USING (qid) WHERE rank = 1 ORDER BY pass.score DESC, qid LIMIT 3")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    return search.suggest(spark, text_index(spark, d), "relevé caution trimestriel").withColumn("score", F.round("score", 6))


TEXTS = [(i, q, k, None, None) for i, q, k, _, _, _ in BATCH if "'" not in q]


@query(by_text(HYBRID, TEXTS) + " SELECT qid, CAST(rank AS INT) AS rank, relative_path, round(score, 6) AS score, round(aggregated, 6) AS aggregated FROM pass WHERE rank <= top_k")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    """The batch searched by its texts alone."""
    found = search.search_texts(spark, text_index(spark, d), TEXTS)
    return found.select(F.col("qid").cast("int").alias("qid"), "rank", "relative_path", F.round("score", 6).alias("score"), F.round("aggregated", 6).alias("aggregated"))


EXPECTED = "e(qid, expected_cat, expected_name) AS (VALUES (1, 'banque', 'releve'), (2, 'assur', 'police'), (3, 'banque', 'mandat'), (4, 'paie', 'note'), (5, 'scans', 'lot'), (6, 'scans', 'registre'))"


def expected_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "banque", "releve"), (2, "assur", "police"), (3, "banque", "mandat"), (4, "paie", "note"), (5, "scans", "lot"), (6, "scans", "registre")], "qid long, expected_cat string, expected_name string")


GRADED = HYBRID + f""", {EXPECTED}, fit AS (SELECT e.qid, p.rank, coalesce(contains(lower(p.cat), e.expected_cat) OR contains(lower(p.file_name), e.expected_name), FALSE) AS ok FROM e LEFT JOIN (SELECT * FROM pass WHERE rank <= top_k AND rank <= 5) p ON p.qid = e.qid),
    graded AS (SELECT qid, CASE WHEN coalesce(bool_or(ok AND rank = 1), FALSE) THEN 'PASS' WHEN bool_or(ok) THEN 'PARTIAL' ELSE 'FAIL' END AS grade FROM fit GROUP BY qid)"""


@query(GRADED + " SELECT qid, grade FROM graded")
def graded_queries(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grade(_searched(spark, d), expected_of(spark)).select(F.col("qid").cast("int").alias("qid"), "grade")


@query(HYBRID + f""", {EXPECTED} SELECT e.qid, CASE WHEN coalesce(contains(lower(p.cat), e.expected_cat) OR contains(lower(p.file_name), e.expected_cat), FALSE) THEN 'PASS' WHEN p.rank IS NOT NULL THEN 'PARTIAL' ELSE 'FAIL' END AS grade
    FROM e LEFT JOIN (SELECT * FROM pass WHERE rank = 1) p ON p.qid = e.qid""")
def graded_by_category(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grade_category(_searched(spark, d), expected_of(spark)).select(F.col("qid").cast("int").alias("qid"), "grade")


LATENCIES = ", ".join(f"({b[0]}, {20.0 + 7 * (b[0] % 4)}::DOUBLE)" for b in BATCH)


@query(HYBRID + f""", lat(qid, ms) AS (VALUES {LATENCIES}), got AS (SELECT qid, count(*) AS n, max(aggregated) AS best FROM pass WHERE rank <= top_k GROUP BY 1),
    v AS (SELECT list_sort(list(ms)) AS v, avg(ms) AS a, sum(ms) AS t, count(*) AS n, median(ms) AS m FROM lat)
    SELECT 0 AS line_no, 'avg_latency_ms' AS name, printf('%.2f', a) AS text FROM v UNION ALL SELECT 1, 'median_latency_ms', printf('%.2f', m) FROM v UNION ALL SELECT 2, 'p95_latency_ms', printf('%.2f', v[CAST(least(n - 1, floor(n * 0.95)) AS INT) + 1]) FROM v
    UNION ALL SELECT 3, 'p99_latency_ms', printf('%.2f', v[CAST(least(n - 1, floor(n * 0.99)) AS INT) + 1]) FROM v UNION ALL SELECT 4, 'total_latency_ms', printf('%.2f', t) FROM v
    UNION ALL SELECT CAST(q.qid + 5 AS INT), q.query, coalesce(n, 0) || ',' || printf('%.2f', ms) || ',' || printf('%.4f', coalesce(best, 0)) FROM q JOIN lat USING (qid) LEFT JOIN got USING (qid)""")
def benchmark_csv(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a benchmark file on the batch, with latencies that are given, so that they can be compared."""
    got = _searched(spark, d).groupBy("qid").agg(F.count("*").alias("results_count"), F.max("aggregated").alias("best_score"))
    times = spark.createDataFrame([(b[0], 20.0 + 7 * (b[0] % 4)) for b in BATCH], "qid long, latency_ms double")
    return metrics.benchmark_report(queries_of(spark).select("qid", "query").join(times, "qid").join(got, "qid", "left").withColumn("results_count", F.coalesce("results_count", F.lit(0))))


@query(GRADED + " SELECT CASE WHEN qid <= 3 THEN 'a' ELSE 'b' END AS grp, count(*) AS n, round(100 * avg(CAST(grade = 'PASS' AS INT)), 4) AS pass_pct FROM graded GROUP BY 1")
def pass_rate_by_group(spark: SparkSession, d: str) -> DataFrame:
    graded = metrics.grade(_searched(spark, d), expected_of(spark)).withColumn("grp", F.when(F.col("qid") <= 3, "a").otherwise("b"))
    return metrics.pass_rate(graded, "grp")


@query(HYBRID + ", want(qid, expected_path) AS (SELECT q.qid, s.relative_path FROM qv q JOIN sh s USING (vc)) SELECT count(*) AS n, count(*) FILTER (p.relative_path = w.expected_path) AS right, round(count(*) FILTER (p.relative_path = w.expected_path) / count(*), 6) AS accuracy FROM want w LEFT JOIN (SELECT * FROM pass WHERE rank = 1) p USING (qid)")
def top1_accuracy(spark: SparkSession, d: str) -> DataFrame:
    want = vector.usable_vectors(table(spark, d, "shard").where(F.col("chunk_id").isin(*{b[5] for b in BATCH})), 384).select("chunk_id", F.col("relative_path").alias("expected_path"))
    asked = spark.createDataFrame([(b[0], b[5]) for b in BATCH], "qid long, chunk_id long")
    return metrics.top1_accuracy(_searched(spark, d), asked.join(want, "chunk_id").drop("chunk_id"))


# --- synchronisation ----------------------------------------------------------------------------------------------
# The stored catalogue is the one of files made before 2023; the scan holds all files but those of one category, with new
# hashes for what was updated after 2024.

OLD = f"old AS (SELECT id, relative_path, modified_at, content_hash, created_at FROM ged_documents WHERE created_at < TIMESTAMP '2023-06-01')"
NEW = f"new AS (SELECT id, relative_path, CASE WHEN updated_at >= TIMESTAMP '2024-06-01' THEN sha256(coalesce(content_hash, '')) ELSE content_hash END AS content_hash, modified_at, created_at FROM ged_documents WHERE {CATEGORY} <> 'Courriers')"
DIFF = f"""WITH {OLD}, {NEW}, diff AS (SELECT coalesce(n.relative_path, o.relative_path) AS relative_path, CASE WHEN o.relative_path IS NULL THEN 'added' WHEN n.relative_path IS NULL THEN 'deleted' WHEN n.content_hash IS DISTINCT FROM o.content_hash THEN 'updated' END AS change_type
    FROM new n FULL OUTER JOIN old o ON n.relative_path = o.relative_path)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = ged(spark, d)
    old = rows.where("created_at < timestamp '2023-06-01'").select("id", "relative_path", "modified_at", "content_hash", "created_at")
    changed = F.when(F.col("updated_at") >= F.expr("timestamp '2024-06-01'"), F.sha2(F.coalesce("content_hash", F.lit("")), 256)).otherwise(F.col("content_hash"))
    new = rows.where(T.category_of("relative_path") != "Courriers").select("id", "relative_path", changed.alias("content_hash"), "modified_at", "created_at")
    return old, new


@query(DIFF + " SELECT relative_path, change_type FROM diff WHERE change_type IS NOT NULL")
def detect_changes(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(spark, d)
    return sync.detect_changes(new, old)


@query(DIFF + f" SELECT DISTINCT {CATEGORY} AS category FROM diff WHERE change_type IS NOT NULL")
def affected_categories(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(spark, d)
    return sync.affected_categories(sync.detect_changes(new, old))


@query(f"WITH {OLD}, {NEW} SELECT n.relative_path, o.content_hash, FALSE AS todo FROM new n JOIN old o USING (relative_path) WHERE n.modified_at = o.modified_at AND o.content_hash IS NOT NULL UNION ALL SELECT n.relative_path, NULL, TRUE FROM new n LEFT JOIN old o USING (relative_path) WHERE NOT coalesce(n.modified_at = o.modified_at AND o.content_hash IS NOT NULL, FALSE)")
def hash_reuse(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(spark, d)
    kept, todo = sync.reuse_hashes(new, old)
    return kept.select("relative_path", "content_hash", F.lit(False).alias("todo")).unionByName(todo.select("relative_path", F.lit(None).cast("string").alias("content_hash"), F.lit(True).alias("todo")))


@query(f"WITH {OLD}, {NEW} SELECT coalesce(o.id, n.id) AS id, coalesce(n.relative_path, o.relative_path) AS relative_path, CASE WHEN n.relative_path IS NOT NULL THEN n.modified_at ELSE o.modified_at END AS modified_at, CASE WHEN n.relative_path IS NOT NULL THEN n.content_hash ELSE o.content_hash END AS content_hash FROM new n FULL OUTER JOIN old o ON n.relative_path = o.relative_path")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(spark, d)
    return sync.upsert(old, new).select("id", "relative_path", "modified_at", "content_hash")


@query(f"WITH {OLD}, {NEW} SELECT id, relative_path FROM old WHERE relative_path IN (SELECT relative_path FROM new)")
def delete_not_in(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(spark, d)
    return sync.delete_not_in(old, new).select("id", "relative_path")


@query("SELECT content_hash, min(id) AS first_id, count(*) AS copies FROM ged_documents WHERE content_hash IS NOT NULL GROUP BY 1")
def content_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return sync.first_of_content(ged(spark, d))


@query(CHUNKS + ", s AS (SELECT category, count(*) AS n FROM chunks GROUP BY 1) SELECT category, n, CAST(coalesce(sum(n) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s")
def shard_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = ged(spark, d).select(T.category_of("relative_path").alias("category"), F.col("extracted_text").alias("text")).where(F.length("text") > 0)
    return sync.shard_offsets(explode_passages(rows, "text"))


@query(CHUNKS + f", st AS (SELECT DISTINCT category, relative_path, chunk_no FROM shard) SELECT category, count(*) FILTER (y IS NULL) AS gone, count(*) FILTER (x IS NULL) AS missing FROM (SELECT *, 1 AS x FROM st) FULL OUTER JOIN (SELECT DISTINCT category, relative_path, chunk_no, 1 AS y FROM chunks) USING (category, relative_path, chunk_no) GROUP BY 1")
def index_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows = ged(spark, d).select("relative_path", T.category_of("relative_path").alias("category"), F.col("extracted_text").alias("text")).where(F.length("text") > 0)
    return sync.misaligned(table(spark, d, "shard"), explode_passages(rows, "text"))


@query("SELECT relative_path, min(chunk_id) AS first_position FROM shard GROUP BY 1")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return sync.ordered_distinct(table(spark, d, "shard"), "relative_path", "chunk_id")


@query(CHUNKS + f", {NEW} SELECT relative_path, chunk_no FROM chunks WHERE relative_path IN (SELECT relative_path FROM new)")
def incremental_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Passages after the changes; the tests hold it against a full rebuild."""
    old, new = snapshots(spark, d)
    texts = ged(spark, d).select("relative_path", F.col("extracted_text").alias("text")).where(F.length("text") > 0)
    changes = sync.detect_changes(new, old)
    before = explode_passages(texts.join(old.select("relative_path"), "relative_path", "left_semi"), "text")
    fresh = explode_passages(texts.join(changes.where("change_type <> 'deleted'"), "relative_path", "left_semi"), "text")
    return sync.rebuild_chunks(before, changes, fresh).select("relative_path", "chunk_no")


def _files(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """A snapshot as a scan of files whose bytes are their texts."""
    own = texts.select("relative_path", "file_name", "file_type", F.encode(F.coalesce("extracted_text", F.lit("")), "utf-8").alias("content"))
    return rows.select("relative_path", "modified_at", "content_hash").join(own, "relative_path")


def _read(files: DataFrame) -> DataFrame:
    return files.withColumn("text", F.decode("content", "utf-8"))


@query(CHUNKS + f", {NEW} SELECT chunk_no, relative_path, md5(text) AS h FROM chunks WHERE relative_path IN (SELECT relative_path FROM new)")
def synchronised_index(spark: SparkSession, d: str) -> DataFrame:
    """An index built from the old files, then synchronised with the new ones: its passages are those of the new files."""
    old, new = snapshots(spark, d)
    store = IndexStore(spark, new_table_path(spark, "index"))
    none = spark.createDataFrame([], "relative_path string, file_name string, file_type string, modified_at string, content_hash string")
    first = build.run_sync(store, _files(old, ged(spark, d)), _read, none)
    second = build.run_sync(store, _files(new, ged(spark, d)), _read, first.catalogue)
    if (first.mode, second.mode, second.error) != ("complete", "incremental", None):
        raise RuntimeError(f"{first.mode}, {second.mode}: {second.error}")
    return store.load("chunks").select("chunk_no", "relative_path", F.md5("text").alias("h"))


# --- pages and images ---------------------------------------------------------------------------------------------

# A text stands for a document: its blocks are the pages, the first line of each is an image of 20 pixels a letter, whose
# bytes are what it says.
PAGES = r"""pg AS (SELECT path, CAST(i - 1 AS INT) AS page_no, b[i] AS native FROM (SELECT id AS path, string_split_regex(extracted_text, '\n\s*\n') AS b, unnest(range(1, len(string_split_regex(extracted_text, '\n\s*\n')) + 1)) AS i FROM ged_documents WHERE length(extracted_text) > 0)),
    im AS (SELECT path, page_no, 20 * length(split_part(native, chr(10), 1)) * 20 AS area, split_part(native, chr(10), 1) AS says FROM pg)"""


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = ged(spark, d).where(F.length("extracted_text") > 0)
    own = texts.select(F.col("id").alias("path"), F.posexplode(F.split("extracted_text", r"\n\s*\n")).alias("page_no", "native"))
    says = F.substring_index("native", "\n", 1)
    images = own.select("path", "page_no", F.lit(0).alias("position"), (20 * F.length(says)).alias("width"), F.lit(20).alias("height"), F.encode(says, "utf-8").alias("image")).withColumn("fingerprint", F.md5("image"))
    return own, images


def _says(image: bytes) -> str:
    return image.decode()


_WHOLE = NORMAL.replace("extracted_text", "string_agg(native, chr(10) || chr(10) ORDER BY page_no)")


@query(f"WITH {PAGES} SELECT path, md5({_WHOLE}) AS h FROM pg WHERE length(trim(native)) > 0 GROUP BY 1")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Native texts of the pages in order, as one text."""
    return pages.native_text(_pages(spark, d)[0]).select("path", F.md5("text").alias("h"))


@query(f"WITH {PAGES} SELECT path, bool_or(area > 40000 AND page_no < 5) AS has_raster, count(*) AS n_images FROM im GROUP BY 1")
def raster_images(spark: SparkSession, d: str) -> DataFrame:
    return pages.raster_flags(_pages(spark, d)[1])


@query(f"WITH {PAGES} SELECT path, md5(says) AS fingerprint, min(page_no) AS page_no FROM im WHERE area >= 1000 GROUP BY 1, 2")
def unique_page_images(spark: SparkSession, d: str) -> DataFrame:
    return pages.unique_images(_pages(spark, d)[1]).select("path", "fingerprint", "page_no")


@query(f"WITH {PAGES} SELECT DISTINCT md5(says) AS fingerprint, says AS text FROM im WHERE area >= 1000")
def recognised_images(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct image recognised once, half of them known from a stored cache."""
    images = pages.unique_images(_pages(spark, d)[1])
    known = images.where("fingerprint < '8'").select("fingerprint", F.decode("image", "utf-8").alias("text")).distinct()
    return pages.recognise_once(images, _says, known)


@query(f"""WITH {PAGES}, nat AS (SELECT path, {_WHOLE} AS native FROM pg WHERE length(trim(native)) > 0 GROUP BY 1), fl AS (SELECT path, bool_or(area > 40000 AND page_no < 5) AS raster FROM im GROUP BY 1)
    SELECT p.path, CASE WHEN coalesce(native, '') = '' OR length(regexp_replace(native, '[^\p{{L}}]', '', 'g')) / greatest(1, length(native)) < 0.2 THEN 'C' WHEN raster THEN 'B' ELSE 'A' END AS kind FROM (SELECT DISTINCT path FROM pg) p LEFT JOIN nat USING (path) LEFT JOIN fl USING (path)""")
def document_routes(spark: SparkSession, d: str) -> DataFrame:
    """Which documents keep their text, add that of images, or are recognised as a whole."""
    own, images = _pages(spark, d)
    return pages.documents_text(own, images, _says).select("path", F.col("case").alias("kind"))


_FRAMES = "SELECT path, count(*) OVER (PARTITION BY path) AS n, page_no AS i, substr(native, 1, 40) AS says FROM pg"


@query(f"WITH {PAGES}, fr AS ({_FRAMES}), pick AS (SELECT path, says, min(i) AS i FROM fr WHERE length(says) > 0 AND (n <= 3 OR i IN (0, n // 2, n - 1)) GROUP BY 1, 2) SELECT path, md5({NORMAL.replace('extracted_text', 'string_agg(says, chr(10) || chr(10) ORDER BY i)')}) AS h FROM pick WHERE length(trim(says)) > 0 GROUP BY 1")
def animation_frames(spark: SparkSession, d: str) -> DataFrame:
    """Pages as frames of an animation: the first, middle and last are read, equal texts once."""
    own = _pages(spark, d)[0]
    sizes = own.groupBy("path").agg(F.count("*").alias("n_frames"))
    frames = own.join(sizes, "path").select("path", F.col("page_no").alias("frame_no"), "n_frames", F.substring("native", 1, 40).alias("text"))
    return pages.animation_text(frames).select("path", F.md5("text").alias("h"))


# --- catalogue, accounts, history ---------------------------------------------------------------------------------


@query("SELECT id, relative_path, file_name, file_type FROM ged_documents ORDER BY id DESC LIMIT 50 OFFSET 100")
def page_listing(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.page(ged(spark, d).select("id", "relative_path", "file_name", "file_type"), 50, 100)


@query("SELECT id, path, relative_path, file_name, file_type, modified_at, content_hash FROM ged_documents ORDER BY id")
def full_listing(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.page(ged(spark, d).select("id", "path", "relative_path", "file_name", "file_type", "modified_at", "content_hash"))


@query("SELECT id, relative_path, length(extracted_text) AS n FROM ged_documents WHERE length(extracted_text) > 0 ORDER BY id")
def listing_with_text(spark: SparkSession, d: str) -> DataFrame:
    return ged(spark, d).where(F.length("extracted_text") > 0).select("id", "relative_path", F.length("extracted_text").cast("long").alias("n")).orderBy("id")


@query("SELECT id, file_name, epoch_us(updated_at) AS updated_us FROM ged_documents ORDER BY id DESC LIMIT 5")
def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.latest(ged(spark, d).select("id", "file_name", F.unix_micros("updated_at").alias("updated_us")))


@query(f"SELECT count(*) AS documents, count(DISTINCT {CATEGORY}) AS categories, count(*) FILTER (length(extracted_text) > 0) AS with_text, epoch_us(max(updated_at)) AS last_update_us FROM ged_documents")
def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    return ged(spark, d).agg(F.count("*").alias("documents"), F.count_distinct(T.category_of("relative_path")).alias("categories"), F.count_if(F.length("extracted_text") > 0).alias("with_text"), F.unix_micros(F.max("updated_at")).alias("last_update_us"))


@query(f"SELECT id, {CATEGORY} AS category, file_name FROM ged_documents WHERE {CATEGORY} = 'Banque' ORDER BY category, id")
def filtered_listing(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.grouped_listing(ged(spark, d), "Banque").select("id", "category", "file_name")


@query(f"SELECT id, {CATEGORY} AS category, file_name FROM ged_documents ORDER BY category, id LIMIT 60")
def cumulative_cap(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.first_of_groups(ged(spark, d), 60).select("id", "category", "file_name")


@query(rf"SELECT id, path FROM ged_documents WHERE replace(relative_path, '\', '/') = (SELECT min(replace(relative_path, '\', '/')) FROM ged_documents) AND NOT regexp_matches(replace(relative_path, '\', '/'), '(^|/)\.\.(/|$)')")
def file_fetch(spark: SparkSession, d: str) -> DataFrame:
    rows = ged(spark, d).withColumn("rel", F.translate("relative_path", "\\", "/"))
    first = rows.agg(F.min("rel").alias("rel"))
    return rows.join(F.broadcast(first), "rel").where(~F.col("rel").rlike(r"(^|/)\.\.(/|$)")).select("id", "path")


@query("SELECT id, full_name FROM users WHERE lower(email) = (SELECT lower(min(email)) FROM users)")
def user_lookup(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "users")
    return users.join(F.broadcast(users.agg(F.lower(F.min("email")).alias("e"))), F.lower("email") == F.col("e")).select("id", "full_name")


@query(f"SELECT s.id AS session_id, s.user_id, s.token_hash, epoch_us(s.expires_at) AS expires_us, u.email, u.is_email_verified FROM (SELECT DISTINCT id, user_id, token_hash, expires_at FROM user_sessions WHERE expires_at >= TIMESTAMP '{NOW}') s JOIN users u ON u.id = s.user_id")
def session_user_join(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.sessions_of_users(table(spark, d, "user_sessions"), table(spark, d, "users"), F.expr(f"timestamp '{NOW}'")).select("session_id", "user_id", "token_hash", F.unix_micros("expires_at").alias("expires_us"), "email", "is_email_verified")


@query(f"SELECT id, user_id, epoch_us(expires_at) AS expires_us FROM user_sessions WHERE expires_at < TIMESTAMP '{NOW}'")
def expired_sessions(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.expired(table(spark, d, "user_sessions"), F.expr(f"timestamp '{NOW}'")).select("id", "user_id", F.unix_micros("expires_at").alias("expires_us"))


@query("SELECT id, user_id FROM user_sessions WHERE user_id NOT IN (SELECT id FROM users WHERE NOT is_email_verified)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "users").where("not is_email_verified").select(F.col("id").alias("user_id"))
    return catalogue.cascade_delete(table(spark, d, "user_sessions"), gone, "user_id").select("id", "user_id")


@query("SELECT query, top_k, history_id, searched_at FROM (SELECT *, row_number() OVER (PARTITION BY query, top_k ORDER BY searched_at DESC, history_id DESC) AS r FROM (SELECT DISTINCT history_id, query, top_k, searched_at FROM search_history)) WHERE r = 1 ORDER BY searched_at DESC, history_id DESC LIMIT 20")
def history_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.recent_searches(table(spark, d, "search_history"))


# --- metrics ------------------------------------------------------------------------------------------------------


@query("SELECT total, errors, no_result, round(coalesce(errors / nullif(total, 0), 0), 6) AS error_rate FROM (SELECT count(*) AS total, count(*) FILTER (results_count IS NULL) AS errors, count(*) FILTER (results_count = 0) AS no_result FROM (SELECT DISTINCT history_id, results_count FROM search_history))")
def search_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.search_counters(table(spark, d, "search_history"))


LAST = "(SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)"


@query(f"SELECT event_id, value FROM {LAST}")
def last_200_samples(spark: SparkSession, d: str) -> DataFrame:
    return metrics.last_samples(table(spark, d, "events")).select("event_id", "value")


@query(f"WITH s AS (SELECT list_sort(list(value)) AS v, avg(value) AS a, count(*) AS n FROM {LAST}) SELECT round(a, 2) AS avg_ms, round(v[CAST(round_even(0.95 * (n - 1), 0) AS INT) + 1], 2) AS p95_ms, round(v[CAST(round_even(0.99 * (n - 1), 0) AS INT) + 1], 2) AS p99_ms, n AS samples FROM s")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_summary(metrics.last_samples(table(spark, d, "events")))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) FILTER (r = least(n - 1, CAST(floor(n * 0.95) AS INT))) AS p95, max(value) FILTER (r = least(n - 1, CAST(floor(n * 0.99) AS INT))) AS p99 FROM o GROUP BY 1""")
def benchmark_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.benchmark_summary(table(spark, d, "events"))


_TS = "TRY_CAST(replace(searched_at, 'Z', '') AS TIMESTAMP)"


@query(f"""WITH RECURSIVE h AS (SELECT DISTINCT history_id, lower(trim(query)) || '|' || top_k || '|' || coalesce(category, '') || '|' || coalesce(file_type, '') AS key, epoch_us({_TS}) AS t FROM search_history),
    k AS (SELECT DISTINCT key, t FROM h WHERE t IS NOT NULL),
    put AS (SELECT key, min(t) AS t FROM k GROUP BY key UNION ALL SELECT p.key, min(k.t) FROM put p JOIN k ON k.key IS NOT DISTINCT FROM p.key AND k.t >= p.t + 300000000 GROUP BY p.key, p.t),
    c AS (SELECT (SELECT count(*) FROM h WHERE t IS NOT NULL) AS total, (SELECT count(*) FROM put) AS misses, (SELECT count(*) FROM h WHERE t IS NULL) AS untimed)
    SELECT total - misses AS hits, misses, round((total - misses) / total * 100, 1) AS hit_rate_pct, untimed FROM c""")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_history")
    key = F.concat_ws("|", F.lower(F.trim("query")), F.col("top_k").cast("string"), F.coalesce("category", F.lit("")), F.coalesce("file_type", F.lit("")))
    return metrics.cache_replay(h.select("history_id", key.alias("key"), F.try_to_timestamp("searched_at").alias("ts")))


@query("SELECT user_id, epoch_us(date_trunc('hour', ts)) AS window_start_us, count(*) AS calls FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.over_rate(table(spark, d, "events"), 2, "1 hour")
    return found.select("user_id", F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_start_us"), "calls")


def _syncs(events: DataFrame) -> DataFrame:
    """Events as a log of synchronisations."""
    return events.select(F.col("ts").alias("at"), F.col("event_type").alias("mode"), F.col("user_id").alias("documents_indexed"), F.col("value").alias("duration_ms"), F.when(F.col("value") > 90, "slow").alias("error"))


@query(f"""WITH h AS (SELECT count(*) AS total, count(*) FILTER (results_count IS NULL) AS errors, count(*) FILTER (results_count = 0) AS no_result FROM (SELECT DISTINCT history_id, results_count FROM search_history)),
    s AS (SELECT list_sort(list(value)) AS v, avg(value) AS a, count(*) AS n FROM {LAST}),
    y AS (SELECT count(*) AS sync_total, count(*) FILTER (value > 90) AS sync_errors, round(avg(value), 2) AS sync_avg_ms, max(struct_pack(a := ts, b := event_type, c := user_id)) AS l, max(CASE WHEN value <= 90 THEN struct_pack(a := ts, c := user_id) END) AS g FROM events)
    SELECT total, errors, no_result, round(coalesce(errors / nullif(total, 0), 0), 6) AS error_rate, round(a, 2) AS avg_ms, round(v[CAST(round_even(0.95 * (n - 1), 0) AS INT) + 1], 2) AS p95_ms, round(v[CAST(round_even(0.99 * (n - 1), 0) AS INT) + 1], 2) AS p99_ms, n AS samples,
        sync_total, sync_errors, sync_avg_ms, l.b AS last_mode, epoch_us(l.a) AS last_at_us, coalesce(g.c, 0) AS documents_indexed FROM h, s, y""")
def metrics_snapshot(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return metrics.snapshot(table(spark, d, "search_history"), events, _syncs(events)).withColumn("last_at_us", F.unix_micros(F.col("last_at").cast("timestamp"))).drop("last_at")
