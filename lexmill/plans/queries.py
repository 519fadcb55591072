"""The engine's own queries over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.udfs import hash_bucket, message_fingerprint
from ..operators import chat, clean, encode, grounded, key_store, postings, quota, retrieval, sampling, schedule, vector_index, verify
from ..session import checkpoint_folder
from ..sources import token_blocks, web
from ..streaming.clean_stream import event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The driver's texts have no CJK characters, so that rule is set to accept all.
OPTIONS = clean.CleanOptions(min_cjk_ratio=0.0)
SEARCH = "the license of the work and the terms of use"
DENSE_K = 20


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


# --- SQL that several queries share -------------------------------------------------------------------------------------------

SQL_SPACE = t.SPACE
SQL_JUDGED = rf"""
n AS (SELECT doc_id, source, trim(regexp_replace(text, '{SQL_SPACE}+', ' ', 'g'), ' ') AS text FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, CASE WHEN text = '' THEN 0.0 ELSE coalesce(list_sum(list_transform(regexp_extract_all(text, '(?i)(?:https?://|www\.)[^ ]+'), lambda x: length(x))), 0) / length(text) END AS url_ratio FROM n),
run AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) AS n FROM
        (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS island FROM
          (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM n)) GROUP BY doc_id, c, island) GROUP BY doc_id),
r AS (SELECT u.*, CASE WHEN length(text) < 20 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' WHEN url_ratio > 0.3 THEN 'url_heavy'
             WHEN longest > 16 THEN 'repeated_characters' END AS reason FROM u LEFT JOIN run USING (doc_id)),
judged AS (SELECT *, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY text, reason ORDER BY doc_id) = 1 THEN 'accepted' ELSE 'duplicate' END) AS outcome FROM r)
"""


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{t.WORD}')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+'), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{SQL_SPACE}+$', '')"


def sql_let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def sql_truncate(x: str, limit: int, name: str = "tr") -> str:
    """P12."""
    last = lambda m: f"CASE WHEN instr(reverse({name}h), {m}) > 0 THEN length({name}h) - instr(reverse({name}h), {m}) ELSE -1 END"
    cut = f"greatest({last(repr('。'))}, {last('chr(10)')}, {last(repr('.'))})"
    body = sql_let(f"substr({name}, 1, {limit})", f"{name}h", sql_let(cut, f"{name}k", sql_rstrip(f"substr({name}h, 1, CASE WHEN {name}k >= {limit // 2} THEN {name}k + 1 ELSE {limit} END)")))
    return sql_let(sql_strip(x), name, f"CASE WHEN length({name}) <= {limit} THEN {name} ELSE {body} END")


def sql_lines(x: str) -> str:
    return rf"regexp_split_to_array({x}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def sql_prose(x: str, limit: int, name: str = "pr") -> str:
    """P13."""
    kept = f"list_filter(list_transform({sql_lines(x)}, lambda {name}a: {sql_strip(f'{name}a')}), lambda {name}b: {name}b <> '' AND NOT starts_with({name}b, '#'))"
    return sql_truncate(f"array_to_string(list_transform({kept}, lambda {name}c: regexp_replace({name}c, '^[- ]+', '')), ' ')", limit, f"{name}t")


def sql_facts(x: str, limit: int) -> str:
    """P19."""
    parts = f"list_filter(string_split(translate({sql_prose(x, 4 * limit, 'fp')}, '！？', '。。'), '。'), lambda fa: {sql_strip('fa')} <> '')"
    return f"list_filter(list_transform({parts}, lambda fb: {sql_truncate('fb', limit, 'ft')}), lambda fc: fc <> '')"


def sql_headings(x: str) -> str:
    """The lines that P18 takes a topic from."""
    bare = lambda line: sql_strip(f"regexp_replace({sql_strip(line)}, '^#+', '')")
    return f"list_filter(list_transform({sql_lines(x)}, lambda ha: {bare('ha')}), lambda hb: hb <> '')"


def sql_numbers(x: str) -> str:
    """P11 for texts without the units 億, 萬 and 年: letters beyond ASCII stand as x, all else beyond ASCII as a space."""
    plain = rf"regexp_replace(regexp_replace({x}, '[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g')"
    return rf"regexp_extract_all({plain}, '(?i)\b\d+(?:[.,]\d+)?(?:%|GB|MB|tokens?)?\b')"


def sql_uniform(*keys: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(keys)}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


SQL_CONVERSATIONS = "c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'content': trim(coalesce(text, ''))} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"
SQL_VALID = "v AS (SELECT conv_id, list_filter(m, lambda x: x.role IN ('system', 'user', 'assistant') AND x.content <> '') AS m FROM c), w AS (SELECT * FROM v WHERE len(m) >= 2 AND m[-1].role = 'assistant')"


def sql_bm25(query_text: str, k: int, extra: str = "") -> str:
    return rf"""
d AS (SELECT doc_id, source, text, {sql_tokens('text')} AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM d),
q AS (SELECT unnest({sql_tokens(repr(query_text))}) AS term),
qt AS (SELECT term, count(*) AS times FROM q GROUP BY term),
tf AS (SELECT doc_id, len(toks) AS len, term, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM d) JOIN qt USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score
       FROM tf JOIN df USING (term) JOIN qt USING (term), s GROUP BY doc_id),
hits AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, source, text, score FROM sc JOIN d USING (doc_id) WHERE score > 0
         QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= {k})"""


# --- cleaning and sources --------------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_JUDGED} SELECT outcome, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM judged GROUP BY outcome")
def clean_outcomes(spark, sf_dir):
    """P2, F1, A3, A1."""
    judged = clean.outcomes(docs(spark, sf_dir), OPTIONS)
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query(f"WITH {SQL_JUDGED} SELECT doc_id, length(text) AS n_chars, sha256(text) AS digest FROM judged WHERE outcome = 'accepted'")
def clean_accepted(spark, sf_dir):
    """P2, F1, A3, P26."""
    return clean.clean_corpus(docs(spark, sf_dir), OPTIONS).select("doc_id", F.length("text").alias("n_chars"), "digest")


@query(f"WITH {SQL_JUDGED} SELECT count(*) AS input_documents, count_if(outcome = 'accepted')::BIGINT AS accepted_documents, count_if(outcome = 'duplicate')::BIGINT AS duplicate, count_if(outcome = 'too_short')::BIGINT AS too_short, sum(CASE WHEN outcome = 'accepted' THEN length(text) ELSE 0 END)::BIGINT AS accepted_characters, avg(CASE WHEN outcome = 'accepted' THEN length(text) END) AS average_accepted_characters FROM judged")
def clean_report(spark, sf_dir):
    """A1, A2, K2."""
    r = clean.report(clean.outcomes(docs(spark, sf_dir), OPTIONS))
    return r.select(*[F.coalesce(F.col("counts")[c], F.lit(0)).alias(c) for c in ("input_documents", "accepted_documents", "duplicate", "too_short")], "accepted_characters", "average_accepted_characters")


@query("SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def exact_first(spark, sf_dir):
    """A3, J4."""
    d = docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return clean.first_of_equal(d, "digest", ["doc_id"]).select("doc_id")


@query("SELECT doc_id, doc_id % 2 AS run FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id % 2, doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def incremental_dedup(spark, sf_dir):
    """The documents in two runs, the second without what the first kept."""
    d = docs(spark, sf_dir).filter("text IS NOT NULL").withColumn("run", F.pmod("doc_id", F.lit(2)))
    store = key_store.KeyStore(spark, f"{checkpoint_folder(spark)}/keys-{uuid.uuid4().hex}")
    first, second = (store.keep_new(d.filter(F.col("run") == i), key_store.digest("text"), ["doc_id"], f"r{i}") for i in (0, 1))
    return first.unionByName(second).select("doc_id", "run")


@query("""WITH w AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, n / sum(n) OVER () AS share, 500 * (n / sum(n) OVER ()) AS raw FROM w),
l AS (SELECT *, floor(raw) + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, i) <= 500 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS quota FROM s)
SELECT doc_id, d.source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) d JOIN l ON d.source = l.source WHERE rn <= quota""")
def source_quota(spark, sf_dir):
    """L1: 500 documents, each source's share in proportion to its size."""
    d = docs(spark, sf_dir).filter("source IS NOT NULL")
    counts = {r["source"]: r["count"] for r in d.groupBy("source").count().orderBy("source").collect()}
    shares = quota.largest_remainder([float(n) for n in counts.values()], 500)
    return quota.take_quotas(d, dict(zip(counts, shares, strict=True))).select("doc_id", "source")


@query("SELECT source, count(*) AS n_docs, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY source")
def source_weights(spark, sf_dir):
    """A10."""
    counts = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    return quota.normalized_weights(counts, "n_docs").withColumn("share", F.round("share", 9))


@query(r"""SELECT doc_id, length(text) AS n_chars, round(CASE WHEN text = '' THEN 0.0 ELSE length(regexp_replace(text, '[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]', '', 'g')) / length(text) END, 9) AS cjk_ratio,
round(CASE WHEN text = '' THEN 0.0 ELSE coalesce(list_sum(list_transform(regexp_extract_all(text, '(?i)(?:https?://|www\.)[^\t-\r ]+'), lambda x: length(x))), 0) / length(text) END, 9) AS url_ratio FROM documents""")
def text_metrics(spark, sf_dir):
    """P1, P4, P5."""
    return docs(spark, sf_dir).select("doc_id", F.length("text").alias("n_chars"), F.round(t.cjk_ratio("text"), 9).alias("cjk_ratio"), F.round(t.url_ratio("text"), 9).alias("url_ratio"))


@query("SELECT doc_id, CASE WHEN substr(md5(text || chr(10)), 1, 8) < '0ccccccc' THEN 'valid' ELSE 'train' END AS split FROM documents WHERE text IS NOT NULL")
def hash_split_md5(spark, sf_dir):
    """G4 with MD5 in place of BLAKE2b, which SQL lacks: a twentieth goes to valid."""
    d = docs(spark, sf_dir).filter("text IS NOT NULL")
    place = F.when(F.substring(F.md5(F.concat("text", F.lit("\n"))), 1, 8) < "0ccccccc", 0.0).otherwise(1.0)
    return quota.hash_split(d, 0.05, bucket=place).select("doc_id", "split")


@query()
def hash_split(spark, sf_dir):
    """The exact hash (BLAKE2b, which SQL lacks; hash_split_md5 has SQL)."""
    return quota.hash_split(docs(spark, sf_dir), 0.05).select("doc_id", F.round(hash_bucket("text"), 12).alias("place"), "split")


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '{SQL_SPACE}+', ' ', 'g'), ' ') AS text FROM pages")
def html_strip(spark, sf_dir):
    """P22, P3."""
    return table(spark, sf_dir, "pages").select("page_id", t.collapse_space(t.strip_tags("html")).alias("text"))


@query(rf"SELECT doc_id, idx - 1 AS idx, s.sentence FROM (SELECT doc_id, {sql_sentences('text')} AS ss FROM documents), unnest(ss) WITH ORDINALITY AS s(sentence, idx)")
def sentence_split(spark, sf_dir):
    """P9."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(t.sentences("text")).alias("idx", "sentence"))


@query(f"SELECT doc_id, len(x) AS n_terms, array_to_string(list_sort(x), ' ') AS terms FROM (SELECT doc_id, list_distinct(list_filter({sql_tokens('text')}, lambda w: length(w) >= 2)) AS x FROM documents)")
def content_terms(spark, sf_dir):
    """P10."""
    d = docs(spark, sf_dir).withColumn("x", t.content_terms("text"))
    return d.select("doc_id", F.size("x").alias("n_terms"), F.array_join(F.array_sort("x"), " ").alias("terms"))


@query(f"SELECT doc_id, array_to_string(x, ' ') AS found FROM (SELECT doc_id, {sql_numbers('text')} AS x FROM documents) WHERE len(x) > 0")
def number_claims(spark, sf_dir):
    """P11."""
    d = docs(spark, sf_dir).withColumn("found", t.numbers("text"))
    return d.filter(F.size("found") > 0).select("doc_id", F.array_join("found", " ").alias("found"))


# --- chunks and retrieval ------------------------------------------------------------------------------------------------------------


SQL_CHUNKS = rf"""x AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') AS body FROM documents WHERE text IS NOT NULL),
step AS (SELECT doc_id, body, 0 AS start, 0 AS stop, -1 AS i, false AS done FROM x WHERE body <> ''
  UNION ALL
  SELECT doc_id, body, greatest(start + 1, fin - 80), fin, i + 1, fin >= length(body) FROM (
    SELECT doc_id, body, nxt AS start, i, CASE WHEN nxt + 600 >= length(body) THEN length(body) WHEN mark > nxt + 300 THEN mark + 1 ELSE nxt + 600 END AS fin FROM (
      SELECT doc_id, body, i, nxt, nxt + greatest(CASE WHEN instr(rw, chr(10)) > 0 THEN length(rw) - instr(rw, chr(10)) ELSE -1 - nxt END, CASE WHEN instr(rw, '.') > 0 THEN length(rw) - instr(rw, '.') ELSE -1 - nxt END, CASE WHEN instr(rw, '。') > 0 THEN length(rw) - instr(rw, '。') ELSE -1 - nxt END) AS mark FROM (
        SELECT doc_id, body, i, start AS nxt, reverse(substr(body, start + 1, 600)) AS rw FROM step WHERE NOT done)))),
pieces AS (SELECT doc_id, i, regexp_replace(substr(body, lag(start, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) + 1, stop - lag(start, 1, 0) OVER (PARTITION BY doc_id ORDER BY i)), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') AS text FROM step),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_idx, text FROM pieces WHERE i >= 0 AND text <> '')"""


@query(f"WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, chunk_idx, text FROM ch")
def chunk_documents(spark, sf_dir):
    """G1, G2."""
    return retrieval.build_chunks(docs(spark, sf_dir)).select("doc_id", "chunk_idx", "text")


@query(f"SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_terms FROM (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents)")
def bm25_tokens(spark, sf_dir):
    """P8."""
    d = docs(spark, sf_dir).withColumn("toks", t.tokens("text"))
    return d.select("doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_terms"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_tokens('text')})) AS term FROM documents) GROUP BY term")
def bm25_document_frequency(spark, sf_dir):
    """A4."""
    return retrieval.term_statistics(docs(spark, sf_dir))[0]


@query(f"WITH {sql_bm25(SEARCH, 10)} SELECT rank, doc_id, score FROM hits")
def bm25_topk(spark, sf_dir):
    """A query with repeated terms."""
    return retrieval.bm25(docs(spark, sf_dir), SEARCH, 10, ["doc_id"]).select("rank", "doc_id", "score")


SQL_BM25_BATCH = f"""WITH d AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents), s AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM d),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 3"""


@query(SQL_BM25_BATCH)
def bm25_batch(spark, sf_dir):
    """A5 for every benchmark item as a query."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25_batch(docs(spark, sf_dir), queries, 3, ["doc_id"]).select("query_id", "doc_id", "score", "rank")


def stored_index(spark, sf_dir) -> postings.Index:
    """A stored index of the documents, in the folder that all machines share."""
    return postings.write_index(docs(spark, sf_dir), f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}", ["doc_id"])


@query(f"SELECT term, count(*) AS df, sum(n)::BIGINT AS occurrences FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def index_terms(spark, sf_dir):
    """A4, K6: what a stored index holds of each term."""
    held = stored_index(spark, sf_dir).postings
    return held.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, n: s + n)).alias("occurrences"))


@query(f"WITH {sql_bm25(SEARCH, 10)} SELECT rank, doc_id, score FROM hits")
def indexed_topk(spark, sf_dir):
    """bm25_topk from a stored index."""
    return postings.search_index(stored_index(spark, sf_dir), SEARCH, 10).select("rank", "doc_id", "score")


@query(SQL_BM25_BATCH)
def indexed_batch(spark, sf_dir):
    """A5: bm25_batch from a stored index."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return postings.search_batch(stored_index(spark, sf_dir), queries, 3).select("query_id", "doc_id", "score", "rank")


def _first_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


SQL_DENSE = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1),
near AS (SELECT vec_id, round(list_inner_product(v, qv), 6) AS score FROM e, z),
nearest AS (SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM near QUALIFY row_number() OVER (ORDER BY score DESC, vec_id) <= {DENSE_K})"""


@query(f"WITH {SQL_DENSE} SELECT rank, vec_id, score FROM nearest")
def dense_topk(spark, sf_dir):
    """L4: the first vector as the query."""
    return retrieval.dense(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), DENSE_K).select("rank", "vec_id", "score")


SQL_DENSE_BATCH = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_inner_product(v, qv), 6) AS score FROM e, q)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5"""


@query(SQL_DENSE_BATCH)
def dense_batch(spark, sf_dir):
    """L4 for every vector whose id is divisible by 20 as a query, in blocks of bounded size, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_all(vectors, queries, 5).select("query_id", "vec_id", "score", "rank")


@query(SQL_DENSE_BATCH)
def dense_indexed(spark, sf_dir):
    """dense_batch from vectors stored by cluster, without the products that bounds rule out."""
    vectors = table(spark, sf_dir, "embeddings")
    index = vector_index.write_vector_index(vectors, f"{checkpoint_folder(spark)}/vectors-{uuid.uuid4().hex}")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.search_vectors(index, queries, 5)


@query(f"""WITH {sql_bm25(SEARCH, DENSE_K)}, {SQL_DENSE},
u AS (SELECT doc_id AS id, rank, 0 AS list FROM hits UNION ALL SELECT vec_id, rank, 1 FROM nearest),
f AS (SELECT id, round(sum(1.0 / (60 + rank)::DOUBLE), 12) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY id)
SELECT row_number() OVER (ORDER BY score DESC, first) AS rank, id, score FROM f QUALIFY row_number() OVER (ORDER BY score DESC, first) <= 10""")
def hybrid_rrf(spark, sf_dir):
    """Lexical and dense candidates of a table of queries (here one), gated and fused; document ids stand for vector ids."""
    chunks = docs(spark, sf_dir).withColumnRenamed("doc_id", "id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(SEARCH).alias("text"), F.array(*map(F.lit, _first_vector(spark, sf_dir))).alias("embedding"))
    found = retrieval.search_many(chunks, asked, "hybrid", 10, DENSE_K, vectors, key=["id"], order=["id"])
    return found.select("rank", "id", "score")


# --- verification and rendering --------------------------------------------------------------------------------------------------------


def hits(spark, sf_dir, k: int = 10) -> DataFrame:
    found = retrieval.bm25(docs(spark, sf_dir), SEARCH, k, ["doc_id"])
    return found.select("rank", "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), "text", "score")


@query(f"""WITH {sql_bm25(SEARCH, 20)}, cl AS (SELECT rank, s.idx, 'doc-' || doc_id AS source, s.sentence AS claim FROM (SELECT *, {sql_sentences('text')} AS ss FROM hits), unnest(ss) WITH ORDINALITY AS s(sentence, idx)),
cn AS (SELECT *, list_sort(list_distinct({sql_numbers('claim')})) AS nums, list_distinct(list_filter({sql_tokens('claim')}, lambda w: length(w) >= 2)) AS terms FROM cl)
SELECT a.source AS left_source, b.source AS right_source, a.claim AS left_claim, b.claim AS right_claim FROM cn a JOIN cn b
ON (a.rank, a.idx) < (b.rank, b.idx) AND a.source <> b.source AND len(a.nums) > 0 AND len(b.nums) > 0 AND a.nums <> b.nums AND len(list_intersect(a.terms, b.terms)) >= 3""")
def source_conflicts(spark, sf_dir):
    """J2 over the best hits of a query."""
    return verify.source_conflicts(hits(spark, sf_dir, 20))


ANSWERS = ("This work is licensed under the GNU General Public License. The moon is made of cheese.", "Released under the MIT License. All of the terms.", "不知道")


def answers(spark: SparkSession) -> DataFrame:
    made = F.array(*[F.struct(F.lit(i).alias("answer_id"), F.lit(a).alias("answer")) for i, a in enumerate(ANSWERS)])
    return spark.range(1).select(F.inline(made))


SQL_ANSWERS = "a(answer_id, answer) AS (VALUES " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(ANSWERS)) + ")"


def sql_terms(x: str) -> str:
    return f"list_distinct(list_filter({sql_tokens(x)}, lambda w: length(w) >= 2))"


SQL_VERIFIED = rf"""{SQL_ANSWERS}, sn AS (SELECT answer_id, answer, s.sentence, s.idx FROM (SELECT *, {sql_sentences('answer')} AS ss FROM a), unnest(ss) WITH ORDINALITY AS s(sentence, idx)),
st AS (SELECT *, {sql_terms('sentence')} AS terms FROM sn), ht AS (SELECT rank, {sql_terms('text')} AS ht FROM hits),
ok AS (SELECT answer_id, idx, sentence, list_sort(list(rank)) AS cites FROM st, ht WHERE len(terms) > 0 AND len(list_intersect(terms, ht)) / len(terms) >= 0.5 GROUP BY ALL)"""


@query(f"WITH {sql_bm25(SEARCH, 10)}, {SQL_VERIFIED} SELECT answer_id, sentence, array_to_string(cites, ',') AS citations FROM ok")
def verify_sentences(spark, sf_dir):
    """J3, R5."""
    found = verify.verified_sentences(answers(spark), hits(spark, sf_dir))
    return found.select("answer_id", "sentence", F.array_join(F.transform("citations", lambda c: c.cast("string")), ",").alias("citations"))


@query(f"""WITH a AS (SELECT item_id, {sql_sentences('text')} AS ss FROM benchmark), st AS (SELECT item_id, idx - 1 AS pos, s.sentence, {sql_terms('s.sentence')} AS terms FROM a, unnest(ss) WITH ORDINALITY AS s(sentence, idx)),
w AS (SELECT item_id, pos, sentence, len(terms) AS n, unnest(terms) AS term FROM st), h AS (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents),
c AS (SELECT item_id, pos, sentence, doc_id FROM w JOIN h USING (term) GROUP BY item_id, pos, sentence, n, doc_id HAVING count(*) / n >= 0.8)
SELECT item_id AS answer_id, pos::INT AS "at", sentence, array_to_string(list_sort(list(doc_id)), ',') AS citations FROM c GROUP BY ALL""")
def supported_sentences(spark, sf_dir):
    """The sentences of all benchmark items, and the documents that cover each by 0.8."""
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer"))
    found = verify.supported_sentences(answers, docs(spark, sf_dir).select(F.col("doc_id").alias("rank"), "text"), 0.8)
    return found.select("answer_id", "at", "sentence", F.array_join(F.transform("citations", lambda c: c.cast("string")), ",").alias("citations"))


@query(f"""WITH {sql_bm25(SEARCH, 10)}, {SQL_VERIFIED},
p AS (SELECT answer_id, string_agg(sentence || ' ' || array_to_string(list_transform(cites, lambda c: '[' || c || ']'), ' '), '' ORDER BY idx) AS v FROM ok GROUP BY answer_id),
e AS (SELECT coalesce(bool_or(len(list_intersect({sql_terms(repr(SEARCH))}, ht)) >= 2), false) AS direct FROM ht)
SELECT a.answer_id, coalesce(v, '{t.UNSUPPORTED}') AS verified, CASE WHEN v IS NOT NULL AND NOT contains(answer, '不知道') AND len({sql_terms('answer')}) >= 2 THEN 'verified' WHEN direct THEN 'evidence' ELSE 'refused' END AS branch
FROM a LEFT JOIN p USING (answer_id), e""")
def reliable_answer(spark, sf_dir):
    """R6, R7, F7."""
    h = hits(spark, sf_dir)
    return verify.verified_answers(answers(spark), h).join(verify.reliable_answers(answers(spark), h, SEARCH).select("answer_id", "branch"), "answer_id")


@query(rf"""WITH {sql_bm25(SEARCH, 10)}, b AS (SELECT rank, doc_id, text, s.sentence, s.idx, len(list_intersect(list_distinct({sql_tokens(repr(SEARCH))}), {sql_tokens('s.sentence')})) AS shared
FROM (SELECT *, {sql_sentences('text')} AS ss FROM hits), unnest(ss) WITH ORDINALITY AS s(sentence, idx))
SELECT rank, doc_id, sentence AS best FROM b QUALIFY row_number() OVER (PARTITION BY rank ORDER BY shared DESC, idx) = 1""")
def best_sentence(spark, sf_dir):
    """L8."""
    return verify.best_sentences(hits(spark, sf_dir), SEARCH).select("rank", "doc_id", "best")


SQL_SAID = f"""sd AS (SELECT rank, doc_id, text, '[' || rank || '] 來源：doc-' || doc_id || chr(10) AS header, ss, list_transform(ss, lambda x: len(list_intersect(list_distinct({sql_tokens(repr(SEARCH))}), {sql_tokens('x')}))) AS shared
FROM (SELECT *, {sql_sentences('text')} AS ss FROM hits)), sb AS (SELECT *, list_position(shared, list_max(shared)) AS k FROM sd)"""


@query(f"""WITH RECURSIVE {sql_bm25(SEARCH, 10)}, {SQL_SAID},
sx AS (SELECT rank, header, coalesce(ss[k], {sql_strip('text')}) || ' [' || rank || ']' AS body FROM sb),
fold(i, said, room) AS (SELECT 0::BIGINT, '', 500::BIGINT UNION ALL
  SELECT i + 1, CASE WHEN cut = '' THEN said WHEN said = '' THEN header || cut ELSE said || chr(10) || chr(10) || header || cut END, CASE WHEN room <= length(header) THEN 0 WHEN cut = '' THEN room ELSE room - length(header) - length(cut) END
  FROM (SELECT i, said, room, header, CASE WHEN room <= length(header) THEN '' ELSE {sql_rstrip('substr(body, 1, room - length(header))')} END AS cut FROM fold JOIN sx ON sx.rank = i + 1))
SELECT said AS answer FROM fold ORDER BY i DESC LIMIT 1""")
def cited_answer(spark, sf_dir):
    """A running budget over ranked hits."""
    return verify.cited_sections(hits(spark, sf_dir), SEARCH, 500)


@query(f"""WITH RECURSIVE {sql_bm25(SEARCH, 3)}, {SQL_SAID},
sx AS (SELECT rank, header, text, ss[k] AS best, CASE WHEN k > 1 THEN ss[k - 1] END AS before, ss[k + 1] AS after FROM sb),
fold(i, said, room) AS (SELECT 0::BIGINT, '', 600::BIGINT UNION ALL
  SELECT i + 1, CASE WHEN room <= length(header) THEN said WHEN said = '' THEN header || cut ELSE said || chr(10) || chr(10) || header || cut END, CASE WHEN room <= length(header) THEN 0 ELSE room - length(header) - length(cut) END
  FROM (SELECT *, {sql_rstrip("substr(CASE WHEN best IS NULL OR length(text) <= rest THEN text WHEN length(two) + 1 + length(after) <= rest THEN two || ' ' || after ELSE two END, 1, greatest(rest, 0))")} AS cut
    FROM (SELECT *, room - length(header) AS rest, CASE WHEN length(best) + 1 + length(before) <= room - length(header) THEN before || ' ' || best ELSE best END AS two FROM fold JOIN sx ON sx.rank = i + 1))),
c AS (SELECT said AS context FROM fold ORDER BY i DESC LIMIT 1)
SELECT context, '<|system|>' || chr(10) || {sql_strip(f"'{t.GROUNDING}' || chr(10) || chr(10) || '參考資料：' || chr(10) || " + sql_strip('context'))} || chr(10) || '<|user|>' || chr(10) || '{SEARCH}' || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM c""")
def context_render(spark, sf_dir):
    """R1, R2, P20, P21."""
    return verify.context(hits(spark, sf_dir, 3), SEARCH, 600).select("context", t.chat_prompt(F.lit(SEARCH), t.grounding_prompt("context")).alias("prompt"))


# --- chat and grounded records -----------------------------------------------------------------------------------------------------------


def talks(spark, sf_dir) -> DataFrame:
    return chat.normalize_conversations(chat.conversations(table(spark, sf_dir, "conversations")))


@query(f"WITH {SQL_CONVERSATIONS}, {SQL_VALID} SELECT conv_id, len(m) AS n_messages, m[-1].content AS last_content FROM w")
def valid_conversations(spark, sf_dir):
    """P24, F4."""
    return talks(spark, sf_dir).select("conv_id", F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last_content"))


@query(f"WITH {SQL_CONVERSATIONS}, {SQL_VALID}, k AS (SELECT conv_id, array_to_string(list_transform(m, lambda x: x.role || chr(31) || x.content), chr(30)) AS key FROM w) SELECT min(conv_id) AS conv_id, sha256(key) AS digest, 0 AS input_idx FROM k GROUP BY key")
def conversation_dedup(spark, sf_dir):
    """The table merged with itself."""
    keyed = talks(spark, sf_dir).select("conv_id", chat.conversation_digest("messages").alias("digest"))
    return quota.merge_records([keyed, keyed], "digest", "conv_id").select("conv_id", "digest", "input_idx")


@query(f"WITH {SQL_CONVERSATIONS}, {SQL_VALID}, k AS (SELECT conv_id, conv_id % 2 AS part, array_to_string(list_transform(m, lambda x: x.role || chr(31) || x.content), chr(30)) AS key FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY conv_id) AS n FROM k WHERE true) SELECT conv_id, part AS source_idx FROM o WHERE n <= CASE WHEN part = 0 THEN 10 ELSE 1000000 END AND (part = 0 OR key NOT IN (SELECT key FROM o WHERE part = 0 AND n <= 10)) ORDER BY part, conv_id LIMIT 30")
def chat_quota(spark, sf_dir):
    """L2: two sources, the first with a limit of its own, 30 in all."""
    keyed = talks(spark, sf_dir).select("conv_id", chat.conversation_digest("messages").alias("digest"))
    parts = [(keyed.filter(F.pmod("conv_id", F.lit(2)) == i), own) for i, own in ((0, 10), (1, None))]
    return quota.collect_conversations(parts, 30, "digest", "conv_id").select("conv_id", "source_idx")


@query()
def conversation_fingerprint(spark, sf_dir):
    """P25: the exact hash (BLAKE2b, which SQL lacks)."""
    return talks(spark, sf_dir).select("conv_id", message_fingerprint("messages").alias("fingerprint"))


@query(f"WITH {SQL_CONVERSATIONS}, {SQL_VALID} SELECT conv_id, array_to_string(list_transform(m, lambda x: '<|' || x.role || '|>' || chr(10) || x.content), chr(10)) AS rendered FROM w")
def chat_render(spark, sf_dir):
    """P21 for whole conversations."""
    return talks(spark, sf_dir).select("conv_id", chat.render(F.col("messages")).alias("rendered"))


def word_lengths(texts):
    """Ids that SQL can give, too: the length of each word."""
    return F.transform(texts, lambda text: F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.length))


def sql_ids(x: str) -> str:
    return rf"list_transform(list_filter(regexp_split_to_array({x}, '[\t-\r ]+'), lambda w: w <> ''), lambda w: length(w))"



@query(rf"""WITH {SQL_CONVERSATIONS}, {SQL_VALID},
e AS (SELECT conv_id, flatten(list_transform(m, lambda x: list_concat([length('<|' || x.role || '|>')], {sql_ids('x.content')}, CASE WHEN x.role = 'assistant' THEN [3] ELSE [] END))) AS ids,
  flatten(list_transform(m, lambda x: list_concat([-100], list_transform({sql_ids('x.content')}, lambda i: CASE WHEN x.role = 'assistant' THEN i ELSE -100 END), CASE WHEN x.role = 'assistant' THEN [3] ELSE [] END))) AS labels FROM w)
SELECT conv_id, len(ids) AS n_tokens, array_to_string(ids[:-2], ' ') AS x, array_to_string(labels[2:], ' ') AS y FROM e WHERE len(ids) <= 512""")
def answer_mask(spark, sf_dir):
    """E3, F5, G7 with the lengths of words as ids."""
    rows = chat.encode_conversations(talks(spark, sf_dir), word_lengths)
    x, y = chat.next_token("input_ids", "labels")
    show = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    return rows.select("conv_id", F.size("input_ids").alias("n_tokens"), show(x).alias("x"), show(y).alias("y"))


@query("""WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'Reply.' || chr(10) || chr(10) || trim(text) AS user_content, trim(reply) AS assistant_content FROM p WHERE role = 'user' AND next_role = 'assistant' AND trim(text) <> '' AND trim(reply) <> ''""")
def alpaca_normalize(spark, sf_dir):
    """P24 for instruction rows, made of each user turn and its answer."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "output": F.lead("text").over(w)})
    rows = turns.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.lit("Reply.").alias("instruction"), F.col("text").alias("input"), "output")
    made = chat.normalize_alpaca(rows.filter(t.strip("input") != ""))
    return made.select("conv_id", "turn", F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"))


def qa_rows(spark, sf_dir) -> DataFrame:
    """Question-answer rows made of documents: the answer is a word of the text, every third is unanswerable, every fifth broken."""
    d = docs(spark, sf_dir)
    word = F.coalesce(F.get(F.split(F.trim(F.regexp_replace("text", r"[^A-Za-z ]+", " ")), " +"), F.lit(4)), F.lit(""))
    target = F.when(F.pmod("doc_id", F.lit(5)) == 4, F.lit("{broken")).otherwise(F.to_json(F.struct(word.alias("answer"), (F.pmod("doc_id", F.lit(3)) != 2).alias("answerable"))))
    prompt = F.concat(F.lit("文章："), "text", F.lit("\n問題：What?"))
    return d.select("doc_id", F.col("doc_id").cast("string").alias("qid"), F.lit(None).cast("string").alias("article_id"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), target.alias("content"))).alias("messages"))


@query(rf"""WITH d AS (SELECT doc_id::VARCHAR AS qid, doc_id, regexp_replace(text, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') AS c,
  coalesce(regexp_split_to_array(trim(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')), ' +')[5], '') AS a, doc_id % 3 <> 2 AS ok FROM documents WHERE doc_id % 5 <> 4),
p AS (SELECT *, CASE WHEN ok AND a <> '' THEN instr(c, a) - 1 ELSE -1 END AS pos FROM d WHERE c <> ''),
q AS (SELECT *, least(length(c), greatest(pos - 160, 0) + 320) AS stop FROM p)
SELECT qid, CASE WHEN ok THEN 'drcd_answerable' ELSE 'drcd_refusal' END AS kind, CASE WHEN ok AND a <> '' THEN a || ' [1]' ELSE '{t.REFUSAL}' END AS completion,
  CASE WHEN length(c) <= 320 THEN c WHEN pos < 0 THEN regexp_replace(substr(c, 1, 320), '{SQL_SPACE}+$', '') ELSE regexp_replace(substr(c, greatest(stop - 320, 0) + 1, 320), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') END AS context FROM q""")
def drcd_normalize(spark, sf_dir):
    """P14-P17, S5."""
    made = grounded.normalize_qa(qa_rows(spark, sf_dir))
    context = F.regexp_extract(F.col("messages")[0]["content"], r"(?s)\[1\] 來源：DRCD/\d+\n(.*)\z", 1)
    return made.select("qid", "kind", F.col("messages")[2]["content"].alias("completion"), context.alias("context"))


def sql_named(templates: tuple[str, ...], i: str) -> str:
    listed = ", ".join(f"'{x}'" for x in templates)
    return f"replace([{listed}][{i} % {len(templates)} + 1], '{{}}', topic)"


@query(f"""WITH RECURSIVE {SQL_CHUNKS},
o AS (SELECT ch.doc_id, chunk_idx, ch.text, source, row_number() OVER (ORDER BY ch.doc_id, chunk_idx) - 1 AS n, count(*) OVER () AS all_n FROM ch JOIN documents USING (doc_id)),
nb AS (SELECT a.*, {sql_truncate('a.text', 90, 'ca')} AS c1, {sql_truncate('b.text', 90, 'cb')} AS c2, {sql_headings('a.text')} AS h, regexp_extract(a.source, '([^/]*)/*$', 1) AS name FROM o a JOIN o b ON b.n = (a.n + 1) % a.all_n),
an AS (SELECT *, {sql_prose('c1', 90, 'pa')} AS a1, {sql_prose('c2', 90, 'pb')} AS a2, {sql_facts('c1', 180)} AS f,
  replace(CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END, '_', ' ') AS stem FROM nb),
rd AS (SELECT doc_id, chunk_idx, coalesce(substr(h[1], 1, 80), nullif(stem, ''), '參考資料中的主題') AS topic, a1 || ' [1] ' || a2 || ' [2]' AS whole, CASE WHEN len(f) > 0 THEN f ELSE [a1] END AS f FROM an WHERE c1 <> '' AND c2 <> '' AND a1 <> '' AND a2 <> '')
SELECT doc_id, chunk_idx, i::INT AS idx, CASE WHEN i < 6 THEN 'rag_summary' WHEN i < 7 THEN 'rag_fact' ELSE 'rag_refusal' END AS kind,
  CASE WHEN i < 6 THEN {sql_named(grounded.SUMMARY_QUESTIONS, 'i')} WHEN i < 7 THEN {sql_named(grounded.FACT_QUESTIONS, '(i - 6)')} ELSE {sql_named(grounded.REFUSAL_QUESTIONS, '(i - 7)')} END AS question,
  CASE WHEN i < 6 THEN whole WHEN i < 7 THEN f[(i - 6) % len(f) + 1] || ' [1]' ELSE '{t.REFUSAL}' END AS answer FROM rd, range(9) g(i)""")
def rag_sft_records(spark, sf_dir):
    """G3, P12, P13, P18, P19, J5 over all chunks, with a neighbour each."""
    made = grounded.synthesize(retrieval.build_chunks(docs(spark, sf_dir)), grounded.SynthesisOptions(examples_per_chunk=7, context_chunks=2))
    return made.select("doc_id", "chunk_idx", "idx", "kind", F.col("messages")[1]["content"].alias("question"), F.col("messages")[2]["content"].alias("answer"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g'), '^#+', ''), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')), lambda x: x <> '') AS h FROM documents)
SELECT doc_id, coalesce(substr(h[1], 1, 80), 'doc ' || doc_id) AS topic FROM l""")
def topics(spark, sf_dir):
    """P18."""
    return docs(spark, sf_dir).select("doc_id", t.topic("text", F.concat(F.lit("x/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("topic"))


@query(f"SELECT doc_id, idx - 1 AS idx, s.fact FROM (SELECT doc_id, {sql_facts('text', 180)} AS ff FROM documents), unnest(ff) WITH ORDINALITY AS s(fact, idx)")
def topic_facts(spark, sf_dir):
    """P12, P13, P19."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(t.facts("text", 180)).alias("idx", "fact"))


# --- sampling, schedules, encoding, the rest -------------------------------------------------------------------------------------------------


SQL_SAMPLED = """l AS (SELECT vec_id, unnest(range(len(embedding))) AS token, unnest(embedding)::DOUBLE / 0.1 AS x FROM embeddings),
k AS (SELECT * FROM l QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY x DESC) <= 20),
p AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM k), s AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p),
c AS (SELECT * FROM s QUALIFY round(coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 12) < 0.9),
f AS (SELECT vec_id, token, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM c)"""


@query(f"WITH {SQL_SAMPLED} SELECT vec_id, token, p FROM f")
def sampling_filter(spark, sf_dir):
    """Vectors as logits, temperature 0.1, top 20, nucleus 0.9."""
    return sampling.sampling_filter(table(spark, sf_dir, "embeddings"), temperature=0.1, top_k=20, top_p=0.9)


@query(f"""WITH {SQL_SAMPLED}, u AS (SELECT vec_id, token, sum(p) OVER (PARTITION BY vec_id ORDER BY token) AS until, sum(p) OVER (PARTITION BY vec_id) AS whole FROM f)
SELECT vec_id, min(token)::INT AS token FROM u WHERE until > {sql_uniform("'42'", "vec_id")} * whole GROUP BY vec_id""")
def token_draw(spark, sf_dir):
    """A token drawn from what the sampling filter leaves."""
    return sampling.drawn_tokens(sampling_filter(spark, sf_dir), 42)


@query("""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.+-]*'), lambda w: length(w)) AS toks FROM documents)
SELECT doc_id, start, array_to_string(toks[start + 1 : start + 16], ' ') AS x, array_to_string(toks[start + 2 : start + 17], ' ') AS y FROM (SELECT doc_id, toks, unnest(range(0, greatest(len(toks) - 17, 0), 16)) AS start FROM t)""")
def pack_windows(spark, sf_dir):
    """G5 with fixed starts: windows of 16 tokens."""
    rows = docs(spark, sf_dir).select("doc_id", F.transform(t.tokens("text"), F.length).alias("tokens"))
    show = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    return sampling.packed_windows(rows, 16).select("doc_id", "start", show(F.col("x")).alias("x"), show(F.col("y")).alias("y"))


@query(f"""WITH t AS (SELECT doc_id, len({sql_tokens('text')}) - 17 AS last FROM documents), d AS (SELECT doc_id, draw, floor({sql_uniform("'42'", "doc_id", "draw")} * last)::INT AS start, {sql_uniform("'42'", "(doc_id || '/' || draw)")} AS u FROM t, range(2) r(draw) WHERE last > 0)
SELECT doc_id, draw::INT AS draw, start, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.8 THEN 1 ELSE 2 END AS source_idx FROM d""")
def random_batches(spark, sf_dir):
    """Two windows of each document at random starts, each with a source by weight."""
    rows = docs(spark, sf_dir).select("doc_id", F.transform(t.tokens("text"), F.length).alias("tokens"))
    drawn = sampling.random_windows(rows, 16, 2, 42).withColumn("key", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("draw").cast("string")))
    return sampling.weighted_choice(drawn, [0.5, 0.3, 0.2], 42, "key").select("doc_id", "draw", "start", "source_idx")


@query(f"""WITH t AS (SELECT doc_id, list_append(list_transform({sql_tokens('text')}, lambda w: length(w)), 3) AS toks FROM documents),
s AS (SELECT flatten(list(toks ORDER BY doc_id)) AS ids FROM t), d AS (SELECT doc_id, floor({sql_uniform("'42'", "doc_id")} * (len(ids) - 17))::BIGINT AS start, ids FROM t, s)
SELECT doc_id, start, array_to_string(ids[start + 1 : start + 16], ' ') AS x, array_to_string(ids[start + 2 : start + 17], ' ') AS y FROM d""")
def stream_windows(spark, sf_dir):
    """A random window of the whole stored stream for each document, over the borders of documents."""
    rows = docs(spark, sf_dir).select("doc_id", F.array_append(F.transform(t.tokens("text"), F.length), F.lit(3)).alias("tokens"))
    stream = token_blocks.write_token_blocks(rows, f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}", ["doc_id"])
    show = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    found = token_blocks.stream_windows(stream, docs(spark, sf_dir).select("doc_id"), 16, 42, "doc_id")
    return found.select("doc_id", "start", show(F.col("x")).alias("x"), show(F.col("y")).alias("y"))


SQL_PARTNER = "((('0x' || substr(md5('42:1:' || i), 1, 13))::BIGINT % n - x) % n + n) % n"


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number, count(*) OVER () AS n FROM documents),
p AS (SELECT doc_id, list_reduce(list_prepend(number, range({sampling.SHUFFLE_ROUNDS})), lambda x, i: CASE WHEN substr(md5('42:1:' || i || ':' || greatest(x, {SQL_PARTNER})), 1, 1) < '8' THEN {SQL_PARTNER} ELSE x END) AS place FROM r)
SELECT doc_id, place::BIGINT AS place, (place // 32)::BIGINT AS batch FROM p""")
def permuted_epoch(spark, sf_dir):
    """An epoch over numbered rows by a keyed permutation."""
    rows = sampling.numbered(docs(spark, sf_dir).select("doc_id"), ["doc_id"])
    return sampling.permuted_epoch(rows, rows.count(), 32, 1, 42).drop("row")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY md5('42:0:' || doc_id), doc_id) - 1) // 32)::BIGINT AS batch FROM documents")
def shuffled_epoch(spark, sf_dir):
    """Documents in batches of 32."""
    return sampling.epoch_batches(docs(spark, sf_dir).select("doc_id"), 32, 0, 42)


@query("""SELECT s AS step, round(CASE WHEN s * 1000 < 100000 THEN 0.001 * (s * 1000) / 100000.0 ELSE 0.001 * 0.1 + 0.001 * 0.9 * 0.5 * (1 + cos(pi() * (s * 1000 - 100000) / 900000.0)) END, 12) AS pretrain,
round(0.0005 * least(1.0, (s + 1) / 30.0) * (1 - 0.9 * s / 1000.0), 12) AS tuning, printf('%d:%02d:%02d', s * 7 // 3600, s * 7 // 60 % 60, s * 7 % 60) AS elapsed FROM range(1001) r(s)""")
def lr_schedule(spark, sf_dir):
    """N1, N2, P30."""
    rows = spark.range(1001).withColumnRenamed("id", "step")
    pre = schedule.pretrain_rate(F.col("step") * 1000, 1_000_000, 100_000, 0.001)
    return rows.select("step", F.round(pre, 12).alias("pretrain"), F.round(schedule.tuning_rate("step", 1000, 30, 0.0005), 12).alias("tuning"), t.duration(F.col("step") * 7).alias("elapsed"))


#: A public BPE model of 32 000 pieces.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@query()
def encode_corpus(spark, sf_dir, tokenizer: str = TOKENIZER):
    """The corpus encoded with a public tokenizer, which SQL can't run. (Nothing is trained here.)"""
    made = encode.encode_corpus(docs(spark, sf_dir), encode.public_tokenizer(tokenizer))
    return made.select("doc_id", F.size("tokens").alias("n_tokens"), F.xxhash64("tokens").alias("digest"))


PAYLOAD = '{"web": {"results": [{"title": " A ", "url": "http://a", "description": "x y "}, {"title": 1, "url": "http://b", "description": "z"}, {"title": "C", "url": "http://c"}]}}'


@query(f"""WITH r AS (SELECT unnest(json_extract('{PAYLOAD}'::JSON, '$.web.results[*]')) AS j)
SELECT trim(j ->> '$.title') AS title, trim(j ->> '$.url') AS url, trim(j ->> '$.description') AS snippet FROM r WHERE json_type(j, '$.title') = 'VARCHAR' AND json_type(j, '$.url') = 'VARCHAR' AND json_type(j, '$.description') = 'VARCHAR'""")
def web_hits_parse(spark, sf_dir):
    """P23."""
    return web.web_hits(spark.range(1).select(F.lit(PAYLOAD).alias("payload")))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_hours(spark, sf_dir):
    """Extension: the streaming aggregate, over the whole table."""
    return event_windows(table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
