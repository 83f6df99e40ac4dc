"""Queries of retrieval and mail over the document, embedding and conversation tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import cut
from .functions.text import tokenize
from .graph import derived, table, with_graph
from .operators import mail
from .operators import retrieval as R
from .queries import query

#: Literal identifiers beside the prose, where capitals seldom change within a word.
IDENTIFIERS = ["getUserById", "HTTPResponse2Go", "parse2JSONFast", "user_name", "ümlautCase", "XMLHttpRequest", "A1b2C3", "", "ABC"]


def tokens_sql(text: str) -> str:
    """DuckDB's patterns have no lookaround: separators go in by replacement, each twice for overlaps."""
    out = f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for a, b in (("\\p{N}", "\\p{L}"), ("\\p{L}", "\\p{N}"), ("\\p{Ll}", "\\p{Lu}"), ("\\p{Lu}", "\\p{Lu}\\p{Ll}")):
        for _ in range(2):
            out = f"regexp_replace({out}, '({a})({b})', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower({out}), ' '), lambda x: x <> '')"


@query(f"SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest({tokens_sql('text')}) AS term FROM (SELECT CAST(doc_id AS VARCHAR) AS uid, text FROM documents UNION ALL SELECT 'i' || CAST(i AS VARCHAR), {IDENTIFIERS}[i + 1] FROM range({len(IDENTIFIERS)}) t(i))) GROUP BY uid, term")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(table(spark, sf_dir, "documents"))


def terms(documents: DataFrame) -> DataFrame:
    extra = documents.sparkSession.createDataFrame([(f"i{i}", x) for i, x in enumerate(IDENTIFIERS)], "uid string, text string")
    docs = documents.select(F.col("doc_id").cast("string").alias("uid"), "text").unionByName(extra)
    return docs.select("uid", F.explode(tokenize("text")).alias("term")).groupBy("uid", "term").agg(F.count(F.lit(1)).alias("tf"))


INDEXES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents' inverted index, which a session writes once for each folder of (unchanging) tables."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in INDEXES:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "source", "text")
        postings, lengths = R.inverted_index(docs, "uid", "source", "text")
        INDEXES[key] = cut(postings.repartitionByRange("term").sortWithinPartitions("term", "uid")), lengths
    return INDEXES[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the benchmark is a query, so their number grows with the input."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25_CTES = f"""terms AS (SELECT doc_id AS uid, {tokens_sql("source || ' ' || text")} AS t FROM documents),
post AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(t) AS term FROM terms) GROUP BY uid, term),
dl AS (SELECT uid, len(t) AS dl FROM terms), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
want AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY query_id, term),
df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM want) GROUP BY term),
part AS (SELECT query_id, uid, term, tf, times, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf,
  tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS tf_norm FROM post JOIN want USING (term) JOIN df USING (term) JOIN dl USING (uid) CROSS JOIN corpus),
scored AS (SELECT query_id, uid, sum(times * idf * tf_norm) AS score FROM part GROUP BY query_id, uid),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, uid) AS rank FROM scored)"""


def _rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


@query(f"WITH {BM25_CTES} SELECT query_id, uid, round(score, 6) AS score FROM bm WHERE rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.bm25(*corpus(spark, sf_dir), questions(spark, sf_dir), 20).drop("rank"), "score")


@query(f"WITH {BM25_CTES} SELECT query_id, uid, term, tf, round(idf, 6) AS idf, round(tf_norm, 6) AS tf_norm, round(times * idf * tf_norm, 6) AS score FROM part")
def bm25_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.contributions(*corpus(spark, sf_dir), questions(spark, sf_dir)), "idf", "tf_norm", "score")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("uid % 100 = 0").select(F.col("uid").alias("query_id"), "vector")


KNN = """near AS (SELECT q.vec_id AS query_id, v.vec_id AS uid, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, uid) AS rank FROM near)"""


@query(f"WITH {KNN} SELECT query_id, uid, round(score, 5) AS score FROM knn WHERE rank <= 10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.knn(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).drop("rank"), "score", to=5)


FUSED = """both_ AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.uid, b.uid) AS uid, coalesce(1 / (60.0::DOUBLE + a.rank), 0) + coalesce(1 / (60.0::DOUBLE + b.rank), 0) AS score
FROM bm a FULL JOIN (SELECT * FROM knn WHERE rank <= 100) b ON a.query_id = b.query_id AND a.uid = b.uid),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, uid) AS rank FROM both_)"""


def hybrid(spark: SparkSession, sf_dir: str, asked: DataFrame, limit: int = 20, words: int | None = None) -> DataFrame:
    """Word search (its best ``words`` hits, or all) and vector search of the same query ids, fused; documents
    stand for vectors of their id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"))
    q = v.join(asked.select(F.col("query_id").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("query_id"), "vector")
    return R.rrf(R.bm25(*corpus(spark, sf_dir), asked, words), R.knn(v, q, 100), limit=limit)


KNN_ITEMS = KNN.replace("q.vec_id % 100 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)")


@query(f"WITH {BM25_CTES}, {KNN_ITEMS}, {FUSED} SELECT query_id, uid, round(score, 9) AS score, rank FROM fused WHERE rank <= 20".replace("SELECT query_id, uid, round(score, 9) AS score, rank FROM", "SELECT query_id, uid, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM"))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hybrid(spark, sf_dir, questions(spark, sf_dir)), "score", to=9).select("query_id", "uid", "score", "rank")


@query(f"""WITH {KNN}, other AS (SELECT query_id, uid, row_number() OVER (PARTITION BY query_id ORDER BY uid) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS uid FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0)),
bm AS (SELECT query_id, uid, rank FROM other WHERE rank <= 100), {FUSED} SELECT query_id, uid, round(score, 9) AS score FROM fused WHERE rank <= 20""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the query's label by id, fused with those near it."""
    v = vectors(spark, sf_dir)
    q = v.where("uid % 100 = 0").select(F.col("uid").alias("query_id"), "label")
    other = v.join(F.broadcast(q), "label").select("query_id", "uid", (-F.col("uid")).cast("double").alias("score"))
    return _rounded(R.rrf(R.ranked(other, "score", 100, "query_id"), R.knn(v, vector_queries(spark, sf_dir), 100), limit=20), "score", to=9).select("query_id", "uid", "score")


@query(f"""WITH {BM25_CTES}, {KNN_ITEMS}, {FUSED}, words AS (SELECT item_id AS query_id, list_distinct({tokens_sql('text')}) AS q FROM benchmark)
SELECT query_id, uid, round(CAST(len(list_intersect(q, list_distinct({tokens_sql('text')}))) AS DOUBLE) / len(q), 6) AS rerank_score FROM fused JOIN words USING (query_id) JOIN documents ON doc_id = uid WHERE rank <= 20""")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir, questions(spark, sf_dir))


def reranked(spark: SparkSession, sf_dir: str, asked: DataFrame, words: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text")
    found = hybrid(spark, sf_dir, asked, words=words).join(docs, "uid").join(asked.withColumnRenamed("text", "query"), "query_id")
    return found.select("query_id", "uid", F.round(R.lexical_score(F.col("query"), F.col("text")), 6).alias("rerank_score"))


@query(with_graph("SELECT uid, direction, kind, name AS other FROM (SELECT src AS uid, 'out' AS direction, kind, dst AS o FROM edge UNION ALL SELECT dst, 'in', kind, src FROM edge) e JOIN sym s ON s.uid = o WHERE e.uid IN (SELECT uid FROM sym WHERE kind = 'Class' AND start_line < 50)".replace("SELECT uid, direction, kind, name", "SELECT e.uid, direction, e.kind, name")))
def graph_edges_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return R.attached_edges(g.symbols.where("kind = 'Class' AND start_line < 50"), g.edges, g.symbols)


@query("SELECT label, CAST(i AS INTEGER) AS at, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS mean FROM embeddings, range(64) t(i) GROUP BY label, i".replace("AS at,", 'AS "at",'))
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.centroids(vectors(spark, sf_dir)), "mean")


@query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pca_2d(vectors(spark, sf_dir))


@query(f"""WITH {KNN}, rel AS (SELECT q.vec_id AS query_id, v.vec_id AS uid FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0),
each_ AS (SELECT query_id, count(*) AS total, count(*) FILTER (WHERE rank <= 1) AS h1, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, min(rank) FILTER (WHERE rank <= 10) AS first FROM rel LEFT JOIN knn USING (query_id, uid) GROUP BY query_id)
SELECT round(avg(h1::DOUBLE / total), 6) AS recall_at_1, round(avg(h5::DOUBLE / total), 6) AS recall_at_5, round(avg(h10::DOUBLE / total), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM each_""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    relevant = v.where("uid % 100 = 0").select(F.col("uid").alias("query_id"), "label").join(v.select("uid", "label"), "label").select("query_id", "uid")
    return R.retrieval_metrics(R.knn(v, vector_queries(spark, sf_dir), 10), relevant)


MAIL = """m AS (SELECT 'E' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS uid, conv_id, turn, role, text, CASE WHEN turn % 5 <> 3 THEN 'E' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END AS reply FROM conversations)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages that answer the turn before, but for some that begin anew."""
    uid = lambda turn: F.concat_ws("_", F.concat(F.lit("E"), "conv_id"), turn)
    turn = F.col("turn")
    own = table(spark, sf_dir, "conversations").select(uid(turn).alias("uid"), uid(turn).alias("message_id"), F.when(turn % 5 != 3, uid(turn - 1)).alias("in_reply_to"), F.expr("cast(array() as array<string>)").alias("refs"))
    rest = table(spark, sf_dir, "conversations").select(uid(turn).alias("uid"), F.col("role").alias("sender"), F.array(F.when(F.col("role") == "user", " Assistant ").otherwise("user")).alias("to"), F.expr("cast(array() as array<string>)").alias("cc"), F.concat(F.lit("turn "), "turn").alias("subject"), F.col("text").alias("body"))
    return own.join(rest, "uid")


@query(f"WITH RECURSIVE {MAIL}, ids AS (SELECT uid, uid AS id FROM m UNION ALL SELECT uid, reply FROM m WHERE reply IS NOT NULL), pairs AS (SELECT DISTINCT x.uid AS a, y.uid AS b FROM ids x JOIN ids y USING (id)), walk(a, b) AS (SELECT uid, uid FROM m UNION SELECT walk.a, pairs.b FROM walk JOIN pairs ON walk.b = pairs.a) SELECT a AS uid, min(b) AS thread FROM walk GROUP BY a HAVING count(*) > 1")
def conversation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.threads(messages(spark, sf_dir))


@query(f"WITH {MAIL} SELECT a.uid AS source_uid, b.uid AS target_uid FROM m a JOIN m b ON a.reply = b.uid")
def mail_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.replies(messages(spark, sf_dir))


@query(f"WITH {MAIL}, p AS (SELECT lower(role) AS address, 1 AS s, 0 AS r FROM m UNION ALL SELECT CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END, 0, 1 FROM m) SELECT address, CAST(sum(s) AS BIGINT) AS sent, CAST(sum(r) AS BIGINT) AS received FROM p GROUP BY address")
def person_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.person_activity(messages(spark, sf_dir))


@query(f"WITH {MAIL} SELECT uid FROM m WHERE (contains(lower(text), 'the') OR contains('turn ' || CAST(turn AS VARCHAR), 'the')) AND (role = 'assistant' OR role = 'user')")
def email_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.search(messages(spark, sf_dir), "THE", "assistant ", limit=None).select("uid")


@query("""WITH names AS (SELECT 'N' || name AS uid, name FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS name FROM documents)
  WHERE regexp_matches(name, '\\p{L}') AND length(name) >= 3 AND (contains(name, '_') OR regexp_matches(name, '[0-9]') OR regexp_matches(name, '^[A-Z]{3,}$') OR (regexp_matches(name, '[a-z]') AND regexp_matches(name, '^.+[A-Z]')))),
w AS (SELECT uid, line, unnest(string_split_regex(row, '[^\\p{L}\\p{N}_]+')) AS name FROM (SELECT uid, generate_subscripts(r, 1) AS line, unnest(r) AS row FROM (SELECT 'D' || CAST(doc_id AS VARCHAR) AS uid, string_split(text, chr(10)) AS r FROM documents)))
SELECT w.uid, n.uid AS target, count(*) AS n, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines FROM w JOIN names n USING (name) GROUP BY w.uid, n.uid""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents that have a letter and look like identifiers are the names to look for."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name"))
    names = words.where(F.col("name").rlike(r"\p{L}")).distinct()
    return R.mentions(docs.select(F.concat(F.lit("D"), "doc_id").alias("uid"), "text"), names.select(F.concat(F.lit("N"), "name").alias("uid"), "name"))


