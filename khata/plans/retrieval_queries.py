"""Chunks, copies and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.operators import retrieval
from khata.plans import standins as st
from khata.plans.registry import query
from khata.session import spread


def _last(marker):
    """0-based place of a two-letter marker's last occurrence in the window ``w``, -1 if none."""
    return f"CASE WHEN instr(reverse(w), reverse({marker})) > 0 THEN length(w) - instr(reverse(w), reverse({marker})) - 1 ELSE -1 END"


def _cuts(source, key):
    """Recursive chunk spans over ``source`` (key, body)."""
    step = f"""
      SELECT {key}, body, n, a, CASE WHEN a + 1000 < length(body) THEN
               CASE WHEN p1 > 0 THEN a + p1 + 2 WHEN p2 > 0 THEN a + p2 + 2 WHEN p3 > 0 THEN a + p3 + 2 ELSE a + 1000 END
             ELSE a + 1000 END AS b
      FROM (SELECT *, {_last("'. '")} AS p1, {_last("concat('.', chr(10))")} AS p2, {_last("concat(chr(10), chr(10))")} AS p3
            FROM (SELECT *, substr(body, CAST(a AS INT) + 1, 1000) AS w FROM ({{inner}})))"""
    first = step.format(inner=f"SELECT {key}, body, 0 AS n, 0 AS a FROM {source} WHERE length(body) > 0")
    rest = step.format(inner=f"""
      SELECT {key}, body, n + 1 AS n, CASE WHEN b - 200 > a THEN b - 200 ELSE b END AS a FROM spans
      WHERE CASE WHEN b - 200 > a THEN b - 200 ELSE b END < length(body)""")
    return f"""
    spans AS ({first} UNION ALL {rest}),
    cut AS (SELECT {key}, n, trim(substr(body, CAST(a AS INT) + 1, CAST(b - a AS INT)), concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12))) AS chunk FROM spans),
    chunks AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY n) - 1 AS chunk_index, chunk FROM cut WHERE chunk <> '')
    """


@query("k1_chunks", f"""
WITH RECURSIVE source AS (SELECT doc_id, text AS body FROM documents), {_cuts("source", "doc_id")}
SELECT doc_id, chunk_index, chunk, md5(chunk) AS chunk_id FROM chunks
""")
def k1_chunks(spark, d):
    return retrieval.chunk_documents(spread(st.table(spark, d, "documents"), "doc_id"), "doc_id", "text")


@query("s27_document_ingest", f"""
WITH RECURSIVE source AS (
  SELECT conv_id, string_agg(concat(chr(10), '[Page ', turn + 1, ']', chr(10), text), '' ORDER BY turn) AS body
  FROM conversations WHERE text <> '' GROUP BY conv_id), {_cuts("source", "conv_id")}
SELECT conv_id, chunk_index, chunk, concat('conversation-', conv_id) AS source FROM chunks
""")
def s27_document_ingest(spark, d):
    texts = retrieval.assemble_pages(st.table(spark, d, "conversations"), "conv_id", "turn", "text")
    chunks = retrieval.chunk_documents(texts, "conv_id", "full_text").drop("chunk_id")
    return chunks.withColumn("source", F.concat(F.lit("conversation-"), F.col("conv_id")))


@query("k2_text_ids", "SELECT doc_id, md5(text) AS id FROM documents")
def k2_text_ids(spark, d):
    return st.table(spark, d, "documents").select("doc_id", F.md5("text").alias("id"))


@query("u5_first_copies", "SELECT md5(text) AS id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def u5_first_copies(spark, d):
    return retrieval.first_copies(st.table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("id", "doc_id")


@query("k3_add_documents", """
WITH docs AS (SELECT md5(text) AS id, min(doc_id) AS doc_id FROM documents GROUP BY 1),
store AS (SELECT md5(text) AS id FROM documents WHERE lang = 'en')
SELECT 'added' AS what, count(*) AS texts FROM docs WHERE id NOT IN (SELECT id FROM store)
UNION ALL SELECT 'stored', count(*) FROM docs
""")
def k3_add_documents(spark, d):
    docs = st.table(spark, d, "documents").select("doc_id", "text", "lang")
    store = retrieval.first_copies(docs.where(F.col("lang") == "en").drop("lang"), "text", "doc_id").select("id", "doc_id")
    fresh = retrieval.first_copies(docs.drop("lang"), "text", "doc_id").select("id", "doc_id")
    both = retrieval.add_documents(store.withColumn("old", F.lit(True)), fresh, "id")
    return both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count(F.lit(1)).alias("stored")).unpivot(
        [], ["added", "stored"], "what", "texts")


@query("k8_store_count", "SELECT count(DISTINCT md5(text)) AS documents FROM documents")
def k8_store_count(spark, d):
    return retrieval.first_copies(st.table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").agg(
        F.count(F.lit(1)).alias("documents"))


_CENTROIDS = """
parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centroids AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM parts GROUP BY 1, 2) GROUP BY 1),
"""


def _near(where="true"):
    return f"""WITH {_CENTROIDS}
near AS (SELECT query_id, vec_id, label, list_cosine_distance(embedding::DOUBLE[], q) AS distance,
                row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_distance(embedding::DOUBLE[], q), vec_id) AS place
         FROM embeddings, centroids WHERE {where} QUALIFY place <= 5)
"""


def _search(spark, d, where=None):
    vectors = st.table(spark, d, "embeddings")
    return retrieval.nearest(vectors, retrieval.centroids(vectors, "label"), where=where)


_NEAR_ROW = "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(place AS BIGINT) AS place, vec_id, round(distance, 6) AS distance FROM near"


def _near_row(found):
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("place").cast("bigint").alias("place"),
                        "vec_id", F.round("distance", 6).alias("distance"))


@query("k4_nearest", _near() + _NEAR_ROW)
def k4_nearest(spark, d):
    return _near_row(_search(spark, d))


@query("k4_nearest_of_all", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(a.e, b.e)) AS place,
                list_cosine_distance(a.e, b.e) AS distance FROM v a, v b QUALIFY place <= 5)
SELECT vec_id AS query_id, CAST(place AS BIGINT) AS place, abs(round(distance, 6)) AS distance FROM near
""")
def k4_nearest_of_all(spark, d):
    """Every vector as a query."""
    vectors = st.table(spark, d, "embeddings")
    found = retrieval.nearest(vectors, vectors.select(F.col("vec_id").alias("query_id"), "embedding"))
    return found.select("query_id", F.col("place").cast("bigint").alias("place"), F.abs(F.round("distance", 6)).alias("distance"))


@query("w5_nearest_place", _near() + "SELECT CAST(query_id AS BIGINT) AS query_id, vec_id FROM near WHERE place = 1")
def w5_nearest_place(spark, d):
    return _search(spark, d).where(F.col("place") == 1).select(F.col("query_id").cast("bigint").alias("query_id"), "vec_id")


@query("k5_filtered_nearest", _near("label <> 3 AND label <> 7") + _NEAR_ROW)
def k5_filtered_nearest(spark, d):
    return _near_row(_search(spark, d, where=~F.col("label").isin(3, 7)))


@query("k7_context_text", _near() + """
SELECT CAST(n.query_id AS BIGINT) AS query_id,
       string_agg(concat('[', n.place, '] ', coalesce(t.source, 'Unknown'), ' ', coalesce(t.lang, ''), chr(10), t.text),
                  concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY n.place) AS context
FROM near n JOIN documents t ON t.doc_id = n.vec_id GROUP BY 1
""")
def k7_context_text(spark, d):
    texts = st.table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.col("lang").alias("section"), "text")
    found = _search(spark, d).join(texts, "vec_id")
    return retrieval.context_text(found).withColumn("query_id", F.col("query_id").cast("bigint"))


@query("k9_retrieval_scores", _near() + """
, per AS (SELECT c.query_id, (SELECT count(*) FROM embeddings e WHERE e.label = c.query_id) AS relevant,
                 count(*) FILTER (WHERE n.label = c.query_id) AS hits, min(n.place) FILTER (WHERE n.label = c.query_id) AS first
          FROM centroids c LEFT JOIN near n USING (query_id) GROUP BY c.query_id)
SELECT round(avg(hits / 5.0::DOUBLE), 6) AS precision_at_k, round(avg(hits::DOUBLE / relevant::DOUBLE), 6) AS recall_at_k,
       round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM per
""")
def k9_retrieval_scores(spark, d):
    vectors = st.table(spark, d, "embeddings")
    found = _search(spark, d).join(vectors.select("vec_id", "label"), "vec_id")
    judged = found.withColumn("is_relevant", F.col("label") == F.col("query_id"))
    relevant = vectors.groupBy(F.col("label").alias("query_id")).agg(F.count(F.lit(1)).alias("relevant"))
    out = retrieval.retrieval_scores(judged, relevant, 5)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
