"""Deduplication, similarity, registry, embedding cache."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.catalog.registry import query
from pressloom.catalog.scalars import _SIM_TEXT, similarity_texts
from pressloom.catalog.views_sql import BATCH, ITEMS, SYND, VECS
from pressloom.functions import hashing, vectors
from pressloom.operators import dedup, registry, similarity
from pressloom.sources import embedding_cache, keyindex, tables
from pressloom.sources import sample_tables as st
from pressloom.sources.scratch import scratch_path

AS_OF = st.AS_OF
# No pair of the sample vectors reaches the usual threshold.
THRESHOLD = 0.70
# The capped query compares with the newest so many vectors; that is what it is for.
CANDIDATE_CAP = 1_000


def history(spark, sf, **kw):
    return st.before_split(st.items_synd(spark, sf, **kw))


def batch(spark, sf, **kw):
    return dedup.dedup_batch(st.from_split(st.items_synd(spark, sf, **kw)))


@query("ded1_dedup_batch", f"""
WITH {SYND} SELECT id, doc_id, feed_pos FROM synd
QUALIFY row_number() OVER (PARTITION BY id ORDER BY feed_pos, entry_pos) = 1""")
def _(spark, sf):
    return dedup.dedup_batch(st.items_synd(spark, sf)).select("id", "doc_id", "feed_pos")


@query("ded2_find_duplicates", f"""
WITH {BATCH}, recent AS (SELECT * FROM hist WHERE collected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY)
SELECT b.id, count(h.id) AS n_matches, count(h.id) FILTER (h.url = b.url) AS n_url_matches,
       count(h.id) FILTER (lower(h.title) = lower(b.title)) AS n_title_matches,
       arg_min(h.id, {{'c': h.collected_at, 'i': h.id}}) AS first_match_id
FROM batch b LEFT JOIN recent h ON h.url = b.url OR lower(h.title) = lower(b.title) GROUP BY b.id""")
def _(spark, sf):
    return dedup.find_duplicates(batch(spark, sf), history(spark, sf), AS_OF, 14)


@query("ded2_matching_history", f"""
WITH {BATCH} SELECT doc_id, id, url IN (SELECT url FROM batch) AS same_url,
       lower(title) IN (SELECT lower(title) FROM batch) AS same_title
FROM hist WHERE collected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY
  AND (url IN (SELECT url FROM batch) OR lower(title) IN (SELECT lower(title) FROM batch))""")
def _(spark, sf):
    out = dedup.matching_history(batch(spark, sf), history(spark, sf), AS_OF, 14, ("doc_id",))
    return out.select("doc_id", "id", "same_url", "same_title")


_URL_SQL = """by_url AS (SELECT url, arg_min(id, {'c': collected_at, 'i': id}) AS original_id FROM hist GROUP BY url)"""


@query("ded3_match_url", f"""
WITH {BATCH}, {_URL_SQL}
SELECT b.id, h.original_id IS NOT NULL AS is_duplicate, h.original_id,
       CASE WHEN h.original_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity_score,
       CASE WHEN h.original_id IS NULL THEN 'none' ELSE 'exact_url' END AS match_type
FROM batch b LEFT JOIN by_url h ON h.url = b.url""")
def _(spark, sf):
    return dedup.match_url(batch(spark, sf), history(spark, sf)).select("id", *dedup.VERDICT)


# The registry knows the items of the first twelve days; copies there keep their texts but not their urls.
_REGISTRY_SQL = f"""{ITEMS},
reg_src AS (SELECT * FROM items WHERE published_at < TIMESTAMP '2024-01-13'),
reg AS (SELECT sha256(url) AS url_hash, sha256(lower(title)) AS title_hash, sha256(lower(content)) AS content_hash,
               id AS news_item_id, collected_at AS first_seen_at FROM reg_src),
later AS (SELECT *, sha256(url) AS uh, sha256(lower(title)) AS th, sha256(lower(content)) AS ch
          FROM items WHERE published_at >= TIMESTAMP '2024-01-10'),
reg_hits AS (
  SELECT n.id, r.news_item_id, r.first_seen_at FROM later n JOIN reg r ON r.url_hash = n.uh
  UNION ALL SELECT n.id, r.news_item_id, r.first_seen_at FROM later n JOIN reg r ON r.title_hash = n.th AND r.content_hash = n.ch),
reg_first AS (SELECT id, arg_min(news_item_id, {{'f': first_seen_at, 'n': news_item_id}}) AS original_id FROM reg_hits GROUP BY id)"""


def _registry_parts(spark, sf):
    items = st.items(spark, sf)
    at = F.col("published_at")
    known = items.where(at < F.lit("2024-01-13 00:00:00").cast("timestamp_ntz"))
    later = items.where(at >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return later, registry.merge_registry(registry.registry_rows(known))


@query("ded4_match_registry", f"""
WITH {_REGISTRY_SQL}
SELECT n.id, r.original_id IS NOT NULL AS is_duplicate, r.original_id,
       CASE WHEN r.original_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity_score,
       CASE WHEN r.original_id IS NULL THEN 'none' ELSE 'exact_title' END AS match_type
FROM later n LEFT JOIN reg_first r ON r.id = n.id""")
def _(spark, sf):
    later, known = _registry_parts(spark, sf)
    return dedup.match_registry(later, known).select("id", *dedup.VERDICT)


_COS = "(list_cosine_similarity({a}, {b}) + 1) / 2"


@query("ded5_cosine01", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, round({_COS.format(a='a.v', b='b.v')}, 6) AS cosine01 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    v = st.table(spark, sf, "embeddings").select("vec_id", "embedding")
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(following, "vec_id").select("vec_id", vectors.cosine01(F.col("embedding"), F.col("other")).alias("cosine01"))


def _queries(v):
    return v.select(F.col("vec_id").cast("string").alias("query_id"), "embedding", "published_at")


def _cands(v):
    return v.select(F.col("vec_id").cast("string").alias("cand_id"), F.col("vec_id").alias("cand_pos"), "embedding", "published_at")


def _similar_sql(k: int, threshold: float, where: str = "TRUE", q: str = "TRUE", c: str = "TRUE") -> str:
    return f"""
WITH {VECS} SELECT query_id, cand_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, cand_pos) AS rank FROM (
    SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(c.vec_id AS VARCHAR) AS cand_id, c.vec_id AS cand_pos,
           {_COS.format(a='q.v', b='c.v')} AS score
    FROM (SELECT * FROM vecs WHERE {q}) q, (SELECT * FROM vecs WHERE {c}) c WHERE {where})
  WHERE score >= {threshold})
WHERE rank <= {k}"""


@query("ded6_top_similar_capped", f"""
WITH {VECS}, cands AS (SELECT * FROM vecs ORDER BY published_at DESC NULLS LAST, vec_id LIMIT 1000)
SELECT query_id, cand_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, cand_pos) AS rank FROM (
    SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(c.vec_id AS VARCHAR) AS cand_id, c.vec_id AS cand_pos,
           {_COS.format(a='q.v', b='c.v')} AS score FROM vecs q, cands c)
  WHERE score >= {THRESHOLD}) WHERE rank <= 5""")
def _(spark, sf):
    v = st.vectors(spark, sf)
    newest = v.orderBy(F.desc_nulls_last("published_at"), "vec_id").limit(CANDIDATE_CAP)
    return similarity.top_similar_small(_queries(v), _cands(newest), THRESHOLD, 5).drop("cand_pos")


@query("ded6_top_similar", _similar_sql(3, 0.66))
def _(spark, sf):
    v = st.vectors(spark, sf)
    return similarity.top_similar_large(_queries(v), _cands(v), 0.66, 3).drop("cand_pos")


@query("ded6_top_similar_near_in_time", _similar_sql(
    3, 0.60, "abs(epoch(q.published_at) - epoch(c.published_at)) <= 7 * 86400"))
def _(spark, sf):
    v = st.vectors(spark, sf)
    return similarity.top_similar_large(_queries(v), _cands(v), 0.60, 3, within_days=7).drop("cand_pos")


@query("ded7_candidates", f"""
WITH {ITEMS} SELECT id, CAST(published_at AS VARCHAR) AS published_at FROM items
WHERE published_at < TIMESTAMP '2024-01-24' AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND NOT is_duplicate""")
def _(spark, sf):
    past = st.before_split(st.items(spark, sf, duplicates=True))
    return dedup.candidates(past, AS_OF).select("id", "published_at")


_SEMANTIC = f"""{VECS},
new AS (SELECT * FROM vecs WHERE published_at >= TIMESTAMP '2024-01-24'),
old AS (SELECT * FROM vecs WHERE published_at < TIMESTAMP '2024-01-24' AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY),
pairs AS (SELECT n.id, o.id AS cand_id, o.published_at AS cand_at, n.published_at, {_COS.format(a='n.v', b='o.v')} AS score FROM new n, old o)"""


def _semantic_sql(threshold: float, gate_first: bool) -> str:
    near = "abs(epoch(published_at) - epoch(cand_at)) <= 7 * 86400"
    pool = f"AND {near}" if gate_first else ""
    return f"""
WITH {_SEMANTIC}, best AS (
  SELECT * FROM pairs WHERE score >= {threshold} {pool}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, cand_at DESC, cand_id) = 1),
hits AS (SELECT * FROM best WHERE {near})
SELECT n.id, h.id IS NOT NULL AS is_duplicate, h.cand_id AS original_id, round(coalesce(h.score, 0.0), 6) AS similarity_score,
       CASE WHEN h.id IS NULL THEN 'none' ELSE 'similar_content' END AS match_type
FROM new n LEFT JOIN hits h ON h.id = n.id"""


def _semantic_parts(spark, sf):
    v = st.vectors(spark, sf).withColumn("is_duplicate", F.lit(False))
    new = st.from_split(v).drop("is_duplicate")
    return new, dedup.candidates(st.before_split(v), AS_OF)


@query("ded8_match_semantic", _semantic_sql(0.60, False))
def _(spark, sf):
    new, cands = _semantic_parts(spark, sf)
    return dedup.match_semantic(new, cands, 0.60).select("id", *dedup.VERDICT)


@query("ded8_match_semantic_gate_first", _semantic_sql(0.60, True))
def _(spark, sf):
    new, cands = _semantic_parts(spark, sf)
    return dedup.match_semantic(new, cands, 0.60, gate="before_best").select("id", *dedup.VERDICT)


# Items of the cascade: copies share their url on every fourth text, so each step finds something.
_CASCADE = f"""{ITEMS},
casc AS (SELECT i.id, i.content, i.title, i.published_at, i.collected_at, CAST(e.embedding AS DOUBLE[]) AS v,
                CASE WHEN length(i.content) % 4 = 0 THEN 'https://example.com/a/' || substr(sha256(i.content), 1, 16) ELSE i.url END AS url
         FROM items i LEFT JOIN embeddings e ON e.vec_id = i.doc_id),
new AS (SELECT * FROM casc WHERE published_at >= TIMESTAMP '2024-01-20'),
old AS (SELECT * FROM casc WHERE published_at < TIMESTAMP '2024-01-20'),
cands AS (SELECT * FROM old WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY),
by_url AS (SELECT url, arg_min(id, {{'c': collected_at, 'i': id}}) AS original_id FROM old GROUP BY url),
reg AS (SELECT sha256(lower(title)) AS th, sha256(lower(content)) AS ch, sha256(url) AS uh, collected_at, id FROM old),
by_reg AS (SELECT n.id, arg_min(r.id, {{'c': r.collected_at, 'i': r.id}}) AS original_id FROM new n JOIN reg r
           ON r.uh = sha256(n.url) OR (r.th = sha256(lower(n.title)) AND r.ch = sha256(lower(n.content))) GROUP BY n.id),
best AS (SELECT n.id, o.id AS original_id, n.published_at, o.published_at AS cand_at, {_COS.format(a='n.v', b='o.v')} AS score
         FROM new n, cands o WHERE {_COS.format(a='n.v', b='o.v')} >= 0.60
         QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY round(score, 12) DESC, o.published_at DESC, o.id) = 1),
by_sim AS (SELECT * FROM best WHERE abs(epoch(published_at) - epoch(cand_at)) <= 7 * 86400)"""


def _cascade_sql(with_registry: bool) -> str:
    return f"WITH {_CASCADE} {_verdicts_sql(with_registry)}"


def _verdicts_sql(with_registry: bool) -> str:
    reg = "WHEN r.original_id IS NOT NULL THEN {}" if with_registry else "WHEN FALSE THEN {}"
    return f"""
SELECT n.id, coalesce(u.original_id, {'r.original_id,' if with_registry else ''} s.original_id) IS NOT NULL AS is_duplicate,
       coalesce(u.original_id, {'r.original_id,' if with_registry else ''} s.original_id) AS original_id,
       round(CASE WHEN u.original_id IS NOT NULL THEN 1.0 {reg.format('1.0')} ELSE coalesce(s.score, 0.0) END::DOUBLE, 6) AS similarity_score,
       CASE WHEN u.original_id IS NOT NULL THEN 'exact_url' {reg.format("'exact_title'")}
            WHEN s.original_id IS NOT NULL THEN 'similar_content' ELSE 'none' END AS match_type
FROM new n LEFT JOIN by_url u ON u.url = n.url LEFT JOIN by_reg r ON r.id = n.id LEFT JOIN by_sim s ON s.id = n.id"""


def cascade_parts(spark, sf, texts=False):
    docs = st.items(spark, sf)
    shared = F.concat(F.lit("https://example.com/a/"), F.left(F.sha2("content", 256), F.lit(16)))
    docs = docs.withColumn("url", F.when(F.col("content_length") % 4 == 0, shared).otherwise(F.col("url")))
    docs = dedup.with_dedup_hashes(docs).select(
        "doc_id", "id", "url", "published_at", "collected_at", "url_hash", "title_hash", "content_hash",
        *(["title", "content"] if texts else []),
    )
    vecs = st.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    both = docs.join(vecs, "doc_id", "left").withColumn("is_duplicate", F.lit(False))
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    old = both.where(F.col("published_at") < cut)
    new = both.where(F.col("published_at") >= cut).drop("is_duplicate")
    seen = old.select(
        "url_hash", "title_hash", "content_hash", F.col("id").alias("news_item_id"),
        F.col("collected_at").alias("first_seen_at"), F.col("collected_at").alias("last_seen_at"),
        F.lit(1).cast("long").alias("occurrence_count"),
    )
    return new, old, seen, dedup.candidates(old, AS_OF)


@query("ded9_dedup_cascade", _cascade_sql(True))
def _(spark, sf):
    new, old, seen, cands = cascade_parts(spark, sf)
    return dedup.dedup_cascade(new, old, seen, cands, 0.60).select("id", *dedup.VERDICT)


@query("ded10_dedup_batch_cascade", _cascade_sql(False))
def _(spark, sf):
    new, old, _, cands = cascade_parts(spark, sf)
    return dedup.dedup_batch_cascade(new, old, cands, 0.60).select("id", *dedup.VERDICT)


_FLAG_SQL = f"""
WITH {BATCH}, {_URL_SQL}
SELECT b.id, h.original_id IS NOT NULL AS is_duplicate, h.original_id AS duplicate_of
FROM batch b LEFT JOIN by_url h ON h.url = b.url"""


@query("ded11_flag_duplicates", _FLAG_SQL)
def _(spark, sf):
    new = batch(spark, sf)
    verdicts = dedup.match_url(new, history(spark, sf))
    flagged = dedup.flag_duplicates(new.withColumn("is_duplicate", F.lit(False)), verdicts)
    return flagged.select("id", "is_duplicate", "duplicate_of")


@query("ded11_flag_stored", _FLAG_SQL)
def _(spark, sf):
    """As above in the stored table, where only the days with duplicates are written again."""
    path, new = scratch_path(spark, "items"), batch(spark, sf)
    tables.write_items(tables.as_items(new.withColumn("is_duplicate", F.lit(False))), path)
    tables.flag_stored(spark, path, dedup.match_url(new, history(spark, sf)))
    return tables.read_items(spark, path).select("id", "is_duplicate", "duplicate_of")


@query("flt3_known_urls", f"""
WITH {BATCH} SELECT b.id, arg_min(h.id, {{'c': h.collected_at, 'i': h.id}}) AS first_id
FROM batch b JOIN hist h ON h.url = b.url GROUP BY b.id""")
def _(spark, sf):
    """Stored items by url through the key index, which was written in two parts."""
    path, new, past = scratch_path(spark, "keys"), batch(spark, sf), history(spark, sf)
    for part in (0, 1):
        keyindex.write_keys(past.where(F.pmod("doc_id", F.lit(2)) == part), path, part)
    found = keyindex.known(new, path, "url").groupBy("url").agg(F.min(F.struct("collected_at", "id")).alias("first"))
    return new.join(found, "url").select("id", F.col("first.id").alias("first_id"))


_SIGHTINGS = f"""{SYND},
reg AS (SELECT sha256(url) AS url_hash, arg_min(id, {{'c': collected_at, 'i': id}}) AS news_item_id,
               min(collected_at) AS first_seen_at, max(collected_at) AS last_seen_at, count(*) AS occurrence_count,
               arg_min(sha256(lower(title)), {{'c': collected_at, 'i': id}}) AS title_hash, arg_min(sha256(lower(content)), {{'c': collected_at, 'i': id}}) AS content_hash
        FROM synd GROUP BY url)"""


def _registry(spark, sf):
    before = registry.merge_registry(registry.registry_rows(history(spark, sf)))
    return registry.upsert_registry(before, st.from_split(st.items_synd(spark, sf)))


@query("ded12_upsert_registry", f"""
WITH {_SIGHTINGS} SELECT url_hash, news_item_id, CAST(first_seen_at AS VARCHAR) AS first_seen_at,
       CAST(last_seen_at AS VARCHAR) AS last_seen_at, occurrence_count, title_hash, content_hash FROM reg""")
def _(spark, sf):
    return _registry(spark, sf)


@query("ded13_expire_registry", f"""
WITH {_SIGHTINGS} SELECT url_hash, occurrence_count FROM reg WHERE last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY""")
def _(spark, sf):
    return registry.expire_registry(_registry(spark, sf), AS_OF, 10).select("url_hash", "occurrence_count")


@query("ded13_expired_count", f"""
WITH {_SIGHTINGS} SELECT count(*) FILTER (last_seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY) AS removed,
       count(*) FILTER (last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY) AS kept FROM reg""")
def _(spark, sf):
    return registry.expired_count(_registry(spark, sf), AS_OF, 10)


def _cache(spark, sf):
    """Cache rows of the texts of all history items, made with the stand-in embedder."""
    keyed = similarity_texts(history(spark, sf)).select(
        hashing.cache_key(F.col("text"), "model-a").alias("cache_key"), "text", "collected_at"
    )
    once = keyed.groupBy("cache_key").agg(F.first("text").alias("text"), F.min("collected_at").alias("created_at"))
    return once.select("cache_key", stand_in_embedder(F.col("text")).alias("embedding"), "created_at")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def stand_in_embedder(texts: pd.Series) -> pd.Series:
    """No model is at hand: two numbers of the text in place of a vector."""
    return texts.map(lambda t: [float(len(t)), float(t.count(" "))])


_SYND_KEY = f"sha256('model-a:' || {_SIM_TEXT})"
_CACHE_SQL = f"""{SYND},
keyed AS (SELECT *, {_SIM_TEXT} AS sim_text, {_SYND_KEY} AS cache_key FROM synd),
cache AS (SELECT cache_key, min(collected_at) AS created_at FROM keyed WHERE published_at < TIMESTAMP '2024-01-24' GROUP BY 1)"""


@query("ded14_expire_cache", f"""
WITH {_CACHE_SQL} SELECT cache_key FROM cache WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY""")
def _(spark, sf):
    return registry.expire_cache(_cache(spark, sf), AS_OF, 14).select("cache_key")


@query("ded15_embed_with_cache", f"""
WITH {_CACHE_SQL} SELECT doc_id, k.cache_key, c.cache_key IS NOT NULL AS from_cache, length(sim_text)::DOUBLE AS first_number
FROM keyed k LEFT JOIN cache c ON c.cache_key = k.cache_key""")
def _(spark, sf):
    items = similarity_texts(st.items_synd(spark, sf))
    embedded, _ = registry.embed_with_cache(items, _cache(spark, sf), stand_in_embedder, "model-a", AS_OF, spread_by=("doc_id",))
    return embedded.select("doc_id", "cache_key", "from_cache", F.col("embedding")[0].cast("double").alias("first_number"))


def _stored_cache(spark, sf):
    """The cache rows as a stored table: its name and path."""
    path = scratch_path(spark, "cache")
    name = f"cache_{path[-32:]}"
    embedding_cache.open_cache(spark, name, path, 4)
    embedding_cache.add(_cache(spark, sf), name)
    return name, path


@query("ded15_stored_cache", f"""
WITH {_CACHE_SQL} SELECT doc_id, k.cache_key, c.cache_key IS NOT NULL AS from_cache, length(sim_text)::DOUBLE AS first_number
FROM keyed k LEFT JOIN cache c ON c.cache_key = k.cache_key""")
def _(spark, sf):
    name, _ = _stored_cache(spark, sf)
    items = similarity_texts(st.items_synd(spark, sf))
    embedded = embedding_cache.embed(items, name, stand_in_embedder, "model-a", AS_OF, spread_by=("doc_id",))
    return embedded.select("doc_id", "cache_key", "from_cache", F.col("embedding")[0].cast("double").alias("first_number"))


@query("ded14_expire_stored_cache", f"""
WITH {_CACHE_SQL} SELECT cache_key FROM cache WHERE CAST(created_at AS DATE) >= CAST(TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AS DATE)""")
def _(spark, sf):
    """Whole days go."""
    name, path = _stored_cache(spark, sf)
    embedding_cache.expire(spark, name, path, AS_OF, 14)
    return spark.table(name).select("cache_key")
