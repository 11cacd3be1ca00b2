"""The engine's own queries over the driver's tables, each over the whole of them, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.functions import vector as V
from notelake.functions.text_size import CJK_RANGES, size_of
from notelake.operators import embed, generators, hnsw_file, knn, metrics, rag, search, store
from notelake.operators.hnsw import HNSWConfig
from notelake.plans.catalogue import query
from notelake.runtime import cut, ensure_checkpoint_dir, read, ship
from notelake.sources import tables
from notelake.streaming import changes

DIM = 64
LEAST_AGREEMENT = 0.9

# ---- SQL pieces ----

_CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
_BLANK = "\\p{Zs}\\t\\n\\v\\f\\r\\x{85}\\x{2028}\\x{2029}"
_NL = "\\n\\v\\f\\r\\x{85}\\x{2028}\\x{2029}"


def _size(t: str) -> str:
    no_cjk = f"regexp_replace({t}, '[{_CJK}]+', '', 'g')"
    return f"(length({t}) - length({no_cjk}) + (length(regexp_replace({no_cjk}, '[{_BLANK}]+', '', 'g')) + 3) // 4)::INT"


def _trim(t: str) -> str:
    return f"regexp_replace({t}, '^[\\p{{Zs}}\\t]+|[\\p{{Zs}}\\t]+$', '', 'g')"


def _valid(e: str) -> str:
    return f"len({e}) = {DIM} AND len(list_filter({e}, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}"


_LATEST = """latest AS (
  SELECT note_id, title, content, created_at, updated_at, needs_reindexing FROM notes WHERE note_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY updated_at DESC NULLS LAST, NOT coalesce(needs_reindexing, false) DESC,
    title DESC NULLS LAST, content DESC NULLS LAST, created_at DESC NULLS LAST, needs_reindexing DESC NULLS LAST) = 1)"""
_V = f"""v AS (
  SELECT chunk_id AS id, min(note_id) AS note_id, max(content) AS content, any_value(embedding)::DOUBLE[] AS vec
  FROM chunks WHERE chunk_id IS NOT NULL AND {_valid('embedding')} GROUP BY 1)"""
_Q = f"""q AS (
  SELECT c.id AS query_id, c.text AS text, c.embedding::DOUBLE[] AS qvec
  FROM (SELECT unnest(cases) AS c FROM reference_embeddings) WHERE {_valid('c.embedding')})"""
_SCORED = "scored AS (SELECT query_id, id, round(list_inner_product(vec, qvec), 12) AS score FROM v, q)"


def _top(k: int) -> str:
    return f"top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= {k})"


_HITS = """hits AS (
  SELECT t.query_id, t.rank, t.id AS chunk_id, v.note_id, n.title, v.content, t.score
  FROM top t JOIN v USING (id) JOIN latest n ON n.note_id = v.note_id)"""
_SELECTED = """sized AS (
  SELECT *, %s AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_no FROM hits),
selected AS (
  SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total_tokens FROM sized
  QUALIFY total_tokens <= 1500 OR source_no = 1)""" % _size("content")


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_PARAS = f"""paras AS (
  SELECT note_id, list_filter(list_transform(string_split_regex(content, '[{_NL}]'), lambda p: {_trim('p')}), lambda p: p <> '') AS p FROM latest WHERE content IS NOT NULL)"""
_SENT = r"[^.!?。！？]*[.!?。！？]+\s*|[^.!?。！？]+$"

# Chunking in SQL: graphemes and units are folded by list_reduce, whose elements are states of the fold.


def _hard(t: str) -> str:
    """Pieces of graphemes of at most 400 by size."""
    g = f"list_transform(range(1, length_grapheme({t}) + 1), lambda i: substring_grapheme({t}, i, 1))"
    state = f"""list_transform({g}, lambda g: {{'done': []::VARCHAR[], 'cur': g, 'c': length(g) - length(regexp_replace(g, '[{_CJK}]', '', 'g')),
      'o': length(regexp_replace(g, '[{_CJK}{_BLANK}]', '', 'g'))}})"""
    over = "a.c + x.c + (a.o + x.o + 3) // 4 > 400"
    fold = f"""list_reduce({state}, lambda a, x: CASE WHEN {over} THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur, 'c': x.c, 'o': x.o}}
      ELSE {{'done': a.done, 'cur': a.cur || x.cur, 'c': a.c + x.c, 'o': a.o + x.o}} END)"""
    return f"list_transform([{fold}], lambda z: list_append(z.done, z.cur))[1]"


_UNITS = f"""large AS (SELECT DISTINCT s FROM (SELECT unnest(flatten(list_transform(list_filter(p, lambda x: {_size('x')} > 400),
    lambda x: list_filter(list_transform(regexp_extract_all(x, '{_SENT}'), lambda y: {_trim('y')}), lambda y: y <> '')))) AS s FROM paras) WHERE {_size('s')} > 400),
cut AS (SELECT s, {_hard('s')} AS pieces FROM large),
line AS (SELECT note_id, unnest(p) AS p, unnest(range(1, len(p) + 1)) AS i FROM paras),
sent AS (SELECT note_id, i, unnest(CASE WHEN {_size('p')} <= 400 THEN [p] ELSE list_filter(list_transform(regexp_extract_all(p, '{_SENT}'), lambda y: {_trim('y')}), lambda y: y <> '') END) AS s,
    unnest(range(1, 1 + len(CASE WHEN {_size('p')} <= 400 THEN [p] ELSE list_filter(list_transform(regexp_extract_all(p, '{_SENT}'), lambda y: {_trim('y')}), lambda y: y <> '') END))) AS j FROM line),
pc AS (SELECT note_id, i, j, unnest(coalesce(pieces, [sent.s])) AS t, unnest(range(1, 1 + len(coalesce(pieces, [sent.s])))) AS k FROM sent LEFT JOIN cut USING (s)),
un AS (SELECT note_id, list({{'done': []::VARCHAR[], 'cur': [{{'t': t, 'n': {_size('t')}}}], 'tok': {_size('t')}}} ORDER BY i, j, k) AS u FROM pc GROUP BY 1)"""
_TAIL = """list_filter(list_transform(range(1, len(a.cur) + 2), lambda i: a.cur[i:]), lambda r: coalesce(list_sum(list_transform(r, lambda y: y.n)), 0) <= 50)[1]"""
_CHUNKED = f"""fold AS (SELECT note_id, list_reduce(u, lambda a, x: CASE WHEN a.tok + x.tok <= 300 THEN {{'done': a.done, 'cur': list_concat(a.cur, x.cur), 'tok': a.tok + x.tok}}
    ELSE list_transform([CASE WHEN coalesce(list_sum(list_transform({_TAIL}, lambda y: y.n)), 0) + x.tok > 400 THEN x.cur ELSE list_concat({_TAIL}, x.cur) END],
      lambda w: {{'done': list_append(a.done, array_to_string(list_transform(a.cur, lambda y: y.t), chr(10))), 'cur': w, 'tok': list_sum(list_transform(w, lambda y: y.n))::INT}})[1] END) AS s FROM un),
chunked AS (SELECT note_id, unnest(c) AS content, unnest(range(0, len(c)))::INT AS chunk_index
  FROM (SELECT note_id, list_append(s.done, array_to_string(list_transform(s.cur, lambda y: y.t), chr(10))) AS c FROM fold))"""
_CHUNK_ID = "sha256(note_id || ':' || chunk_index || ':' || content)"

# ---- inputs ----


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_notes(read(spark, d, "notes"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return embed.valid_vectors(read(spark, d, "chunks"), DIM)


def _cases(spark: SparkSession, d: str) -> DataFrame:
    c = tables.reference_cases(read(spark, d, "reference_embeddings")).where(V.is_valid(F.col("embedding"), DIM))
    return c.select(F.col("id").alias("query_id"), "text", F.col("embedding").alias("qvec"))


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return search.top_chunks(_vectors(spark, d), _latest(spark, d), _cases(spark, d).select("query_id", "qvec"), k, DIM)


# ---- scans and the store ----


@query("notes_recent_first", "SELECT note_id, title, epoch_us(updated_at) AS updated_us FROM notes ORDER BY updated_at DESC NULLS LAST, note_id")
def notes_recent_first(spark, d):
    return tables.notes_recent_first(read(spark, d, "notes")).select("note_id", "title", F.unix_micros("updated_at").alias("updated_us"))


@query("chunk_scan", f"""SELECT note_id, count(*) AS n_chunks, count(DISTINCT chunk_id) AS n_distinct,
  sum(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_pending, sum(length(content))::BIGINT AS n_chars FROM chunks GROUP BY note_id""")
def chunk_scan(spark, d):
    return read(spark, d, "chunks").groupBy("note_id").agg(
        F.count("*").alias("n_chunks"), F.countDistinct("chunk_id").alias("n_distinct"),
        F.sum(F.when(F.col("embedding").isNull(), 1).otherwise(0)).alias("n_pending"), F.sum(F.length("content").cast("long")).alias("n_chars"),
    )


@query("note_latest_state", _with(_LATEST) + "SELECT note_id, title, md5(content) AS content_md5, epoch_us(updated_at) AS updated_us, needs_reindexing FROM latest")
def note_latest_state(spark, d):
    return _latest(spark, d).select("note_id", "title", F.md5("content").alias("content_md5"), F.unix_micros("updated_at").alias("updated_us"), "needs_reindexing")


@query("store_create", _with(_LATEST, """new AS (SELECT 1000000000000 + doc_id AS note_id, source AS title, text AS content FROM documents)""") + """
SELECT note_id, title, md5(content) AS content_md5, needs_reindexing FROM latest UNION ALL
SELECT note_id, title, md5(content), true FROM new""")
def store_create(spark, d):
    new = read(spark, d, "documents").select((F.lit(1000000000000) + F.col("doc_id")).alias("note_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return store.create(_latest(spark, d), new, F.timestamp_seconds(F.lit(1_700_000_000))).select("note_id", "title", F.md5("content").alias("content_md5"), "needs_reindexing")


@query("store_update", _with(_LATEST, "ch AS (SELECT doc_id AS note_id, source AS new_title, text AS new_content FROM documents)") + """
SELECT l.note_id, CASE WHEN c.note_id IS NULL THEN title ELSE new_title END AS title,
  md5(CASE WHEN c.note_id IS NULL THEN content ELSE new_content END) AS content_md5,
  coalesce(needs_reindexing, false) OR (c.note_id IS NOT NULL AND content IS DISTINCT FROM new_content) AS needs_reindexing
FROM latest l LEFT JOIN ch c ON l.note_id = c.note_id""")
def store_update(spark, d):
    ch = read(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("new_title"), F.col("text").alias("new_content"))
    return store.update(_latest(spark, d), ch, F.timestamp_seconds(F.lit(1_700_000_000))).select("note_id", "title", F.md5("content").alias("content_md5"), "needs_reindexing")


_GONE = "gone AS (SELECT note_id FROM latest WHERE content IS NULL OR regexp_replace(content, '[\\s\\p{Z}]+', '', 'g') = '')"


@query("cascade_delete", _with(_LATEST, _GONE) + """
SELECT 'note' AS kind, note_id::VARCHAR AS id FROM latest WHERE note_id NOT IN (SELECT note_id FROM gone) UNION ALL
SELECT 'chunk', chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.note_id = c.note_id)""")
def cascade_delete(spark, d):
    notes = _latest(spark, d)
    gone = notes.where(F.col("content").isNull() | (F.regexp_replace("content", r"[\s\p{Z}]+", "") == ""))
    n, c = store.delete(notes, read(spark, d, "chunks"), gone)
    return n.select(F.lit("note").alias("kind"), F.col("note_id").cast("string").alias("id")).unionByName(c.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")))


@query("reindex_dirty", _with(_LATEST, _PARAS.replace("FROM latest WHERE", "FROM latest WHERE needs_reindexing AND"), _UNITS, _CHUNKED) + f"""
SELECT chunk_id, note_id, chunk_index, md5(content) AS content_md5 FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.needs_reindexing AND l.note_id = c.note_id)
UNION ALL SELECT {_CHUNK_ID}, note_id, chunk_index, md5(content) FROM chunked""")
def reindex_dirty(spark, d):
    """Chunks after the flagged notes are chunked anew."""
    _, c = store.reindex(_latest(spark, d), read(spark, d, "chunks"))
    return c.select("chunk_id", "note_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("chunk_notes", _with(_LATEST, _PARAS, _UNITS, _CHUNKED) + f"SELECT {_CHUNK_ID} AS chunk_id, note_id, chunk_index, length(content)::INT AS n_chars, {_size('content')} AS tokens FROM chunked")
def chunk_notes(spark, d):
    """Chunks of all notes by budgeted packing."""
    return store.chunk_notes(_latest(spark, d)).select("chunk_id", "note_id", "chunk_index", F.length("content").alias("n_chars"), size_of(F.col("content")).alias("tokens"))


# ---- text ----


@query("token_estimate", f"SELECT doc_id, {_size('text')} AS tokens FROM documents")
def token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", size_of(F.col("text")).alias("tokens"))


@query("note_token_estimate", _with(_LATEST) + f"SELECT note_id, {_size('content')} AS tokens FROM latest")
def note_token_estimate(spark, d):
    return _latest(spark, d).select("note_id", size_of(F.col("content")).alias("tokens"))


@query("paragraph_units", _with(_LATEST, _PARAS) + "SELECT note_id, (i - 1)::INT AS i, p[i] AS paragraph FROM (SELECT note_id, p, unnest(range(1, len(p) + 1)) AS i FROM paras)")
def paragraph_units(spark, d):
    return _latest(spark, d).select("note_id", F.posexplode(T.paragraphs(F.col("content"))).alias("i", "paragraph"))


@query("sentence_units", _with(_LATEST, _PARAS, f"""s AS (SELECT note_id, list_transform(p, lambda x: list_filter(list_transform(regexp_extract_all(x, '{_SENT}'), lambda y: {_trim('y')}), lambda y: y <> '')) AS s FROM paras)""")
       + "SELECT note_id, len(flatten(s))::INT AS n_sentences, md5(array_to_string(flatten(s), chr(10))) AS sentences_md5 FROM s")
def sentence_units(spark, d):
    s = F.flatten(F.transform(T.paragraphs(F.col("content")), T.sentences))
    return _latest(spark, d).where("content is not null").select("note_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "\n")).alias("sentences_md5"))


@query("hard_split", f"""WITH c AS (SELECT chunk_id, max(content) AS t FROM chunks WHERE content IS NOT NULL GROUP BY 1),
h AS (SELECT chunk_id, {_hard('t')} AS p FROM c WHERE {_size('t')} > 400),
f AS (SELECT chunk_id, unnest(range(0, len(p)))::INT AS i, unnest(p) AS piece FROM h) SELECT chunk_id, i, length(piece)::INT AS n_chars, {_size('piece')} AS tokens FROM f""")
def hard_split(spark, d):
    """Pieces of every chunk above the limit by graphemes alone."""
    c = read(spark, d, "chunks").where("content is not null").groupBy("chunk_id").agg(F.max("content").alias("content")).where(size_of(F.col("content")) > 400)
    return c.select("chunk_id", F.posexplode(T.hard_split(F.col("content"), 400)).alias("i", "piece")).select("chunk_id", "i", F.length("piece").alias("n_chars"), size_of(F.col("piece")).alias("tokens"))


@query("query_texts", """SELECT q.id AS query_id, 'query: ' || regexp_replace(q.text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS query_text
FROM (SELECT unnest(queries) AS q FROM eval_set) WHERE regexp_replace(q.text, '[\\s\\p{Z}]+', '', 'g') <> ''""")
def query_texts(spark, d):
    return search.asked(tables.eval_queries(read(spark, d, "eval_set"))).select("query_id", T.with_prefix("query", F.col("text")).alias("query_text"))


@query("title_default", _with(_LATEST) + "SELECT note_id, CASE WHEN title IS NULL OR title = '' THEN '無題' ELSE title END AS title FROM latest")
def title_default(spark, d):
    return _latest(spark, d).select("note_id", T.title_or_default(F.col("title")).alias("title"))


# ---- vectors ----


@query("vector_norms", _with(_V) + "SELECT id, round(sqrt(list_inner_product(vec, vec)), 6) AS norm FROM v")
def vector_norms(spark, d):
    return _vectors(spark, d).select("id", F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query("l2_normalize", _with(_V) + f""", n AS (SELECT id, vec, sqrt(list_inner_product(vec, vec)) AS n FROM v), u AS (SELECT id, n, unnest(range(0, {DIM}))::INT AS i, unnest(vec) AS x FROM n)
SELECT id, i, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS x FROM u""".replace("\n, n", ", n"))
def l2_normalize(spark, d):
    return _vectors(spark, d).select("id", F.posexplode(V.l2_normalize(F.col("vec"))).alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


@query("cosine_pairs", _with(_V) + """SELECT a.id AS id_a, b.id AS id_b, round(CASE WHEN list_inner_product(a.vec, a.vec) > 0 AND list_inner_product(b.vec, b.vec) > 0 THEN
  list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))) END, 6) AS cosine
FROM (SELECT v.*, c.i FROM v JOIN (SELECT chunk_id, min(chunk_index) AS i FROM chunks GROUP BY 1) c ON v.id = c.chunk_id) a
JOIN (SELECT v.*, c.i FROM v JOIN (SELECT chunk_id, min(chunk_index) AS i FROM chunks GROUP BY 1) c ON v.id = c.chunk_id) b
ON a.note_id = b.note_id AND b.i = a.i + 1""")
def cosine_pairs(spark, d):
    """Cosines of a note's consecutive chunks."""
    at = read(spark, d, "chunks").groupBy(F.col("chunk_id").alias("id")).agg(F.min("chunk_index").alias("i"))
    v = _vectors(spark, d).join(at, "id")
    a = v.select(F.col("id").alias("id_a"), F.col("vec").alias("va"), "note_id", (F.col("i") + 1).alias("i"))
    b = v.select(F.col("id").alias("id_b"), F.col("vec").alias("vb"), "note_id", "i")
    return a.join(b, ["note_id", "i"]).select("id_a", "id_b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query("vector_codec", f"SELECT vec_id, (4 * len(embedding))::INT AS n_bytes, unnest(range(0, len(embedding)))::INT AS i, round(unnest(embedding)::DOUBLE, 7) AS x FROM embeddings")
def vector_codec(spark, d):
    """Vectors through bytes and back, number by number."""
    v = read(spark, d, "embeddings").select("vec_id", V.to_bytes("embedding").alias("b"))
    out = v.select("vec_id", F.length("b").alias("n_bytes"), F.posexplode(V.from_bytes("b")).alias("i", "x"))
    return out.select("vec_id", "n_bytes", "i", F.round(F.col("x").cast("double"), 7).alias("x"))


@query("index_count", _with(_V) + "SELECT count(*) AS live FROM v")
def index_count(spark, d):
    return _vectors(spark, d).agg(F.count("*").alias("live"))


_VERSIONS = f"vv AS (SELECT chunk_id AS id, embedding::DOUBLE[] AS vec, chunk_index AS version FROM chunks WHERE chunk_id IS NOT NULL AND {_valid('embedding')})"


@query("upsert_latest", _with(_VERSIONS, """up AS (SELECT * FROM vv UNION ALL SELECT id, list_transform(vec, lambda x: -0.5 * x), version + 1 FROM vv WHERE version % 2 = 1
  UNION ALL SELECT id, list_transform(vec, lambda x: 2 * x), version - 1 FROM vv WHERE version % 3 = 0)""")
       + "SELECT id, version::BIGINT AS version, round(list_sum(vec), 6) AS total FROM up QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, vec DESC) = 1")
def upsert_latest(spark, d):
    """Later vectors for every second chunk replace theirs, earlier ones for every third don't."""
    v = read(spark, d, "chunks").where(F.col("chunk_id").isNotNull() & V.is_valid(F.col("embedding"), DIM))
    v = v.select(F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("chunk_index").cast("long").alias("version"))
    later = v.where("version % 2 = 1").select("id", F.transform("vec", lambda x: -0.5 * x).alias("vec"), (F.col("version") + 1).alias("version"))
    earlier = v.where("version % 3 = 0").select("id", F.transform("vec", lambda x: 2 * x).alias("vec"), (F.col("version") - 1).alias("version"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return knn.upsert(knn.upsert(v, later), earlier).select("id", "version", F.round(total, 6).alias("total"))


@query("index_compaction", _with(_V, _LATEST) + """SELECT n_deleted, n_live, n_deleted > 64 AND 2 * n_deleted > n_live AS compact FROM (
  SELECT count(*) FILTER (l.note_id IS NOT NULL) AS n_deleted, count(*) FILTER (l.note_id IS NULL) AS n_live FROM v LEFT JOIN (SELECT note_id FROM latest WHERE needs_reindexing) l ON l.note_id = v.note_id)""")
def index_compaction(spark, d):
    """Whether an index that lost the vectors of all flagged notes is to be rewritten."""
    stale = _latest(spark, d).where("needs_reindexing").select("note_id", F.lit(True).alias("gone"))
    n = _vectors(spark, d).join(stale, "note_id", "left").agg(F.count("gone").alias("n_deleted"), F.count(F.when(F.col("gone").isNull(), 1)).alias("n_live"))
    return n.select("n_deleted", "n_live", knn.must_compact(F.col("n_live"), F.col("n_deleted")).alias("compact"))


@query("remove_anti", _with(_V, _LATEST) + "SELECT id FROM v WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.note_id = v.note_id AND l.needs_reindexing)")
def remove_anti(spark, d):
    v = _vectors(spark, d)
    stale = v.join(_latest(spark, d).where("needs_reindexing").select("note_id"), "note_id", "left_semi")
    return knn.remove(v, stale).select("id")


@query("knn_single_k10", """SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 12) AS score FROM embeddings)
ORDER BY score DESC, vec_id LIMIT 10""".replace("ORDER BY score DESC, vec_id LIMIT 10", "QUALIFY row_number() OVER (ORDER BY t.score DESC, vec_id) <= 10").replace("FROM embeddings)\n", "FROM embeddings) t\n"))
def knn_single_k10(spark, d):
    e = read(spark, d, "embeddings")
    one = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("qvec"))
    s = knn.score_single(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), one)
    return s.orderBy(F.desc("score"), "id").limit(10).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


_KNN10 = _with(_V, _Q, _SCORED, _top(10)) + "SELECT query_id, id, rank, round(score, 6) AS score FROM top"


@query("knn_batch_k10", _KNN10)
def knn_batch_k10(spark, d):
    return knn.knn(_vectors(spark, d).select("id", "vec"), _cases(spark, d).select("query_id", "qvec"), 10, DIM).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("knn_expression_k10", _KNN10)
def knn_expression_k10(spark, d):
    return knn.knn(_vectors(spark, d).select("id", "vec"), _cases(spark, d).select("query_id", "qvec"), 10, DIM, "expression").select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _approximate(strategy):
    def run(spark, d):
        v, q = _vectors(spark, d).select("id", "vec"), _cases(spark, d).select("query_id", "qvec")
        return knn.knn(v, q, 10, DIM, strategy).select("query_id", "id", "rank", F.round("score", 6).alias("score"))

    return run


for _s in ("ivf", "lsh", "hnsw"):
    query(f"knn_{_s}_k10")(_approximate(_s))


@query("distinct_answers", _with(_V, _Q, _LATEST, _SCORED, _top(5), _HITS) + "SELECT query_id, len(list_distinct(list(note_id))) AS n_notes FROM hits GROUP BY query_id")
def distinct_answers(spark, d):
    """Notes among a question's hits, each once."""
    return _hits(spark, d, 5).groupBy("query_id").agg(F.size(F.collect_set("note_id")).cast("long").alias("n_notes"))


@query("ann_agreement", _with(_V, _Q) + "SELECT strategy, (SELECT count(*) FROM q) AS n_queries, true AS holds FROM (VALUES ('ivf'), ('lsh'), ('hnsw')) s(strategy)")
def ann_agreement(spark, d):
    """Whether the mean recall of each approximate strategy, over the inputs its query takes, is at least 0.9 (LEAST_AGREEMENT).

    The truth is the exact answer to what it asks: the k best inner products; for knn_hnsw, which ranks by cosine, over unit vectors.
    """
    return agreement(spark, d).select("strategy", "n_queries", (F.col("agreement") >= LEAST_AGREEMENT).alias("holds"))


def agreement(spark, d):
    v, q = _vectors(spark, d).select("id", "vec"), _cases(spark, d).select("query_id", "qvec")
    unit = knn.knn(v.withColumn("vec", V.l2_normalize(F.col("vec"))), q.withColumn("qvec", V.l2_normalize(F.col("qvec"))), 10, DIM)
    exact = cut(knn.knn(v, q, 10, DIM))
    truth = {"ivf": exact, "lsh": exact, "hnsw": unit}
    parts = [
        metrics.index_recall(t, knn.knn(v, q, 10, DIM, s), 0.0).agg(F.lit(s).alias("strategy"), F.count("*").alias("n_queries"), F.avg("recall").alias("agreement"))
        for s, t in truth.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("index_stats", _with(_V) + f"""SELECT count(*) AS live_count, 0::BIGINT AS tombstone_count, true AS has_links, count(*) * {4 * DIM + 16} AS least_bytes,
  true AS links_within_bound FROM v""")
def index_stats(spark, d):
    """Statistics of the index files of all chunk vectors, a shard each, built, kept and read back; links by their bounds."""
    c = HNSWConfig()
    vectors = _vectors(spark, d).select("id", V.l2_normalize(F.col("vec")).alias("vec"))
    s = hnsw_file.stats(hnsw_file.nodes_of(hnsw_file.build(vectors, 20_000, c)))
    links = F.col("total_links")
    return s.select(
        "live_count", "tombstone_count", (links > 0).alias("has_links"), (F.col("approximate_bytes") - 4 * links).alias("least_bytes"),
        (links <= F.col("live_count") * F.lit(3 * c.m)).alias("links_within_bound"),
    )


# ---- embedding ----


_BYTES = "list_transform(range(1, octet_length({b}) + 1), lambda i: ('0x' || substr(hex({b}), 2 * i - 1, 2))::UTINYINT::UHUGEINT)"
_M64 = "18446744073709551616::UHUGEINT"


@query("mock_embed", _with(_LATEST) + f""", p AS (SELECT note_id, {_BYTES.format(b="encode('passage: ' || content)")} AS b FROM latest WHERE content IS NOT NULL),
seed AS (SELECT note_id, list_reduce(list_prepend({embed.FNV_BASIS}::UHUGEINT, b), lambda h, x: xor(h, x) * {embed.FNV_PRIME}::UHUGEINT % {_M64}) AS s FROM p),
st AS (SELECT note_id, list_reduce(list_transform(range(0, {DIM + 1}), lambda i: [s]), lambda a, x: list_append(a, (a[-1] * {embed.LCG_A}::UHUGEINT + {embed.LCG_C}::UHUGEINT) % {_M64})) AS l FROM seed),
f AS (SELECT note_id, list_transform(l[2:], lambda x: ((x // 8589934592::UHUGEINT)::BIGINT::FLOAT / 2147483647::FLOAT)::FLOAT) AS v FROM st),
n AS (SELECT note_id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)))::FLOAT AS n FROM f)
SELECT note_id, unnest(range(0, {DIM}))::INT AS i, round((unnest(v) / n)::FLOAT::DOUBLE, 5) AS x FROM n""".replace("\n, p", ", p"))
def mock_embed(spark, d):
    """The deterministic stand-in over all notes, number by number."""
    ship(spark)
    e = embed.embed_texts(_latest(spark, d).where("content is not null").select("note_id", "content"), "content", "passage", embed.mock_embedder(DIM))
    return e.select("note_id", F.posexplode("vec").alias("i", "x")).select("note_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("pending_embeddings", "SELECT chunk_id, note_id, chunk_index FROM chunks WHERE embedding IS NULL")
def pending_embeddings(spark, d):
    ship(spark)
    _, done = embed.embed_pending(read(spark, d, "chunks"), embed.mock_embedder(DIM))
    return done.select("chunk_id", "note_id", "chunk_index")


@query("fixed_vectors", """SELECT q.id AS query_id, CASE WHEN c.text IS NULL THEN false ELSE true END AS fixed FROM (SELECT unnest(queries) AS q FROM eval_set)
LEFT JOIN (SELECT DISTINCT c.text AS text FROM (SELECT unnest(cases) AS c FROM reference_embeddings)) c ON c.text = 'query: ' || q.text""")
def fixed_vectors(spark, d):
    cases = tables.reference_cases(read(spark, d, "reference_embeddings")).where("text is not null").select("text").distinct()
    fixed = cases.withColumn("vec", F.array(F.lit(1.0).cast("float")))
    ship(spark)
    e = embed.embed_texts(tables.eval_queries(read(spark, d, "eval_set")), "text", "query", embed.mock_embedder(8), fixed)
    return e.select("query_id", (F.size("vec") == 1).alias("fixed"))


@query("truncate_tokens", """SELECT c.id AS id, len(c.token_ids)::INT AS n_tokens, least(len(c.token_ids), 8)::INT AS n_kept, least(len(c.token_ids), 512)::INT AS n_kept_512,
  CASE WHEN len(c.token_ids) > 8 THEN list_concat(c.token_ids[1:7], [c.token_ids[-1]]) ELSE c.token_ids END::VARCHAR AS kept FROM (SELECT unnest(cases) AS c FROM reference_embeddings)""")
def truncate_tokens(spark, d):
    c = tables.reference_cases(read(spark, d, "reference_embeddings"))
    kept = embed.truncate_tokens(F.col("token_ids"), 8)
    has = F.col("token_ids").isNotNull()
    return c.select(
        "id", F.when(has, F.size("token_ids")).alias("n_tokens"), F.when(has, F.size(kept)).alias("n_kept"), F.when(has, F.size(embed.truncate_tokens(F.col("token_ids")))).alias("n_kept_512"),
        F.when(has, F.concat(F.lit("["), F.array_join(kept.cast("array<string>"), ", "), F.lit("]"))).alias("kept"),
    )


@query("mean_pool_notes", _with(_V) + f""", d AS (SELECT note_id, unnest(range(0, {DIM}))::INT AS i, unnest(vec) AS x FROM v WHERE note_id IS NOT NULL),
m AS (SELECT note_id, i, avg(x) AS x FROM d GROUP BY ALL), n AS (SELECT note_id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT note_id, i, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS x FROM m JOIN n USING (note_id)""")
def mean_pool_notes(spark, d):
    """A vector per note: the pooled vectors of its chunks. Partial sums per dimension, so no note's chunks are gathered."""
    v = _vectors(spark, d).where("note_id is not null").select("note_id", *[F.col("vec")[i].cast("double").alias(f"d{i}") for i in range(DIM)])
    m = v.groupBy("note_id").agg(*[F.avg(f"d{i}").alias(f"d{i}") for i in range(DIM)])
    pooled = V.l2_normalize(F.array(*[F.col(f"d{i}") for i in range(DIM)]))
    return m.select("note_id", F.posexplode(pooled).alias("i", "x")).select("note_id", "i", F.round("x", 6).alias("x"))


_TOKENS = """tok AS (SELECT c.id AS id, list_transform(c.token_ids, lambda t: list_transform(range(1, 9), lambda j: (t * j % 97) / 97.0 - 0.5)) AS vecs, list_transform(c.token_ids, lambda t: CASE WHEN t % 5 = 0 THEN 0.0 ELSE 1.0 END) AS mask
  FROM (SELECT unnest(cases) AS c FROM reference_embeddings) WHERE len(c.token_ids) > 0)"""


@query("masked_mean_pool", _with(_TOKENS) + """, m AS (SELECT id, j, sum(x[j] * w) / greatest(sum(w), 1e-9) AS m FROM (SELECT id, unnest(vecs) AS x, unnest(mask) AS w FROM tok), range(1, 9) r(j) GROUP BY ALL),
n AS (SELECT id, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) SELECT id, (j - 1)::INT AS i, round(CASE WHEN n > 0 THEN m / n ELSE m END, 6) AS x FROM m JOIN n USING (id)""".replace("\n, m", ", m"))
def masked_mean_pool(spark, d):
    """Token vectors (stand-ins, made from the token ids) of every case, pooled by a mask that leaves out ids divisible by 5."""
    c = tables.reference_cases(read(spark, d, "reference_embeddings")).where(F.size("token_ids") > 0)
    vecs = F.transform("token_ids", lambda t: F.array(*[(t * j % 97) / F.lit(97.0) - F.lit(0.5) for j in range(1, 9)]))
    mask = F.transform("token_ids", lambda t: F.when(t % 5 == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    return c.select("id", F.posexplode(embed.mean_pool(vecs, mask)).alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


@query("embedder_comparison", f"""WITH p AS (SELECT bits, a, list_transform(a, lambda x: floor(x * bits + 0.5) / bits) AS b FROM (SELECT c.embedding::DOUBLE[] AS a FROM (SELECT unnest(cases) AS c FROM reference_embeddings) WHERE {_valid('c.embedding')}), (VALUES (127.0), (7.0)) t(bits)),
c AS (SELECT bits, list_inner_product(a, b) / nullif(sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)), 0) AS cosine FROM p)
SELECT bits::INT AS levels, count(cosine) AS n, round(min(cosine), 6) AS min_cosine, min(cosine) > 0.999 AS passed FROM c GROUP BY 1""")
def embedder_comparison(spark, d):
    """Reference vectors against themselves in fewer levels, by the rule of 0.999: fine levels pass, coarse ones don't."""
    c = _cases(spark, d).select(F.col("qvec").cast("array<double>").alias("a"))
    parts = []
    for levels in (127, 7):
        k = F.lit(float(levels))
        coarse = c.select("a", F.transform("a", lambda x: F.floor(x * k + 0.5) / k).alias("b"))  # noqa: B023
        parts.append(embed.compare_embedders(coarse, "a", "b").select(F.lit(levels).alias("levels"), "n", F.round("min_cosine", 6).alias("min_cosine"), "passed"))
    return parts[0].unionByName(parts[1])


@query("json_reference", """SELECT model_id, c.id AS id, md5(c.text) AS text_md5, len(c.token_ids)::INT AS n_tokens, round(list_sum(list_transform(c.embedding, lambda x: round(x::DOUBLE, 6))), 4) AS total
FROM (SELECT model_id, unnest(cases) AS c FROM reference_embeddings)""")
def json_reference(spark, d):
    """The reference vectors written as JSON to the shared folder, rounded to six places, and read back by their schema."""
    path = _shared(spark, "json_reference")
    tables.write_reference(read(spark, d, "reference_embeddings"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.round(x.cast("double"), 6))
    return tables.reference_cases(tables.read_reference(spark, path, lines=True)).select(
        "model_id", "id", F.md5("text").alias("text_md5"), F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), F.round(total, 4).alias("total"),
    )


@query("json_eval_set", "SELECT q.id AS query_id, e.key AS note_id, e.value AS grade FROM (SELECT q, unnest(map_entries(q.relevant)) AS e FROM (SELECT unnest(queries) AS q FROM eval_set))")
def json_eval_set(spark, d):
    """The labelled set written as JSON and read back by its schema: one row per label."""
    path = _shared(spark, "json_eval_set")
    read(spark, d, "eval_set").write.json(path)
    return tables.qrels(tables.read_eval_set(spark, path))


def _shared(spark, name: str) -> str:
    """A new folder in the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("reference_check", f"""SELECT model_id, len(cases) AS n_cases, len(list_filter(cases, lambda c: c.embedding IS NULL)) AS n_missing,
  round(list_min(list_transform(list_filter(cases, lambda c: len(c.embedding) = dimension), lambda c: sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])))), 6) AS least_norm,
  validation.min_cosine_vs_coreml_fp16 > 0.999 AND validation.padding_invariance_cosine > 0.999 AS passed FROM reference_embeddings""")
def reference_check(spark, d):
    r = read(spark, d, "reference_embeddings")
    norms = F.transform(F.filter("cases", lambda c: F.size(c["embedding"]) == F.col("dimension")), lambda c: V.norm(c["embedding"]))
    return r.select(
        "model_id", F.size("cases").cast("long").alias("n_cases"), F.size(F.filter("cases", lambda c: c["embedding"].isNull())).cast("long").alias("n_missing"),
        F.round(F.array_min(norms), 6).alias("least_norm"),
        ((F.col("validation.min_cosine_vs_coreml_fp16") > 0.999) & (F.col("validation.padding_invariance_cosine") > 0.999)).alias("passed"),
    )


# ---- search ----


@query("topchunks_k5", _with(_V, _Q, _LATEST, _SCORED, _top(5), _HITS) + "SELECT query_id, rank, chunk_id, note_id, title, round(score, 6) AS score FROM hits")
def topchunks_k5(spark, d):
    return _hits(spark, d, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "note_id", "title", F.round("score", 6).alias("score"))


_BEST = "best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, note_id ORDER BY rank) = 1)"


@query("best_chunk_per_note", _with(_V, _Q, _LATEST, _SCORED, _top(50), _HITS, _BEST) + "SELECT query_id, note_id, chunk_id, round(score, 6) AS score FROM best")
def best_chunk_per_note(spark, d):
    return search.best_per_note(_hits(spark, d, 50)).select("query_id", "note_id", "chunk_id", F.round("score", 6).alias("score"))


@query("note_search_top10", _with(_V, _Q, _LATEST, _SCORED, _top(50), _HITS, _BEST) + """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best.score DESC, note_id) AS place, note_id, chunk_id,
  printf('%.2f', best.score) AS shown_score FROM best QUALIFY place <= 10""")
def note_search_top10(spark, d):
    s = search.search_notes(_vectors(spark, d), _latest(spark, d), _cases(spark, d).select("query_id", "qvec"), 10, DIM)
    return s.select("query_id", F.col("place").cast("long").alias("place"), "note_id", "chunk_id", T.score_text(F.col("score")).alias("shown_score"))


@query("overfetch_vs_group_topk", _with(_V, _Q, _LATEST, _SCORED, _top(50), _HITS, _BEST, """allhits AS (
  SELECT s.query_id, v.note_id, max(s.score) AS score FROM scored s JOIN v USING (id) JOIN latest n ON n.note_id = v.note_id GROUP BY ALL),
a AS (SELECT query_id, note_id FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best.score DESC, note_id) <= 10),
b AS (SELECT query_id, note_id FROM allhits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) <= 10)""")
       + "SELECT query_id, count(*) AS n_notes, count(a.note_id) AS n_fetched FROM b LEFT JOIN a USING (query_id, note_id) GROUP BY query_id")
def overfetch_vs_group_topk(spark, d):
    """How many of the truly best ten notes the bounded fetch of chunks keeps."""
    v, n, q = _vectors(spark, d), _latest(spark, d), _cases(spark, d).select("query_id", "qvec")
    a = search.search_notes(v, n, q, 10, DIM).select("query_id", "note_id", F.lit(1).alias("got"))
    b = knn.best_groups(v.join(n.select("note_id"), "note_id").select("id", F.col("note_id").alias("group"), "vec"), q, 10, DIM).select("query_id", F.col("group").alias("note_id"))
    return b.join(a, ["query_id", "note_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_notes"), F.count("got").alias("n_fetched"))


# ---- evidence ----

_RAG = _with(_V, _Q, _LATEST, _SCORED, _top(5), _HITS, _SELECTED)


@query("rag_sources_budget", _RAG + "SELECT query_id, source_no, chunk_id, tokens, total_tokens::BIGINT AS total_tokens FROM selected")
def rag_sources_budget(spark, d):
    return rag.select_sources(_hits(spark, d, 5)).select("query_id", F.col("source_no").cast("long").alias("source_no"), "chunk_id", "tokens", "total_tokens")


_PROMPT = """p AS (SELECT s.query_id, '以下はノートからの抜粋です。' || chr(10) || string_agg('[' || source_no || '] ノート「' || CASE WHEN title IS NULL OR title = '' THEN '無題' ELSE title END || '」: ' || s.content, chr(10) ORDER BY source_no)
  || chr(10) || chr(10) || '質問: ' || any_value(regexp_replace(q.text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS prompt, count(*) AS n FROM selected s JOIN q USING (query_id) WHERE s.content IS NOT NULL GROUP BY 1)"""


@query("used_hits", _RAG + "SELECT query_id, rank, chunk_id FROM selected")
def used_hits(spark, d):
    hits = _hits(spark, d, 5)
    return rag.used_hits(hits, rag.select_sources(hits)).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


@query("rag_prompt", _RAG.rstrip() + ",\n" + _PROMPT + "SELECT query_id, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM p")
def rag_prompt(spark, d):
    q = search.asked(_cases(spark, d).select("query_id", "text"))
    return rag.prompts(q, rag.select_sources(_hits(spark, d, 5))).select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


@query("rag_fallback", _RAG.rstrip() + ",\n" + _PROMPT + """SELECT q.query_id, NULL::VARCHAR AS text, CASE WHEN p.n IS NOT NULL THEN 'model not installed' END AS unavailable_reason, coalesce(p.n, 0) AS n_sources
FROM q LEFT JOIN p USING (query_id)""")
def rag_fallback(spark, d):
    q = _cases(spark, d).select("query_id", "text")
    return rag.answers(q, _hits(spark, d, 5), None, "model not installed")


@query("rag_answer", _RAG.rstrip() + ",\n" + _PROMPT + f"""SELECT q.query_id, 'echo:' || md5('{rag.INSTRUCTIONS}' || chr(10) || prompt) AS text, NULL::VARCHAR AS unavailable_reason, coalesce(p.n, 0) AS n_sources
FROM q LEFT JOIN p USING (query_id)""")
def rag_answer(spark, d):
    """Answers of the deterministic stand-in."""
    return rag.answers(_cases(spark, d).select("query_id", "text"), _hits(spark, d, 5), rag.echo_generator)


# ---- retrieval quality ----

_GRAMS = "list_distinct(list_transform(range(1, greatest(length(%s), 1)), lambda i: lower(substr(%s, i, 2))))"
_EVAL = f"""n AS (SELECT x.id AS note_id, {_GRAMS % ('x.content', 'x.content')} AS g FROM (SELECT unnest(notes) AS x FROM eval_set)),
qq AS (SELECT x.id AS query_id, {_GRAMS % ('x.text', 'x.text')} AS g FROM (SELECT unnest(queries) AS x FROM eval_set)),
sc AS (SELECT query_id, note_id, round(len(list_intersect(qq.g, n.g)) / sqrt(len(n.g) + 1.0), 12) AS score FROM qq, n),
ranked AS (SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) AS rank FROM sc),
rel AS (SELECT query_id, e.key AS note_id, e.value AS grade FROM (SELECT x.id AS query_id, unnest(map_entries(x.relevant)) AS e FROM (SELECT unnest(queries) AS x FROM eval_set))),
rec AS (SELECT rel.query_id, avg(CASE WHEN ranked.rank <= 10 THEN 1.0 ELSE 0.0 END) AS recall FROM rel LEFT JOIN ranked USING (query_id, note_id) GROUP BY 1),
dcg AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM rel JOIN ranked USING (query_id, note_id) WHERE rank <= 10 GROUP BY 1),
idl AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, note_id) AS r FROM rel) WHERE r <= 10 GROUP BY 1),
per AS (SELECT qq.query_id, coalesce(recall, 1.0) AS recall, CASE WHEN coalesce(idcg, 0) = 0 THEN 1.0 ELSE coalesce(dcg, 0) / idcg END AS ndcg
  FROM qq LEFT JOIN rec USING (query_id) LEFT JOIN dcg USING (query_id) LEFT JOIN idl USING (query_id))"""


def _grams(t):
    n = F.greatest(F.length(t) - 1, F.lit(0))
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.lower(F.substring(t, i, F.lit(2))))).otherwise(F.array().cast("array<string>")))


def lexical_ranking(spark, d):
    """(query_id, note_id, rank) by shared letter pairs: a deterministic scorer, not a model."""
    e = read(spark, d, "eval_set")
    n = tables.eval_notes(e).select("note_id", _grams(F.col("content")).alias("g"))
    q = tables.eval_queries(e).select("query_id", _grams(F.col("text")).alias("h"))
    s = F.round(F.size(F.array_intersect("h", "g")) / F.sqrt(F.size("g") + F.lit(1.0)), 12)
    scored = n.crossJoin(F.broadcast(q)).select("query_id", "note_id", s.alias("score"))
    return knn.top_k(scored, 2 ** 31 - 1, ["query_id"], "note_id").select("query_id", "note_id", "rank"), tables.eval_queries(e), tables.qrels(e)


@query("recall_at_10", "WITH " + _EVAL + " SELECT query_id, round(recall::DOUBLE, 6) AS recall FROM per")
def recall_at_10(spark, d):
    r, q, rel = lexical_ranking(spark, d)
    return metrics.recall_at(q, rel, r, 10).select("query_id", F.round("recall", 6).alias("recall"))


@query("ndcg_at_10", "WITH " + _EVAL + " SELECT query_id, round(ndcg::DOUBLE, 6) AS ndcg FROM per")
def ndcg_at_10(spark, d):
    r, q, rel = lexical_ranking(spark, d)
    return metrics.ndcg_at(q, rel, r, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("metrics_by_lang", "WITH " + _EVAL + """ SELECT lang, count(*) AS n_queries, round(avg(recall)::DOUBLE, 6) AS recall, round(avg(ndcg)::DOUBLE, 6) AS ndcg
FROM (SELECT *, unnest([CASE WHEN query_id LIKE 'q-en-%' THEN 'EN' ELSE 'JA' END, 'ALL']) AS lang FROM per) GROUP BY lang""")
def metrics_by_lang(spark, d):
    r, q, rel = lexical_ranking(spark, d)
    return metrics.summary(q, rel, r).select("lang", "n_queries", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


@query("retrieval_failures", "WITH " + _EVAL + """ SELECT per.query_id, round(recall::DOUBLE, 6) AS recall, (SELECT string_agg(note_id, ',' ORDER BY rank) FROM ranked WHERE ranked.query_id = per.query_id AND rank <= 3) AS top3
FROM per WHERE recall < 1""")
def retrieval_failures(spark, d):
    r, q, rel = lexical_ranking(spark, d)
    return metrics.failures(q, rel, r).select("query_id", F.round("recall", 6).alias("recall"), "top3")


# ---- generators and the stream extension ----


@query("generated_vectors", """SELECT kind, id, 1.0::DOUBLE AS norm FROM (VALUES ('uniform'), ('clustered')) k(kind), range(2000) r(id)""")
def generated_vectors(spark, d):
    """Norms of seeded uniform and clustered vectors; reads no table."""
    u = generators.uniform_vectors(spark, 2000, DIM).select(F.lit("uniform").alias("kind"), "id", F.round(V.norm(F.col("vec")), 5).alias("norm"))
    return u.unionByName(generators.clustered_vectors(spark, 2000, DIM).select(F.lit("clustered").alias("kind"), "id", F.round(V.norm(F.col("vec")), 5).alias("norm")))


@query("stream_edits", """SELECT epoch_us(updated_at) // 3600000000 AS hour, count(*) AS n FROM notes WHERE updated_at IS NOT NULL GROUP BY 1""")
def stream_edits(spark, d):
    """The hourly counts of the stream extension, in batch."""
    n = read(spark, d, "notes").where("updated_at is not null")
    return changes.edits_per_hour(n).select(F.floor(F.unix_micros("window.start") / F.lit(3_600_000_000)).cast("long").alias("hour"), F.col("count").alias("n"))
