"""Retrieval: textual search, lexical rank, vectors, fusion."""

from datetime import date

from pyspark.sql import functions as F

from folioworks.functions import text as t
from folioworks.operators import catalog, chunking, lexical, ranking, search, study, vectors
from folioworks.operators.filters import MetadataFilter
from folioworks.registry import query
from folioworks.registry.prelude import DECISIONS, DUPLICATES, LIBRARY, NOTES, PARAGRAPHS, SOURCES, using
from folioworks.sources import library as lib

_QUERY = "thin the, on that?"
_PATTERNS = ["%thin the, on that?%", "%thin%"]


def _any(c: str, patterns) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '{p}'" for p in patterns) + ")"


_SEARCH_SQL = using(LIBRARY, SOURCES, PARAGRAPHS, DUPLICATES) + f""",
first AS (SELECT doc_id, min(chunk_index) AS chunk_index, min_by(chunk_text, chunk_index) AS chunk_text FROM paragraphs
  WHERE {_any('chunk_text', _PATTERNS)} GROUP BY doc_id),
scored AS (SELECT l.*, s.source_name, f.chunk_index, f.chunk_text,
    CASE WHEN l.title ILIKE '{_PATTERNS[0]}' THEN 5 ELSE 0 END + CASE WHEN coalesce(l.author, '') ILIKE '{_PATTERNS[0]}' THEN 3 ELSE 0 END
    + CASE WHEN s.source_name ILIKE '{_PATTERNS[0]}' THEN 2 ELSE 0 END + CASE WHEN {_any("coalesce(l.meta_summary, '')", _PATTERNS)} THEN 2 ELSE 0 END
    + CASE WHEN {_any('l.text', _PATTERNS)} THEN 1 ELSE 0 END + CASE WHEN {_any('CAST(to_json(l.tags) AS VARCHAR)', _PATTERNS)} THEN 2 ELSE 0 END
    + CASE WHEN f.doc_id IS NOT NULL THEN 2 ELSE 0 END AS match_score
  FROM library l JOIN sources s USING (source_key) LEFT JOIN first f ON f.doc_id = l.doc_id
  WHERE l.deleted_s IS NULL AND l.language IN ('en', 'de') AND l.doc_id NOT IN (SELECT duplicate_id FROM hidden)
    AND ({_any('l.title', _PATTERNS)} OR {_any("coalesce(l.author, '')", _PATTERNS)} OR {_any('s.source_name', _PATTERNS)}
      OR {_any("coalesce(l.meta_summary, '')", _PATTERNS)} OR {_any('l.text', _PATTERNS)} OR {_any('CAST(to_json(l.tags) AS VARCHAR)', _PATTERNS)} OR f.doc_id IS NOT NULL)
  ORDER BY match_score DESC, updated_s DESC, l.doc_id LIMIT 20)
SELECT doc_id, title, author, source_name, language, canonical_url, left(coalesce(nullif(chunk_text, ''), nullif(meta_summary, ''), nullif(text, ''), title), 520) AS snippet,
  chunk_index, least(match_score / 17.0, 1.0)::DOUBLE AS score, updated_s FROM scored"""


def _search(spark, d, limit=20):
    docs = catalog.without_exact_copies(lib.documents(spark, d))
    return search.textual_search(docs, lib.sources(spark, d), lib.paragraphs(spark, d), _QUERY, limit,
                                 MetadataFilter(languages=["en", "de"]))


@query("textual_search", "L4 O4 P5 F1 F7 J1 J5 J8 J9 X38", _SEARCH_SQL)
def textual_search(spark, d):
    return _search(spark, d).drop("tags", "source_url", "source_key").withColumn(
        "chunk_index", F.col("chunk_index").cast("bigint"))


@query("local_answer", "R19 P7 L6", f"""
SELECT row_number() OVER (ORDER BY score DESC, updated_s DESC, doc_id) AS citation_id, doc_id, title,
  left(trim(regexp_replace(snippet, '\\s+', ' ', 'g')), 380) AS quote FROM ({_SEARCH_SQL}) ORDER BY citation_id LIMIT 5""")
def local_answer(spark, d):
    return search.local_answer(_search(spark, d, 5)).withColumn("citation_id", F.col("citation_id").cast("bigint"))


# Covers end where the earliest of the terms' last hits moves.
_TERMS_SQL = r"""
q AS (SELECT item_id AS query_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS terms FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(title), '[\p{L}\p{N}_]+') AS a, regexp_extract_all(lower(coalesce(author, '')), '[\p{L}\p{N}_]+') AS b,
  regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS c, language, source_key FROM library),
dl AS (SELECT doc_id, list_concat(list_concat(a, b), c) AS w, len(a) AS na, len(b) AS nb, language, source_key FROM d),
pairs AS (SELECT query_id, doc_id, terms, w, na, nb, language, source_key FROM q JOIN dl ON len(terms) > 0 AND list_has_all(w, terms)),
hits AS (SELECT query_id, doc_id, pos, list_position(terms, w[pos]) AS term, len(terms) AS n,
    CASE WHEN pos <= na THEN 1.0::DOUBLE WHEN pos <= na + nb THEN 2.5::DOUBLE ELSE 5.0::DOUBLE END AS inv
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS pos FROM pairs) WHERE list_contains(terms, w[pos])),
numbered AS (SELECT *, row_number() OVER p AS i, sum(inv) OVER p AS cum FROM hits WINDOW p AS (PARTITION BY query_id, doc_id ORDER BY pos)),
lasts AS (SELECT query_id, doc_id, i, pos, cum, inv, min(latest) AS lft FROM (
  SELECT *, coalesce(max(CASE WHEN term = t THEN i END) OVER (PARTITION BY query_id, doc_id, t ORDER BY i), 0) AS latest
  FROM (SELECT *, unnest(range(1, n + 1)) AS t FROM numbered)) GROUP BY ALL),
covers AS (SELECT l.*, coalesce(lag(lft) OVER (PARTITION BY query_id, doc_id ORDER BY i), 0) AS before FROM lasts l),
gains AS (SELECT c.query_id, c.doc_id, c.i, (c.i - c.lft + 1) / (c.cum - s.cum + s.inv) / (c.pos - s.pos - (c.i - c.lft) + 1) AS gain
  FROM covers c JOIN numbered s ON s.query_id = c.query_id AND s.doc_id = c.doc_id AND s.i = c.lft WHERE c.lft > c.before),
ranks AS (SELECT query_id, doc_id, sum(gain ORDER BY i) AS score FROM gains GROUP BY 1, 2)
"""


def _queries(spark, d):
    return lexical.query_terms(lib.table(spark, d, "benchmark"), "item_id", F.col("text"))


def _index(spark, d):
    return lexical.open_index(lib.documents(spark, d), "library")


@query("all_terms_match", "F16", using(LIBRARY) + r"""
SELECT q.item_id AS query_id, l.doc_id FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS terms FROM benchmark) q
JOIN (SELECT doc_id, regexp_extract_all(lower(title || ' ' || coalesce(author, '') || ' ' || text), '[\p{L}\p{N}_]+') AS w FROM library) l ON list_has_all(l.w, q.terms)""")
def all_terms_match(spark, d):
    return lexical.match_all(_index(spark, d), _queries(spark, d)).select("query_id", "doc_id")


@query("cover_density_rank", "X49 O2 F16 X48", using(LIBRARY, _TERMS_SQL) + """
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM ranks) WHERE rn <= 20""")
def cover_density_rank(spark, d):
    found = lexical.scored(_index(spark, d), _queries(spark, d))
    rounded = found.withColumn("raw", F.round("lexical_score", 9))
    top = ranking.top_per_group(rounded, ["query_id"], [F.desc("raw"), F.col("doc_id")], 20)
    return top.select("query_id", "doc_id", F.round("raw", 6).alias("score"))


def _lexeme_sql(word: str, config: str) -> str:
    folded = f"translate({word}, '{lexical.ACCENTS[0]}', '{lexical.ACCENTS[1]}')"
    cases = " ".join(f"WHEN {config} = '{name}' THEN regexp_replace({folded}, '{lexical.suffix_pattern(name)}', '\\1')" for name in lexical.SUFFIXES)
    return f"CASE {cases} ELSE {word} END"


_CONFIG_SQL = "CASE {0} WHEN 'es' THEN 'spanish' WHEN 'en' THEN 'english' WHEN 'pt' THEN 'portuguese' ELSE 'simple' END"


@query("language_lexeme_match", "X48 T5 F16", using(LIBRARY) + rf""",
w AS (SELECT doc_id, language, {_CONFIG_SQL.format('language')} AS config,
  unnest(list_distinct(regexp_extract_all(lower(title || ' ' || coalesce(author, '') || ' ' || text), '[\p{{L}}\p{{N}}_]+'))) AS word FROM library),
held AS (SELECT DISTINCT doc_id, config, {_lexeme_sql('word', 'config')} AS lexeme FROM w),
asked AS (SELECT b.item_id AS query_id, l.language, unnest(list_distinct(list_slice(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]+'), 3, 6))) AS word
  FROM benchmark b JOIN library l ON l.doc_id = b.item_id),
lex AS (SELECT DISTINCT query_id, config, {_lexeme_sql('word', 'config')} AS lexeme
  FROM (SELECT query_id, word, unnest(list_distinct(['simple', {_CONFIG_SQL.format('language')}])) AS config FROM asked)),
need AS (SELECT query_id, config, count(*) AS n FROM lex GROUP BY 1, 2)
SELECT x.query_id, h.doc_id, any_value(x.config) AS config FROM lex x JOIN held h USING (config, lexeme) JOIN need n ON n.query_id = x.query_id AND n.config = x.config
GROUP BY x.query_id, x.config, h.doc_id, n.n HAVING count(*) = n.n""")
def language_lexeme_match(spark, d):
    """Four words of every benchmark passage, read in the language of the document with its number."""
    docs = lib.documents(spark, d)
    index = lexical.open_index(docs, "library", by_language=True)
    asked = lib.table(spark, d, "benchmark").join(docs.select(F.col("doc_id").alias("item_id"), "language"), "item_id").select(
        F.col("item_id").alias("query_id"), "language", F.array_distinct(F.slice(lexical.words(F.col("text")), 3, 4)).alias("terms"))
    spoken = docs.select("doc_id", lexical.text_config(F.col("language")).alias("config"))
    return lexical.match_all(index, asked).join(spoken, "doc_id").select("query_id", "doc_id", "config")


@query("fallback_leg", "F3 L6 R9 F16 F7", using(LIBRARY, PARAGRAPHS) + r"""
, asked AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 12, 30) ELSE substr(text, 1, instr(text, ' ')) END AS text FROM benchmark),
terms AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM asked),
passages AS (SELECT doc_id, chunk_index, list_distinct(regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}_]+')) AS w FROM paragraphs),
leg AS (SELECT query_id, doc_id, chunk_index FROM terms JOIN passages ON len(t) > 0 AND list_has_all(w, t)),
rest AS (SELECT a.query_id, l.doc_id FROM asked a JOIN library l ON contains(lower(l.title), lower(a.text)) OR contains(lower(coalesce(l.author, '')), lower(a.text))
  OR contains(lower(l.text), lower(a.text)) WHERE a.query_id NOT IN (SELECT query_id FROM leg))
SELECT query_id, 'passage' AS route, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM leg UNION ALL SELECT query_id, 'document', doc_id, -1 FROM rest""")
def fallback_leg(spark, d):
    """Whole passages, parts that begin and end inside words, and first words, answered by one plan."""
    docs = lib.documents(spark, d)
    number = F.col("doc_id") * 1_000_000 + F.col("chunk_index")
    passages = lib.paragraphs(spark, d).select(number.alias("doc_id"), F.lit("").alias("title"), F.lit("").alias("author"), F.col("chunk_text").alias("text"))
    item, text = F.col("item_id"), F.col("text")
    asked = lib.table(spark, d, "benchmark").select(item.alias("query_id"), F.when(item % 3 == 0, text).when(item % 3 == 1, F.substring(text, 12, 30)).otherwise(
        F.left(text, F.instr(text, " "))).alias("text"))
    found = search.lexical_leg(lexical.open_index(passages, "paragraphs"), _index(spark, d), docs, asked)
    on_passage = F.col("route") == "passage"
    return found.select("query_id", "route", F.when(on_passage, F.expr("doc_id DIV 1000000")).otherwise(F.col("doc_id")).alias("doc_id"),
                        F.when(on_passage, F.col("doc_id") % 1_000_000).otherwise(F.lit(-1)).cast("bigint").alias("chunk_index"))


_COS = """list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"""


@query("nearest_vectors", "O3 F4 J6", f"""
WITH c AS (SELECT list(v ORDER BY dim) AS center FROM (SELECT dim, avg(v) AS v FROM (SELECT unnest(range(1, len(embedding) + 1)) AS dim,
  unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings WHERE label = 3) GROUP BY dim))
SELECT vec_id AS doc_id, label, round(s, 6) AS score FROM (SELECT vec_id, label, {_COS.format(a='embedding', b='center')} AS s FROM embeddings, c WHERE label IN (1, 3, 5, 7))
ORDER BY s DESC, vec_id LIMIT 25""")
def nearest_vectors(spark, d):
    points = lib.table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    center = vectors.centroid(points.where("label = 3"))
    return vectors.nearest(points.where("label IN (1, 3, 5, 7)"), center, 25).select(
        "doc_id", "label", F.round("semantic_score", 6).alias("score"))


@query("nearest_vectors_batch", "O3 J13", f"""
SELECT query_id, doc_id, round(s, 6) AS score FROM (SELECT b.item_id AS query_id, p.vec_id AS doc_id, {_COS.format(a='q.embedding', b='p.embedding')} AS s,
  row_number() OVER (PARTITION BY b.item_id ORDER BY {_COS.format(a='q.embedding', b='p.embedding')} DESC, p.vec_id) AS rn
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings p ON p.label = q.label) WHERE rn <= 8""")
def nearest_vectors_batch(spark, d):
    points = lib.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    asked = (lib.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
             .join(points.withColumnRenamed("doc_id", "query_id"), "query_id"))
    return vectors.nearest_batch(points, asked, 8, match="label").select(
        "query_id", "doc_id", F.round("semantic_score", 6).alias("score"))


@query("nearest_in_cells", "O3 F4 S12", f"""
SELECT query_id, doc_id, label, round(s, 6) AS score FROM (SELECT b.item_id AS query_id, p.vec_id AS doc_id, p.label, {_COS.format(a='q.embedding', b='p.embedding')} AS s,
  row_number() OVER (PARTITION BY b.item_id ORDER BY {_COS.format(a='q.embedding', b='p.embedding')} DESC, p.vec_id) AS rn
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings p ON p.label % 3 <> 1) WHERE rn <= 8""")
def nearest_in_cells(spark, d):
    """The stored table with a condition on the payload."""
    points = lib.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    asked = (lib.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
             .join(points.select(F.col("doc_id").alias("query_id"), "embedding"), "query_id"))
    found = vectors.stored_vectors(points, "embeddings").search(asked, 8, F.col("label") % 3 != 1)
    return found.join(points.select("doc_id", "label"), "doc_id").select("query_id", "doc_id", "label", F.round("semantic_score", 6).alias("score"))


@query("latest_vector_points", "S12 R48", """
SELECT label AS cell, max(vec_id) AS doc_id, arg_max(len(embedding), vec_id) AS dimensions FROM embeddings GROUP BY label""")
def latest_vector_points(spark, d):
    points = lib.table(spark, d, "embeddings").select(F.col("label").alias("cell"), "vec_id", "embedding")
    return vectors.latest_points(points, "cell", "vec_id").select(
        "cell", F.col("vec_id").alias("doc_id"), F.size("embedding").cast("bigint").alias("dimensions"))


def _fused_sql(condition: str = "true") -> str:
    """Both legs over the passages that meet ``condition``, merged and scored as ``fused``."""
    return using(LIBRARY, DECISIONS, _TERMS_SQL) + f""",
open_docs AS (SELECT * FROM library l WHERE {condition}),
asked AS (SELECT b.item_id AS query_id, e.embedding, l.language AS q_language FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN library l ON l.doc_id = b.item_id),
sem AS (SELECT query_id, item, s FROM (SELECT a.query_id, p.vec_id AS item, {_COS.format(a='a.embedding', b='p.embedding')} AS s,
    row_number() OVER (PARTITION BY a.query_id ORDER BY {_COS.format(a='a.embedding', b='p.embedding')} DESC, p.vec_id) AS rn
  FROM asked a JOIN embeddings p ON true JOIN open_docs l ON l.doc_id = p.vec_id AND l.language = a.q_language) WHERE rn <= 32),
lex AS (SELECT query_id, item, s FROM (SELECT r.query_id, r.doc_id AS item, r.score AS s, row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, r.doc_id) AS rn
  FROM ranks r JOIN asked a USING (query_id) JOIN open_docs l ON l.doc_id = r.doc_id AND l.language = a.q_language) WHERE rn <= 32),
merged AS (SELECT query_id, item, coalesce(sem.s, 0) AS ss, coalesce(lex.s, 0) AS ls FROM sem FULL JOIN lex USING (query_id, item)),
scaled AS (SELECT query_id, item,
    CASE WHEN max(ss) OVER w = min(ss) OVER w THEN CASE WHEN ss > 0 THEN 1.0 ELSE 0.0 END ELSE (ss - min(ss) OVER w) / (max(ss) OVER w - min(ss) OVER w) END AS sn,
    CASE WHEN max(ls) OVER w = min(ls) OVER w THEN CASE WHEN ls > 0 THEN 1.0 ELSE 0.0 END ELSE (ls - min(ls) OVER w) / (max(ls) OVER w - min(ls) OVER w) END AS ln
  FROM merged WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT query_id, item, 0.52 * sn + 0.36 * ln + 0.03 AS f FROM scaled)"""


# Of a document three passages come before its others; then the best six are walked and those that no longer fit are skipped.
_FITTED_SQL = r""",
placed AS (SELECT query_id, item, f, row_number() OVER (PARTITION BY query_id ORDER BY nth > 3, f DESC, item) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item // 4 ORDER BY f DESC, item) AS nth FROM fused)),
walk AS (SELECT p.*, len(regexp_extract_all(l.text, '[\p{L}\p{N}_]+|[^\t\n\f\r\x0B \p{L}\p{N}_]')) AS token_count, l.title, l.source_key, l.language, l.text
  FROM placed p JOIN library l ON l.doc_id = p.item WHERE position <= 6),
fold AS (SELECT query_id, position, token_count <= 4500 AS fits, CASE WHEN token_count <= 4500 THEN token_count ELSE 0 END AS used FROM walk WHERE position = 1
  UNION ALL SELECT w.query_id, w.position, o.used + w.token_count <= 4500, o.used + CASE WHEN o.used + w.token_count <= 4500 THEN w.token_count ELSE 0 END
  FROM fold o JOIN walk w ON w.query_id = o.query_id AND w.position = o.position + 1),
fitted AS (SELECT w.* FROM walk w JOIN fold USING (query_id, position) WHERE fits)"""


def _hybrid_inputs(spark, d):
    docs = lib.documents(spark, d)
    points = lib.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = (lib.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("q"))
             .join(points, "doc_id").join(docs.select("doc_id", "language"), "doc_id")
             .select(F.col("doc_id").alias("query_id"), "language", "embedding", F.col("q").alias("text")))
    passages = docs.select(
        "doc_id", (F.col("doc_id") / 4).cast("bigint").alias("parent_id"), "title", "author", "text", "language",
        "source_key", "category", "tags", "published_on", t.token_count(F.col("text")).cast("bigint").alias("token_count"))
    return passages, points, asked


@query("fused_candidates", "J14 W6 X51 L3", _fused_sql() + " SELECT query_id, item, round(f, 5) AS final_score FROM fused")
def fused_candidates(spark, d):
    return search.fused_candidates(*_hybrid_inputs(spark, d), mode="low", index=_index(spark, d)).select(
        "query_id", "item", F.round("final_score", 5).alias("final_score"))


@query("filtered_candidates", "F2 F3 J6 J14 L3", _fused_sql("""l.category IN ('Talks', 'Discursos') AND l.published_on >= DATE '2000-03-01'
  AND CAST(to_json(l.tags) AS VARCHAR) ILIKE '%faith%' AND l.doc_id NOT IN (SELECT duplicate_id FROM confirmed)""") + """
SELECT query_id, item, round(f, 5) AS final_score FROM fused""")
def filtered_candidates(spark, d):
    wanted = MetadataFilter(categories=["Talks", "Discursos"], tags=["faith"], published_after=date(2000, 3, 1))
    found = search.fused_candidates(*_hybrid_inputs(spark, d), mode="low", decisions=lib.decisions(spark, d), filters=wanted, index=_index(spark, d))
    return found.select("query_id", "item", F.round("final_score", 5).alias("final_score"))


@query("hybrid_search", "L3 L5 W2 W3 J13 J14 W6 X51", _fused_sql() + _FITTED_SQL + """
SELECT query_id, item, position, token_count, round(f, 5) AS final_score FROM fitted""")
def hybrid_search(spark, d):
    return search.hybrid_search(*_hybrid_inputs(spark, d), mode="low", index=_index(spark, d)).select(
        "query_id", "item", F.col("position").cast("bigint").alias("position"), "token_count", F.round("final_score", 5).alias("final_score"))


# Lines as passages, three words of every benchmark text as a query; every fifth query names a scripture.
_PASSAGE_TERMS_SQL = (_TERMS_SQL.replace("SELECT item_id AS query_id", "SELECT query_id").replace("FROM benchmark", "FROM asked")
                      .replace("FROM library", "FROM passages"))
_PASSAGE_SQL = using(LIBRARY, r"""
passages AS (SELECT doc_id * 1000000 + i - 1 AS doc_id, doc_id AS parent_id, '' AS title, '' AS author, parts[i] AS text, language, source_key
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, language, source_key, string_split(text, chr(10)) AS parts FROM library)) WHERE parts[i] <> ''),
asked AS (SELECT item_id AS query_id, embedding, q_language,
    w || CASE WHEN item_id % 5 = 0 THEN ' Alma 32:21 Alma 32:21 scripture reference doctrinal citation' ELSE '' END AS text
  FROM (SELECT b.item_id, e.embedding, l.language AS q_language, array_to_string(list_slice(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+'), 3, 5), ' ') AS w
    FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN library l ON l.doc_id = b.item_id))
""", _PASSAGE_TERMS_SQL) + f""",
near AS (SELECT query_id, parent_id, s FROM (SELECT a.query_id, p.vec_id AS parent_id, {_COS.format(a='a.embedding', b='p.embedding')} AS s,
    row_number() OVER (PARTITION BY a.query_id ORDER BY {_COS.format(a='a.embedding', b='p.embedding')} DESC, p.vec_id) AS rn
  FROM asked a JOIN embeddings p ON true JOIN library l ON l.doc_id = p.vec_id AND l.language = a.q_language WHERE p.vec_id IN (SELECT parent_id FROM passages)) WHERE rn <= 80),
sem AS (SELECT query_id, item, s FROM (SELECT n.query_id, p.doc_id AS item, n.s, row_number() OVER (PARTITION BY n.query_id ORDER BY n.s DESC, p.doc_id) AS rn
  FROM near n JOIN passages p USING (parent_id)) WHERE rn <= 80),
lex AS (SELECT query_id, item, s FROM (SELECT r.query_id, r.doc_id AS item, r.score AS s, row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, r.doc_id) AS rn
  FROM ranks r JOIN asked a USING (query_id) JOIN passages p ON p.doc_id = r.doc_id AND p.language = a.q_language) WHERE rn <= 80),
merged AS (SELECT query_id, item, coalesce(sem.s, 0) AS ss, coalesce(lex.s, 0) AS ls FROM sem FULL JOIN lex USING (query_id, item)),
scaled AS (SELECT query_id, item,
    CASE WHEN max(ss) OVER w = min(ss) OVER w THEN CASE WHEN ss > 0 THEN 1.0 ELSE 0.0 END ELSE (ss - min(ss) OVER w) / (max(ss) OVER w - min(ss) OVER w) END AS sn,
    CASE WHEN max(ls) OVER w = min(ls) OVER w THEN CASE WHEN ls > 0 THEN 1.0 ELSE 0.0 END ELSE (ls - min(ls) OVER w) / (max(ls) OVER w - min(ls) OVER w) END AS ln
  FROM merged WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT query_id, item, 0.52 * sn + 0.36 * ln + 0.03 AS f FROM scaled),
placed AS (SELECT query_id, item, f, row_number() OVER (PARTITION BY query_id ORDER BY nth > 3, f DESC, item) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item // 1000000 ORDER BY f DESC, item) AS nth FROM fused)),
shown AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS used
  FROM (SELECT x.*, len(regexp_extract_all(p.text, '[\\p{{L}}\\p{{N}}_]+|[^\\t\\n\\f\\r\\x0B \\p{{L}}\\p{{N}}_]')) AS tokens FROM placed x JOIN passages p ON p.doc_id = x.item)) WHERE used <= 22000),
judged AS (SELECT query_id, item, tokens, f, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, place) AS position
  FROM (SELECT s.* EXCLUDE (f), 0.7 * coalesce(b.quality, 0) + 0.3 * f AS f FROM shown s LEFT JOIN labels b ON b.doc_id = s.item // 1000000)),
walk AS (SELECT * FROM judged WHERE position <= 12),
fold AS (SELECT query_id, position, tokens <= 10000 AS fits, CASE WHEN tokens <= 10000 THEN tokens ELSE 0 END AS used FROM walk WHERE position = 1
  UNION ALL SELECT w.query_id, w.position, o.used + w.tokens <= 10000, o.used + CASE WHEN o.used + w.tokens <= 10000 THEN w.tokens ELSE 0 END
  FROM fold o JOIN walk w ON w.query_id = o.query_id AND w.position = o.position + 1),
fitted AS (SELECT w.*, a.text AS rewritten FROM walk w JOIN fold USING (query_id, position) JOIN asked a USING (query_id) WHERE fits)"""


def _passage_hits(spark, d):
    docs = lib.documents(spark, d)
    lines = docs.select("doc_id", "language", "source_key", F.posexplode(F.split("text", "\n")).alias("n", "text")).where("text <> ''")
    number = F.col("doc_id") * 1_000_000 + F.col("n")
    index = lexical.open_index(lines.select(number.alias("doc_id"), "language", F.lit("").alias("title"), F.lit("").alias("author"), "text"), "lines-by-language")
    passages = lines.select(number.alias("passage_id"), F.col("doc_id").alias("parent_id"), "language", "source_key",
                            t.token_count(F.col("text")).cast("bigint").alias("token_count"))
    points = lib.table(spark, d, "embeddings").select(F.col("vec_id").alias("parent_id"), "embedding")
    three = F.array_join(F.slice(lexical.words(F.col("text")), 3, 3), " ")
    asked = (lib.table(spark, d, "benchmark").select(F.col("item_id").alias("parent_id"), three.alias("text"))
             .join(points, "parent_id").join(docs.select(F.col("doc_id").alias("parent_id"), "language"), "parent_id")
             .withColumn("text", F.concat("text", F.when(F.col("parent_id") % 5 == 0, " Alma 32:21").otherwise(""))).withColumnRenamed("parent_id", "query_id"))
    judged = lib.table(spark, d, "labels").select(F.col("doc_id").alias("parent_id"), F.col("quality").cast("double").alias("rerank"))
    return search.passage_search(passages, points, asked, index, relevance=judged)


@query("passage_hybrid", "L3 L5 J14 W2 W3 W4 X51 X52 X53", _PASSAGE_SQL + """
SELECT query_id, rewritten, item // 1000000 AS doc_id, item % 1000000 AS chunk_index, position, round(f, 5) AS final_score FROM fitted""")
def passage_hybrid(spark, d):
    """Passages placed by their document's vector and their own words; labels stand in for a model's relevance."""
    return _passage_hits(spark, d).select(
        "query_id", "rewritten", F.col("parent_id").alias("doc_id"), (F.col("passage_id") % 1_000_000).alias("chunk_index"),
        F.col("position").cast("bigint").alias("position"), F.round("final_score", 5).alias("final_score"))


@query("passage_documents", "L3 L5 R9", _PASSAGE_SQL + """
SELECT query_id, item // 1000000 AS doc_id, min_by(item, position) AS best_passage, count(*) AS passages, round(max(f), 5) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY min(position)) AS place FROM fitted GROUP BY query_id, item // 1000000""")
def passage_documents(spark, d):
    """The found passages rolled up to one row per query and document."""
    return search.documents_of(_passage_hits(spark, d)).select(
        "query_id", F.col("parent_id").alias("doc_id"), "best_passage", "passages", F.round("score", 5).alias("score"),
        F.col("place").cast("bigint").alias("place"))


@query("context_blocks", "P8 L5", _fused_sql() + _FITTED_SQL + """
SELECT query_id, string_agg(concat_ws(chr(10), '[' || position || ']', 'Title: ' || title, 'Source: ' || coalesce(source_key, 'Unknown'),
    'Language: ' || coalesce(language, 'unknown'), 'Text:', left(text, 2400)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context
FROM fitted GROUP BY query_id""")
def context_blocks(spark, d):
    return search.context_block(search.hybrid_search(*_hybrid_inputs(spark, d), mode="low", index=_index(spark, d)), 6)


@query("talk_outline", "T3 W9 L7 P12 R24", using(LIBRARY) + """,
pool AS (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position, 'document:' || doc_id AS id, title FROM
  (SELECT * FROM library WHERE text ILIKE '%tion%' ORDER BY n_chars DESC, doc_id LIMIT 7))
SELECT s.section, slot, p.id AS citation_id, p.title AS citation_title FROM (VALUES (0), (1), (2), (3)) s(section), (VALUES (0), (1)) k(slot)
JOIN pool p ON p.position = (s.section + k.slot) % (SELECT count(*) FROM pool)""")
def talk_outline(spark, d):
    from pyspark.sql import Window

    best = (lib.documents(spark, d).where(F.ilike("text", F.lit("%tion%"))).orderBy(F.desc("n_chars"), "doc_id")
            .limit(7).select("doc_id", "n_chars", "title"))
    at = F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1
    pool = best.select(at.alias("position"), F.concat(F.lit("document:"), "doc_id").alias("id"), "title")
    return study.outline(spark, pool, "la fe", "jovenes", 12).select(
        "section", "slot", "citation_id", "citation_title")


@query("export_lines", "S13 S14 L12 R21", using(NOTES) + r""",
l AS (SELECT workspace_id, turn, note_id, unnest(list_concat(list_concat(['### ' || role, ''], string_split(content, chr(10))), ['', '- Scripture refs: Alma 32:21', ''])) AS line,
  generate_subscripts(list_concat(list_concat(['### ' || role, ''], string_split(content, chr(10))), ['', '- Scripture refs: Alma 32:21', '']), 1) AS k FROM notes WHERE deleted_s IS NULL)
SELECT workspace_id, n AS line_no, (n - 1) // 44 AS page, line FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY turn, note_id, k) AS n FROM l)""")
def export_lines(spark, d):
    notes = lib.notes(spark, d).where("deleted_at IS NULL").select(
        "workspace_id", "turn", "note_id", F.col("role").alias("title"), F.lit(None).cast("string").alias("selected_text"),
        "content", F.array(F.lit("Alma 32:21")).alias("scripture_refs"))
    return study.export_lines(notes)


@query("wrapped_lines", "S14", using(NOTES) + r""",
lines AS (SELECT note_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS line FROM (SELECT note_id, string_split(content, chr(10)) AS parts FROM notes)),
cut AS (SELECT note_id, n, flatten(list_transform(list_filter(string_split(regexp_replace(trim(regexp_replace(line, '[#>]', '', 'g')), '\s+', ' ', 'g'), ' '),
  lambda w: w <> ''), lambda w: regexp_extract_all(w, '.{1,88}'))) AS words FROM lines),
fill AS (SELECT note_id, n, 1 AS i, coalesce(words[1], '') AS held, NULL::VARCHAR AS full_line FROM cut
  UNION ALL SELECT c.note_id, c.n, f.i + 1, CASE WHEN length(f.held) + 1 + length(words[f.i + 1]) <= 88 THEN f.held || ' ' || words[f.i + 1] ELSE words[f.i + 1] END,
    CASE WHEN length(f.held) + 1 + length(words[f.i + 1]) > 88 THEN f.held END
  FROM fill f JOIN cut c ON c.note_id = f.note_id AND c.n = f.n AND f.i < len(c.words))
SELECT note_id, full_line AS line FROM fill WHERE full_line IS NOT NULL
UNION ALL SELECT f.note_id, held FROM fill f JOIN cut c USING (note_id, n) WHERE f.i = greatest(len(c.words), 1)""")
def wrapped_lines(spark, d):
    notes = lib.notes(spark, d).select("note_id", F.explode(F.split("content", "\n")).alias("line"))
    return notes.select("note_id", F.explode(study.wrap_lines(F.col("line"))).alias("line"))


@query("chunk_search", "J2 L4 T1 J9")
def chunk_search(spark, d):
    docs = catalog.without_exact_copies(lib.documents(spark, d))
    chunks = chunking.smart_chunks(docs).select("doc_id", "chunk_index", F.col("text").alias("chunk_text"))
    return search.textual_search(docs, lib.sources(spark, d), chunks, "tion the", 20)
