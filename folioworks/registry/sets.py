"""Set operations."""

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import scripture, text as t
from folioworks.operators import sets as ops
from folioworks.registry import query
from folioworks.registry.prelude import LIBRARY, NOTES, SOURCES, using
from folioworks.session import inline_table
from folioworks.sources import library as lib


@query("study_context", "U2 R25 J9", using(LIBRARY, NOTES) + """
SELECT 'library_document' AS kind, doc_id AS item_id, title, NULL AS workspace_id, left(text, 700) AS excerpt FROM
  (SELECT * FROM library WHERE deleted_s IS NULL AND (title ILIKE '%tion%' OR text ILIKE '%tion%') ORDER BY updated_s DESC, doc_id LIMIT 6)
UNION ALL SELECT 'user_private_note', note_id, NULL, NULL, left(content, 350) FROM
  (SELECT * FROM notes WHERE user_id = 4 ORDER BY updated_s DESC, note_id LIMIT 4)
UNION ALL SELECT 'previous_study', workspace_id, NULL, workspace_id, NULL FROM
  (SELECT workspace_id, max(updated_s) AS u FROM notes WHERE user_id = 4 AND deleted_s IS NULL GROUP BY 1 ORDER BY u DESC, workspace_id LIMIT 4)""")
def study_context(spark, d):
    return ops.study_context(lib.documents(spark, d), lib.notes(spark, d), ["tion"], user_id=4)


@query("ordered_unique_words", "U3", r"""
SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), ' ') AS words
FROM (SELECT conv_id, turn, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ') AS w FROM conversations)""")
def ordered_unique_words(spark, d):
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", " ")), " ")
    return lib.table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(F.array_distinct(words), " ").alias("words"))


@query("normalized_tags", "U4 X6", using(LIBRARY) + """
SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(n) + 1), lambda i: list_position(list_transform(n, lambda x: lower(x)), lower(n[i])) = i),
  lambda i: n[i]), ',') AS tags
FROM (SELECT doc_id, list_transform(list_concat(tags, ['FAITH', 'Temple', 'src3', 'SRC7']),
  lambda x: CASE lower(x) WHEN 'faith' THEN 'Fe' WHEN 'temple' THEN 'Templo' ELSE x END) AS n FROM library)""")
def normalized_tags(spark, d):
    more = F.array(F.lit("FAITH"), F.lit("Temple"), F.lit("src3"), F.lit("SRC7"))
    return lib.documents(spark, d).select(
        "doc_id", F.array_join(ops.unique_tags(F.concat("tags", more)), ",").alias("tags"))


@query("pending_decisions", "U5 I5", using(LIBRARY) + """
SELECT doc_id FROM library WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM labels""")
def pending_decisions(spark, d):
    found = lib.table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("duplicate_id"))
    known = lib.table(spark, d, "labels").select(F.col("doc_id").alias("duplicate_id"))
    return ops.pending(found, known).select(F.col("duplicate_id").alias("doc_id"))


@query("merged_references", "U6 R43 X18", using(NOTES) + r"""
SELECT note_id, array_to_string(list_sort(list_distinct(list_concat(['Moroni 10:4'], list_transform(
    regexp_extract_all(content, '(?i)\b(1\s*Nephi|2\s*Nephi|3\s*Nephi|Alma|Mosiah|Moroni|Doctrine and Covenants|D&C|DyC|Mateo|Matthew|John|Juan|Romans|Romanos)\s+\d{1,3}:\d{1,3}(?:\s*[-–]\s*\d{1,3})?\b'),
    lambda m: CASE WHEN b(m) = '' THEN m ELSE b(m) || regexp_extract(m, '\s(\d+:.*)$') END)))), '|') AS refs
FROM notes""".replace("b(m)", r"""CASE regexp_replace(lower(regexp_extract(m, '^(.*?)\s+\d+:', 1)), '\s+', ' ', 'g') WHEN '1 nephi' THEN '1 Nephi' WHEN '2 nephi' THEN '2 Nephi' WHEN 'alma' THEN 'Alma' WHEN 'd&c' THEN 'Doctrine and Covenants'
    WHEN 'dyc' THEN 'Doctrine and Covenants' WHEN 'mateo' THEN 'Matthew' WHEN 'juan' THEN 'John' WHEN 'romanos' THEN 'Romans' ELSE '' END"""))
def merged_references(spark, d):
    wanted = F.array(F.lit("Moroni 10:4"))
    return lib.notes(spark, d).select(
        "note_id", F.array_join(scripture.with_query_refs(wanted, F.col("content")), "|").alias("refs"))


_DOMAIN = ", ".join(f"('{k}', '{v}')" for k, v in fv.SOURCE_LABELS.items())


@query("source_options", "R46 J14 S9", using(SOURCES) + f""",
incoming AS (SELECT CASE WHEN source_key = 'src1' THEN 'scriptures' ELSE source_key END AS key, source_name AS label FROM sources)
SELECT coalesce(i.key, k.key) AS key, coalesce(i.label, k.label) AS label, k.key IS NOT NULL AS canonical
FROM (VALUES {_DOMAIN}) k(key, label) FULL JOIN incoming i USING (key)""")
def source_options(spark, d):
    known = inline_table(spark, ["key", "known_label"], list(fv.SOURCE_LABELS.items()))
    incoming = lib.sources(spark, d).select(
        F.when(F.col("source_key") == "src1", "scriptures").otherwise(F.col("source_key")).alias("key"),
        F.col("source_name").alias("new_label"))
    return known.join(incoming, "key", "full_outer").select(
        "key", F.coalesce("new_label", "known_label").alias("label"), F.col("known_label").isNotNull().alias("canonical"))


@query("toggled_favorites", "R46", """
SELECT user_id, k AS item, count(*) AS toggles FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def toggled_favorites(spark, d):
    return ops.toggled(lib.table(spark, d, "events").select(
        "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item")))
