"""Study workspaces, preferences and suggestions."""

from pyspark.sql import functions as F

from folioworks.operators import incremental as inc, study
from folioworks.registry import query
from folioworks.registry.prelude import NOTES, using
from folioworks.sources import library as lib


def _workspaces(spark, d):
    notes = lib.notes(spark, d)
    return notes.groupBy("workspace_id").agg(
        F.min("user_id").alias("user_id"), F.count("*").alias("notes"), F.min_by("role", "turn").alias("name"),
        F.max("updated_at").alias("updated_at"))


_WORKSPACES = "ws AS (SELECT workspace_id, min(user_id) AS user_id, count(*) AS notes, min_by(role, turn) AS name, max(updated_s) AS updated_s FROM notes GROUP BY 1)"


@query("workspace_quota", "R4", using(NOTES, _WORKSPACES) + """
SELECT user_id, count(*) AS workspaces, count(*) < 6 AS may_create FROM ws GROUP BY user_id""")
def workspace_quota(spark, d):
    return study.workspace_quota(_workspaces(spark, d), 6)


@query("related_queries", "R7 R8", using(NOTES, _WORKSPACES) + """
SELECT workspace_id, name || CASE WHEN workspace_id % 2 = 0 THEN ' Estudio ' || workspace_id ELSE '' END || CASE WHEN workspace_id % 3 = 0 THEN ' Alma 5:1 scripture' ELSE '' END AS query,
  CASE workspace_id % 4 WHEN 0 THEN 'joseph_smith_papers,josephsmithpapers,jsp' WHEN 1 THEN 'src1' ELSE '' END AS source_types, CASE WHEN workspace_id % 5 = 0 THEN 'es' ELSE 'en' END AS language FROM ws""")
def related_queries(spark, d):
    w = F.col("workspace_id")
    settings = F.map_filter(F.create_map(
        F.lit("title"), F.when(w % 2 == 0, F.concat(F.lit(" Estudio "), w)),
        F.lit("mainReference"), F.when(w % 3 == 0, "Alma 5:1"), F.lit("referenceType"), F.when(w % 3 == 0, "scripture"),
        F.lit("language"), F.when(w % 5 == 0, "es")), lambda k, v: v.isNotNull())
    filters = F.map_filter(F.create_map(
        F.lit("sourceType"), F.when(w % 4 == 0, "JSP"), F.lit("sourceKey"), F.when(w % 4 == 1, "src1"),
        F.lit("language"), F.lit("en")), lambda k, v: v.isNotNull())
    spaces = _workspaces(spark, d).withColumn("settings", settings).withColumn("source_filters", filters)
    return study.related_query(spaces).select(
        "workspace_id", "query", F.array_join("source_types", ",").alias("source_types"), "language")


@query("merged_settings", "R8 X50", using(NOTES, _WORKSPACES) + """
SELECT workspace_id, CASE WHEN workspace_id % 2 = 0 THEN 'T' || workspace_id ELSE 'old' END AS title, CASE WHEN workspace_id % 3 = 0 THEN 'scripture' END AS reference_type, 'kept' AS color FROM ws""")
def merged_settings(spark, d):
    w = F.col("workspace_id")
    base = F.create_map(F.lit("title"), F.lit("old"), F.lit("color"), F.lit("kept"))
    merged = study.settings_with(base, title=F.when(w % 2 == 0, F.concat(F.lit("T"), w)),
                                 scripture_reference=F.when(w % 3 == 0, F.lit("Alma 1:1")))
    return _workspaces(spark, d).select("workspace_id", merged.alias("s")).select(
        "workspace_id", F.col("s")["title"].alias("title"), F.col("s")["referenceType"].alias("reference_type"),
        F.col("s")["color"].alias("color"))


@query("preferences", "R13", """
SELECT c_custkey, coalesce(p.lang, 'es') AS language, coalesce(p.theme, 'system') AS theme FROM customer LEFT JOIN
  (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'fr' END AS lang, c_mktsegment AS theme FROM customer WHERE c_acctbal > 5000) p USING (c_custkey)""")
def preferences(spark, d):
    customers = lib.table(spark, d, "customer")
    stored = customers.where("c_acctbal > 5000").select(
        "c_custkey", F.when(F.col("c_custkey") % 4 == 0, "fr").alias("language"), F.col("c_mktsegment").alias("theme"))
    return study.with_defaults(customers.select("c_custkey"), stored, "c_custkey", {"language": "es", "theme": "system"})


@query("newest_access", "R14 R40", """
SELECT lower(email) AS email_key, arg_max(access_id, (o_orderdate, access_id)) AS access_id FROM
  (SELECT o_orderkey AS access_id, CASE WHEN o_orderkey % 2 = 0 THEN 'USER' ELSE 'user' END || (o_custkey % 500) AS email, o_orderdate FROM orders) GROUP BY 1""")
def newest_access(spark, d):
    email = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "USER").otherwise("user"), F.col("o_custkey") % 500)
    rows = lib.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("access_id"), email.alias("email"), F.col("o_orderdate").alias("updated_at"))
    return study.newest_access(rows).select(F.lower("email").alias("email_key"), "access_id")


@query("string_lists", "R20", """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || ',b' WHEN 1 THEN role || ',' || conv_id ELSE role END AS items FROM conversations""")
def string_lists(spark, d):
    role, conv = F.col("role"), F.col("conv_id").cast("string")
    raw = (F.when(F.col("turn") % 3 == 0, F.to_json(F.array(role, F.lit(""), F.lit("b"))))
           .when(F.col("turn") % 3 == 1, F.to_json(F.struct(role.alias("x"), conv.alias("y")))).otherwise(role))
    return lib.table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(study.string_list(raw), ",").alias("items"))


@query("talk_drafts", "R24 R22", using(NOTES) + """
SELECT note_id, 'talk_draft' AS kind, updated_s FROM notes WHERE deleted_s IS NULL AND turn % 2 = 0 ORDER BY updated_s DESC, note_id LIMIT 50""")
def talk_drafts(spark, d):
    notes = lib.notes(spark, d).withColumn(
        "metadata", F.create_map(F.lit("type"), F.when(F.col("turn") % 2 == 0, "talk_draft").otherwise("note")))
    return (notes.where("deleted_at IS NULL AND metadata['type'] = 'talk_draft'")
            .select("note_id", F.col("metadata")["type"].alias("kind"), F.unix_seconds("updated_at").alias("updated_s"))
            .orderBy(F.desc("updated_s"), "note_id").limit(50))


@query("fallback_suggestions", "T4 X42", using(NOTES, _WORKSPACES) + """
SELECT workspace_id, t AS type FROM ws, (VALUES (1, 'ai_doctrinal_analysis'), (2, 'ai_quote'), (3, 'reflection_question')) v(n, t) WHERE workspace_id % 2 = 0 OR t = 'ai_quote'""")
def fallback_suggestions(spark, d):
    wanted = F.when(F.col("workspace_id") % 2 == 0, F.array(F.lit("ai_quote"), F.lit("reflection_question"), F.lit("ai_doctrinal_analysis"))
                    ).otherwise(F.array(F.lit("ai_quote"), F.lit("unknown")))
    spaces = _workspaces(spark, d).select("workspace_id", "name", wanted.alias("block_types"))
    return study.fallback_suggestions(spaces, 5).select("workspace_id", "type")


@query("activity_append", "R22 R36 R2", """
SELECT kind, count(*) AS n FROM (SELECT event_type AS kind FROM events UNION ALL SELECT 'export' FROM conversations WHERE turn = 0) GROUP BY 1""")
def activity_append(spark, d):
    log = lib.table(spark, d, "events").select(F.col("event_type").alias("kind"))
    exports = lib.table(spark, d, "conversations").where("turn = 0").select(F.lit("export").alias("kind"))
    return log.unionByName(exports).groupBy("kind").agg(F.count("*").alias("n"))


@query("edited_blocks", "R6 R3", using(NOTES) + """
SELECT note_id, CASE WHEN note_id % 3 = 0 THEN 'edited' ELSE role END AS role, CASE WHEN note_id % 3 = 0 THEN 6 ELSE 5 END AS server_rev FROM notes""")
def edited_blocks(spark, d):
    notes = lib.notes(spark, d).select("note_id", "role").withColumn("server_rev", F.lit(5))
    patch = notes.where("note_id % 3 = 0").select("note_id", F.lit("edited").alias("role"))
    return inc.update_non_null(notes, patch, "note_id", ["role"])


@query("workspace_source_filters", "R5", using(NOTES, _WORKSPACES) + """
SELECT note_id AS filter_id, workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY updated_s DESC, note_id) AS place
FROM notes n WHERE deleted_s IS NULL AND NOT (pinned AND note_id % 2 = 0)
  AND EXISTS (SELECT 1 FROM ws WHERE ws.workspace_id = n.workspace_id AND ws.user_id = n.user_id)""")
def workspace_source_filters(spark, d):
    rows = lib.notes(spark, d).withColumnRenamed("note_id", "filter_id")
    return study.source_filters(rows, rows.where("pinned AND filter_id % 2 = 0"), _workspaces(spark, d)).select(
        "filter_id", "workspace_id", F.col("place").cast("bigint").alias("place"))


@query("feedback_inbox", "R15", using(NOTES) + """
SELECT note_id AS feedback_id, user_id, CASE WHEN turn % 2 = 0 THEN CASE WHEN pinned THEN 'closed' ELSE 'seen' END ELSE 'new' END AS status
FROM notes ORDER BY updated_s DESC, note_id LIMIT 50""")
def feedback_inbox(spark, d):
    notes = lib.notes(spark, d)
    feedback = notes.select(F.col("note_id").alias("feedback_id"), "user_id", F.lit("new").alias("status"), F.col("updated_at").alias("created_at"))
    touched = notes.where("turn % 2 = 0").select(F.col("note_id").alias("feedback_id"), "pinned")
    changes = touched.select("feedback_id", F.lit("seen").alias("status"), F.lit(1).alias("changed_at")).unionByName(
        touched.where("pinned").select("feedback_id", F.lit("closed").alias("status"), F.lit(2).alias("changed_at")))
    return study.feedback_page(feedback, changes).select("feedback_id", "user_id", "status")
