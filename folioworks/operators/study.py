"""Study material: sessions, blocks, related documents, talk outlines, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioworks import fixed_values as fv
from folioworks.functions.text import either
from folioworks.operators.catalog import active
from folioworks.operators.filters import json_text_ilike, resolve_column, source_match
from folioworks.operators.maintenance import merge_maps
from folioworks.operators.ranking import top_per_group
from folioworks.operators.skew import running_total
from folioworks.session import inline_table


def session_window(messages: DataFrame, most: int) -> DataFrame:
    """The newest messages of each session and its title, the head of the first one."""
    newest = top_per_group(messages, ["conv_id"], [F.desc("turn")], most)
    titles = messages.groupBy("conv_id").agg(F.min_by(F.left("text", F.lit(80)), "turn").alias("title"))
    return newest.select("conv_id", "turn", "role").join(titles, "conv_id")


def ordered_blocks(notes: DataFrame, post_its: DataFrame) -> DataFrame:
    """Two kinds of blocks in one numbered list per workspace.

    Positions are counted in two levels so that one crowded workspace does not
    become one task.
    """
    part = lambda df, kind: df.select(
        "workspace_id", F.col("note_id").alias("block_id"), F.lit(kind).alias("kind"), "sort_order", "updated_at")
    blocks = part(notes, "note").unionByName(part(post_its, "post_it"))
    order = [F.col("sort_order"), F.col("updated_at"), F.col("block_id")]
    numbered = running_total(blocks, ["workspace_id"], order, F.floor(F.col("sort_order") / 40), F.lit(1), "position")
    return numbered.select("workspace_id", "block_id", "kind", F.col("position").cast("bigint").alias("position"))


def _related_terms(query: str) -> list[str]:
    words = query.replace(",", " ").replace(";", " ").split()
    return [w for w in words if len(w) > 2][:8]


def related_documents(documents: DataFrame, sources: DataFrame, query: str, limit: int, *,
                      source_types: Sequence[str] = (), languages: Sequence[str] = ()) -> DataFrame:
    """Rank by how many of the query's terms occur in title or text."""
    rows = active(documents)
    if source_types:
        rows = rows.where(source_match(rows, source_types))
    if languages:
        rows = rows.where(F.col("language").isin(*languages))
    score, found = F.lit(0), []
    for term in _related_terms(query):
        like = F.lit(f"%{term}%")
        in_body = F.ilike("title", like) | F.ilike(F.coalesce("text", F.lit("")), like)
        found.append(in_body | F.ilike(F.coalesce("author", F.lit("")), like))
        score = score + F.when(in_body, 1).otherwise(0)
    if found:
        rows = rows.where(either(found))
    best = (rows.select("doc_id", "source_key", "updated_at", score.cast("double").alias("score"))
            .orderBy(F.desc("score"), F.desc("updated_at"), "doc_id").limit(limit))
    return best.join(sources.select("source_key", "source_name"), "source_key").select(
        "doc_id", "source_name", "score")


def talk_terms_of(topic: str, refs: Sequence[str]) -> list[str]:
    edge = ".,;:!?()[]{}\"'"
    words = [w.strip(edge).lower() for w in topic.split() if len(w.strip(edge)) > 2]
    terms = [w for w in words if w not in fv.TALK_STOPWORDS][:8]
    return [*terms, *refs] or [topic]


def talk_documents(documents: DataFrame, topic: str, refs: Sequence[str], limit: int, *,
                   language: str | None = None, source_types: Sequence[str] = ()) -> DataFrame:
    """3 points for a title or reference hit, 1 for a text hit, per term.

    When nothing matches, the newest documents stand in.  The fallback is
    planned as data: its rows pass only if the matching side is empty.
    """
    rows = active(documents)
    scoped = rows
    if language:
        scoped = scoped.where((F.col("language") == language) | F.col("language").isNull())
    if source_types:
        scoped = scoped.where(source_match(scoped, source_types))
    score, found = F.lit(0), []
    for term in talk_terms_of(topic, refs):
        like = f"%{term}%"
        refs_text = resolve_column(rows, ["scripture_refs"])
        ref_hit = F.coalesce(F.ilike(refs_text.cast("string"), F.lit(like)), F.lit(False))
        title_hit = F.ilike("title", F.lit(like)) | ref_hit
        text_hit = F.ilike(F.coalesce("text", F.lit("")), F.lit(like))
        found.append(title_hit | text_hit | F.ilike(F.coalesce("author", F.lit("")), F.lit(like))
                     | F.ilike(F.coalesce("category", F.lit("")), F.lit(like))
                     | json_text_ilike(F.col("tags"), [like]))
        score = score + F.when(title_hit, 3).when(text_hit, 1).otherwise(0)
    matched = (scoped.where(either(found)).withColumn("match_score", score)
               .orderBy(F.desc("match_score"), F.desc("updated_at"), "doc_id").limit(limit))
    hits = matched.agg(F.count("*").alias("n")).scalar()
    newest = (rows.withColumn("match_score", F.lit(0)).orderBy(F.desc("updated_at"), "doc_id").limit(min(limit, 5))
              .where(hits == 0))
    return matched.unionByName(newest)


def outline(spark: SparkSession, pool: DataFrame, topic: str, audience: str, minutes: int) -> DataFrame:
    """Sections by duration, each citing its round-robin pick and the one after.

    ``pool`` is the bounded citation list of one outline: (position, id, title),
    positions counted from 0.
    """
    sections = 3 if minutes <= 8 else 4 if minutes <= 15 else 5
    rows = [(i, f"section-{i + 1}", fv.OUTLINE_TITLES[i].format(topic=topic),
             fv.OUTLINE_PURPOSES[i].format(audience=audience)) for i in range(sections)]
    frame = inline_table(spark, ["section", "section_id", "title", "purpose"], rows)
    size = pool.agg(F.count("*").alias("n")).scalar()
    slots = frame.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("slot"))
    slots = slots.where((F.col("slot") == 0) | (size > 1)).withColumn(
        "position", F.when(size > 0, F.pmod(F.col("section") + F.col("slot"), size)))
    cited = pool.select("position", F.col("id").alias("citation_id"), F.col("title").alias("citation_title"))
    return slots.join(cited, "position", "left").select(
        "section", "section_id", "title", "purpose", "slot", "citation_id", "citation_title")


def export_lines(notes: DataFrame, per_page: int = 44) -> DataFrame:
    """The Markdown lines of every workspace, numbered and paginated.

    A workspace is never gathered into one string; each note contributes its
    lines, and line numbers come from a two-level running total.
    """
    title = F.concat(F.lit("### "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled note")))
    quote = F.when(F.coalesce("selected_text", F.lit("")) != "", F.concat(F.lit("> "), "selected_text"))
    body = F.split(F.coalesce("content", F.lit("")), "\n")
    ref_line = F.when(F.size("scripture_refs") > 0,
                      F.concat(F.lit("- Scripture refs: "), F.array_join("scripture_refs", ", ")))
    block = F.concat(
        F.array(title, F.lit("")),
        F.when(quote.isNotNull(), F.array(quote, F.lit(""))).otherwise(F.array().cast("array<string>")),
        body, F.array(F.lit("")), F.array_compact(F.array(ref_line)), F.array(F.lit("")))
    lines = notes.select("workspace_id", "turn", "note_id", F.posexplode(block).alias("line_in_note", "line"))
    order = [F.col("turn"), F.col("note_id"), F.col("line_in_note")]
    numbered = running_total(lines, ["workspace_id"], order, F.floor(F.col("turn") / 64), F.lit(1), "line_no")
    return numbered.select("workspace_id", "line_no", F.floor((F.col("line_no") - 1) / per_page).alias("page"), "line")


def wrap_lines(line: Column, width: int = 88) -> Column:
    """Greedy wrap at blanks, at most ``width`` characters per line."""
    plain = F.trim(F.regexp_replace(line, "[#>]", ""))
    words = F.filter(F.split(F.regexp_replace(plain, r"\s+", " "), " "), lambda w: w != "")
    pieces = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(f"(.{{1,{width}}})"), 1)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    fits = lambda acc, w: F.length(acc["open"]) + 1 + F.length(w) <= width
    folded = F.aggregate(pieces, start, lambda acc, w: F.when(
        acc["open"] == "", F.struct(acc["done"].alias("done"), w.alias("open"))
    ).when(fits(acc, w), F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["open"], w).alias("open"))
    ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), w.alias("open"))))
    return F.concat(folded["done"], F.array(folded["open"]))


def calling_emphasis(name: Column) -> Column:
    """Which family of callings a name belongs to, first rule wins."""
    n = F.lower(name)
    rules = [
        ("bishop", ["obispo"]), ("stake_president", ["presidente de estaca"]), ("area_seventy", ["setenta de area"]),
        ("relief_society", ["sociedad de socorro"]),
        ("teacher", ["maestro", "ensenanza", "instituto", "seminario"]),
        ("youth", ["joven", "diaconos", "maestros", "presbiteros"]),
    ]
    result = F.when(name.isNull() | (name == ""), "general_discipleship")
    for label, needles in rules:
        result = result.when(either([F.contains(n, F.lit(x)) for x in needles]), label)
    return result.otherwise("calling_duties")


def calling_display_name(enabled: Column, name: Column, custom: Column) -> Column:
    """The free-text calling replaces 'other'."""
    chosen = F.when(F.contains(F.lower(name), F.lit("otro")) & (F.coalesce(custom, F.lit("")) != ""), custom).otherwise(
        F.coalesce(F.nullif(name, F.lit("")), custom))
    return F.when(enabled, F.nullif(F.trim(chosen), F.lit("")))


def newest_access(access: DataFrame) -> DataFrame:
    """The latest row per e-mail, compared without case."""
    row = F.struct(*[F.col(c) for c in access.columns])
    latest = access.groupBy(F.lower("email").alias("_key")).agg(
        F.max_by(row, F.struct("updated_at", "access_id")).alias("r"))
    return latest.select("r.*")


def workspace_quota(workspaces: DataFrame, limit: int) -> DataFrame:
    """Workspaces per user and whether another one is allowed."""
    return workspaces.groupBy("user_id").agg(F.count("*").alias("workspaces")).withColumn(
        "may_create", F.col("workspaces") < limit)


def related_query(workspaces: DataFrame) -> DataFrame:
    """Search text, source types and language from a workspace's settings maps."""
    s, f = F.col("settings"), F.col("source_filters")
    parts = F.array(F.col("name"), s["title"], s["mainReference"], s["referenceType"])
    query = F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), " ")
    wanted = F.coalesce(f["sourceType"], f["source_key"], f["sourceKey"])
    folded = F.replace(F.replace(F.lower(F.trim(wanted)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    aliases = F.array().cast("array<string>")
    chain = None
    for name, spelled in fv.SOURCE_ALIASES.items():
        every_name = sorted({name, *spelled})
        values = F.array(*[F.lit(a) for a in every_name])
        chain = F.when(folded.isin(*every_name), values) if chain is None else chain.when(folded.isin(*every_name), values)
    types = F.when(wanted.isNull(), aliases).otherwise(F.coalesce(chain.otherwise(F.array(folded)), aliases))
    return workspaces.select("*", query.alias("query"), types.alias("source_types")).withColumn(
        "language", F.coalesce(s["language"], f["language"]))


def settings_with(base: Column, *, title: Column | None = None, scripture_reference: Column | None = None,
                  topic: Column | None = None) -> Column:
    """Given fields replace settings, a reference also sets its two companions."""
    pairs = []
    if title is not None:
        pairs += [F.lit("title"), title]
    if topic is not None:
        pairs += [F.lit("topic"), topic]
    if scripture_reference is not None:
        kind = F.when(scripture_reference.isNotNull(), "scripture")
        pairs += [F.lit("scriptureReference"), scripture_reference, F.lit("mainReference"), scripture_reference,
                  F.lit("referenceType"), kind]
    given = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return merge_maps(base, given)


def with_defaults(rows: DataFrame, stored: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """A row for everybody, defaults where nothing is stored."""
    return rows.join(stored, key, "left").select(
        key, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def string_list(raw: Column) -> Column:
    """List items, object values or the bare text as a list of non-empty strings."""
    items = (F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>"))
             .when(F.startswith(raw, F.lit("{")), F.map_values(F.from_json(raw, "map<string,string>")))
             .otherwise(F.array(raw)))
    return F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")


# Suggestion kinds and titles used when no model answers.
SUGGESTIONS = [
    ("ai_doctrinal_analysis", "Analisis doctrinal"),
    ("ai_reference", "Contexto de la escritura"),
    ("name_meaning", "Significado doctrinal de nombres"),
    ("calling_application", "Aplicacion para el llamamiento"),
    ("ai_quote", "Cita sugerida"),
    ("reflection_question", "Pregunta de reflexion"),
    ("powerful_phrase", "Frase poderosa"),
    ("scripture_connection", "Relacion con Jesucristo y otros pasajes"),
    ("manual_reference", "Manual doctrinal para revisar"),
    ("book_reference", "Libro doctrinal para revisar"),
]


def fallback_suggestions(projects: DataFrame, most: int) -> DataFrame:
    """T4: the wanted kinds in their fixed order, all kinds when none is known."""
    base = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(v).alias("title")) for k, v in SUGGESTIONS])
    wanted = F.filter(base, lambda s: F.array_contains(F.col("block_types"), s["type"]))
    chosen = F.slice(F.when(F.size(wanted) > 0, wanted).otherwise(base), 1, most)
    return projects.select("*", F.posexplode(chosen).alias("place", "s")).select("*", "s.type", F.col("s.title").alias("heading")).drop("s")


def source_filters(rows: DataFrame, deleted: DataFrame, workspaces: DataFrame) -> DataFrame:
    """The source filters that owners see in their workspaces, newest first; those named in ``deleted`` are gone."""
    owners = workspaces.select("workspace_id", "user_id")
    live = rows.where("deleted_at IS NULL").join(deleted.select("filter_id").distinct(), "filter_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc("updated_at"), "filter_id"))
    return live.join(owners, ["workspace_id", "user_id"], "left_semi").withColumn("place", place)


def feedback_page(feedback: DataFrame, changes: DataFrame, limit: int = 50) -> DataFrame:
    """The newest feedback after its status changes; the last change of an item counts."""
    last = changes.groupBy("feedback_id").agg(F.max_by("status", F.struct("changed_at", "status")).alias("_status"))
    return (feedback.join(last, "feedback_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
            .orderBy(F.desc("created_at"), "feedback_id").limit(min(max(limit, 1), 200)))
