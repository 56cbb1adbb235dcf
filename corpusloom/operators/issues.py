"""Issue records to overviews, chunks and project summaries."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import richdoc, splitter, status
from corpusloom.functions.text import blank_to_null
from corpusloom.operators.prepare import chunk_header, number_chunks
from corpusloom.operators.ranking import placed, top_k
from corpusloom.storage import stage

FIELD = "struct<id: string, name: string, text: string>"


def field_dictionary(fields: DataFrame) -> DataFrame:
    usable = fields.filter(blank_to_null(F.col("id")).isNotNull() & blank_to_null(F.col("name")).isNotNull())
    return usable.groupBy("id").agg(F.max("name").alias("name"))


def custom_fields(issues: DataFrame, names: DataFrame, chars: int | None = None) -> DataFrame:
    """(key, fields): named custom fields of each issue in field-id order; a later field of a name wins.

    ``issues``: key, custom (map of field id to raw JSON). Texts are whole unless ``chars`` is given.
    """
    raw = issues.select("key", F.explode(F.map_filter("custom", lambda k, v: F.startswith(k, F.lit("customfield_")))).alias("id", "json"))
    texts = raw.withColumn("text", richdoc.json_value_text("json")).filter(~F.col("text").isin("", "{}", "[]"))
    named = texts.join(field_dictionary(names), "id", "left").select(
        "key", "id", F.coalesce("name", "id").alias("name"), (F.col("text") if chars is None else F.substring("text", 1, chars)).alias("text"))
    # a name keeps the place of its first field and the text of its last; one shuffle brings an issue's fields together
    return named.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "name", "text"))).alias("_all")).select(
        "key", _by_name(F.col("_all")).alias("fields"))


def _by_name(fields: Column) -> Column:
    """Fields in id order to one per name."""
    def merged(name):
        own = F.filter(fields, lambda f: f["name"] == name)
        last = F.element_at(own, -1)
        return F.struct(F.get(own, F.lit(0))["id"].alias("id"), name.alias("name"), last["text"].alias("text"))
    return F.array_sort(F.transform(F.array_distinct(F.transform(fields, lambda f: f["name"])), merged))


def field_map(fields: Column) -> Column:
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f["name"], f["text"])))


def is_date_field(name: Column, text: Column) -> Column:
    low = F.lower(name)
    named = F.lit(False)
    for token in fv.FIELD_DATE_NAMES:
        named = named | F.contains(low, F.lit(token))
    return named | text.rlike("(?U)" + fv.FIELD_DATE)


def date_fields(fields: Column) -> Column:
    return F.filter(fields, lambda f: is_date_field(f["name"], f["text"]))


def first_date(due: Column, dated: Column) -> Column:
    """The due date, else the text of the first of the date fields, which stand by field id."""
    return F.coalesce(blank_to_null(due), F.get(dated, F.lit(0))["text"])


def newest(issues: DataFrame, limit: int) -> DataFrame:
    """The newest so many issues of every project."""
    return top_k(issues, ["project"], [F.desc("updated"), F.col("key")], limit, name="newest_no")


def overview(issues: DataFrame) -> DataFrame:
    """Defaults and derived columns of issue records.

    ``issues``: key, project, project_name, summary, status_name, status_key, assignee, reporter, created, updated,
    duedate, fields (array of id, name, text).
    """
    none = F.array().cast(f"array<{FIELD}>")
    fields = F.coalesce("fields", none)
    return issues.withColumn("fields", fields).withColumn("date_fields", date_fields(F.col("fields"))).withColumns({
        "summary": F.coalesce(blank_to_null(F.col("summary")), blank_to_null(F.col("key")), F.lit("Untitled issue")),
        "project_name": F.coalesce(blank_to_null(F.col("project_name")), F.col("project")),
        "status_category": status.issue_category(F.col("status_key"), F.col("status_name")),
        "status_name": F.coalesce("status_name", F.lit("unknown")),
        "assignee": F.coalesce("assignee", F.lit("unassigned")),
        "reporter": F.coalesce("reporter", F.lit("unknown")),
        "due_date": first_date(F.col("duedate"), F.col("date_fields")),
    })


def comment_lines(comments: Column, limit: int = fv.MAX_COMMENTS) -> Column:
    """'- author at time: body' of the first comments; empty bodies are dropped after the cut."""
    kept = F.filter(F.slice(comments, 1, limit), lambda c: F.coalesce(c["body"], F.lit("")) != "")
    return F.transform(kept, lambda c: F.concat(
        F.lit("- "), F.coalesce(blank_to_null(c["author"]), F.lit("unknown")), F.lit(" at "),
        F.coalesce(blank_to_null(c["created"]), F.lit("unknown")), F.lit(": "), c["body"]))


def first_comments(comments: DataFrame, limit: int = fv.MAX_COMMENTS) -> DataFrame:
    """(key, comments) from a comment table (key, comment_no, author, created, body); cut before collecting."""
    kept = top_k(comments, ["key"], [F.col("comment_no")], limit, name="_n")
    items = F.array_sort(F.collect_list(F.struct("comment_no", "author", "created", "body")))
    return kept.groupBy("key").agg(items.alias("comments"))


def issue_text(rows: DataFrame) -> Column:
    """All lines of one issue. Optional columns: issue_type, priority, labels, components, fix_versions, description, comments."""
    have = set(rows.columns)
    none = F.array().cast("array<string>")

    def text(name, default="unknown"):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    def items(name):
        return F.coalesce(F.col(name), none) if name in have else none

    def pair(label, value):
        return F.concat(F.lit(label + ": "), value)

    def when_any(array, lines):
        return F.when(F.size(array) > 0, lines).otherwise(none)

    fields = F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), f["text"]))
    description = F.coalesce(F.col("description"), F.lit("")) if "description" in have else F.lit("")
    comments = comment_lines(F.col("comments")) if "comments" in have else none
    comments = F.coalesce(comments, none)
    stamp = lambda c: F.coalesce(F.col(c), F.lit("None"))
    lines = F.concat(
        F.array(
            F.lit("Content type: jira_issue"), pair("Issue key", F.col("key")), pair("Title", F.col("summary")),
            pair("Project", F.col("project_name")), pair("Issue type", text("issue_type")), pair("Status", F.col("status_name")),
            pair("Status category", F.col("status_category")), pair("Priority", text("priority")),
            pair("Assignee", F.col("assignee")), pair("Reporter", F.col("reporter")),
            pair("Created", stamp("created")), pair("Updated", stamp("updated")),
        ),
        F.when(blank_to_null(F.col("due_date")).isNotNull(), F.array(pair("Due date", F.col("due_date")))).otherwise(none),
        when_any(items("labels"), F.array(pair("Labels", F.array_join(items("labels"), ", ")))),
        when_any(items("components"), F.array(pair("Components", F.array_join(items("components"), ", ")))),
        when_any(items("fix_versions"), F.array(pair("Fix versions", F.array_join(items("fix_versions"), ", ")))),
        when_any(fields, F.concat(F.array(F.lit(""), pair("Custom fields indexed", F.size(fields).cast("string"))), fields)),
        F.when(description != "", F.array(F.lit(""), F.lit("Description:"), description)).otherwise(none),
        when_any(comments, F.concat(F.array(F.lit(""), pair("Comments indexed", F.size(comments).cast("string"))), comments)),
    )
    return F.array_join(lines, "\n")


def issue_chunks(overviews: DataFrame, site: str = "", pieces: Column | None = None) -> DataFrame:
    """Chunk rows of issues with the issue columns on every chunk."""
    rows = overviews.withColumn("text", issue_text(overviews))
    cut = number_chunks(rows, splitter.recursive_chunks("text") if pieces is None else pieces)
    return cut.select(
        F.concat_ws(":", "key", F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("key").alias("page_id"),
        F.concat_ws(" ", "key", "summary").alias("title"), F.concat(F.lit(site + "/browse/"), "key").alias("url"),
        F.col("project").alias("space"), F.col("project_name").alias("space_name"),
        F.concat("project_name", F.lit(" > "), "key").alias("breadcrumb"), F.lit(fv.ISSUE_TYPE).alias("content_type"),
        F.lit(fv.TRACKER).alias("source_type"), F.col("key").alias("issue_key"), F.col("status_name").alias("issue_status"),
        F.col("status_category").alias("issue_status_category"), "assignee", "reporter", "due_date", "updated", "created",
        field_map(F.col("fields")).alias("jira_custom_fields"), field_map(F.col("date_fields")).alias("jira_date_fields"),
        "chunk_index",
        F.concat(chunk_header(F.col("chunk_index"), F.col("chunk_count")), F.col("piece")).alias("page_content"))


LABELS = {"todo": "To do", "in_progress": "In progress", "done": "Done"}  # fixed values


def project_summary(overviews: DataFrame, size: int = fv.MAX_ISSUES) -> DataFrame:
    """Counts per category and the text of each project's status summary, in parts of at most ``size`` issues.

    Issues stand by category, the newest first. They are placed by a range sort, so no task holds a whole project; a project of
    up to ``size`` issues has one part, which is its whole summary.
    """
    details = F.concat_ws(
        "; ", F.concat(F.lit("status="), F.col("status_name")), F.concat(F.lit("assignee="), F.col("assignee")),
        F.concat(F.lit("updated="), F.coalesce("updated", F.lit("None"))),
        F.concat(F.lit("due_date="), blank_to_null(F.col("due_date"))))
    line = F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.col("summary"), F.lit(" ("), details, F.lit(")"))
    kind = F.col("status_category")
    section = F.coalesce(*[F.when(kind == c, i) for i, c in enumerate(LABELS, 1)])
    counts = overviews.groupBy("project").agg(
        F.min("project_name").alias("project_name"), F.count("*").alias("issues"), *[F.count_if(kind == c).cast("int").alias(c) for c in LABELS])
    rows = overviews.select("project", section.alias("section"), F.coalesce("updated", F.lit("")).alias("updated"), "key", line.alias("line")).filter("section is not null")
    lines = placed(rows, ["project"], [F.col("section"), F.desc("updated"), F.col("key")]).select(
        "project", F.floor((F.col("place") - 1) / size).cast("int").alias("part_no"), "section", "place", "line")

    # heads stand before the first line of their section, blank lines after the last; an empty section is at the end of those before it
    total = {c: sum((F.col(x) for x in list(LABELS)[:i]), F.lit(0)) for i, c in enumerate([*LABELS, None])}
    part_of = lambda place: F.floor(F.greatest(place - 1, F.lit(0)) / size).cast("int")
    extra = [F.struct(F.lit(0).alias("part_no"), F.lit(0).alias("section"), F.lit(i).cast("long").alias("place"), text.alias("line")) for i, text in enumerate([
        F.lit("Content type: jira_project_status_summary"), F.concat(F.lit("Project: "), F.col("project_name"), F.lit(" ("), F.col("project"), F.lit(")")),
        F.concat(F.lit("Total issues indexed: "), F.col("issues").cast("string")),
        F.concat(F.lit("Status category counts: "), F.concat_ws(", ", *[F.concat(F.lit(f"{LABELS[c]}="), F.col(c).cast("string")) for c in LABELS])), F.lit("")])]
    for i, c in enumerate(LABELS, 1):
        first, last = total[c] + F.when(F.col(c) > 0, 1).otherwise(0), total[c] + F.col(c)
        head = F.concat(F.lit(f"{LABELS[c]} issues ("), F.col(c).cast("string"), F.lit("):"))
        for place, at, text in ((first, F.lit(0), head), (first, F.lit(1), F.when(F.col(c) == 0, F.lit("- None"))), (last, F.lit(1 << 60), F.lit(""))):
            extra.append(F.struct(part_of(place).alias("part_no"), F.lit(i).alias("section"), at.cast("long").alias("place"), text.alias("line")))
    heads = counts.select("project", F.explode(F.array(*extra)).alias("x")).select("project", "x.*").filter("line is not null")
    parts = lines.unionByName(heads).groupBy("project", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("section", "place", "line"))).alias("lines"))  # at most ``size`` lines and the heads
    return parts.join(counts, "project").select(
        "project", "project_name", "part_no", "issues", *LABELS, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def summary_chunks(summaries: DataFrame, site: str = "", pieces: Column | None = None) -> DataFrame:
    """Chunk rows of project summaries; the chunks of a project's parts are numbered through."""
    # a part's whole text must not be written beside each of its pieces
    cut = stage(number_chunks(summaries, splitter.recursive_chunks("text") if pieces is None else pieces).drop("text"), "summary_pieces")
    before = Window.partitionBy("project").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("project")
    parts = cut.groupBy("project", "part_no").agg(F.max("chunk_count").alias("_n")).select(
        "project", "part_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    cut = cut.join(parts, ["project", "part_no"]).withColumns({"chunk_index": (F.col("chunk_index") + F.col("_before")).cast("int"), "chunk_count": F.col("_all")})
    page = F.concat("project", F.lit(":status-summary"))
    counts = F.create_map(*[x for c in LABELS for x in (F.lit(c), F.col(c))])
    return cut.select(
        F.concat_ws(":", page, F.col("chunk_index").cast("string")).alias("chunk_id"), page.alias("page_id"),
        F.concat("project", F.lit(" Jira status summary")).alias("title"),
        F.concat(F.lit(site + "/jira/software/projects/"), "project", F.lit("/issues")).alias("url"),
        F.col("project").alias("space"), F.col("project_name").alias("space_name"),
        F.concat("project_name", F.lit(" > Jira status summary")).alias("breadcrumb"),
        F.lit(fv.PROJECT_SUMMARY_TYPE).alias("content_type"), F.lit(fv.TRACKER).alias("source_type"),
        F.lit("summary").alias("issue_status_category"), counts.alias("jira_status_counts"), "chunk_index",
        F.concat(chunk_header(F.col("chunk_index"), F.col("chunk_count")), F.col("piece")).alias("page_content"))
