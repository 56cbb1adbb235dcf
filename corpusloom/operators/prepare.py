"""Landed pages and structured objects to chunk rows."""

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import html, richdoc, splitter
from corpusloom.functions.text import absolute_url, blank_to_null, content_url
from corpusloom.operators.ranking import best_per_key


def breadcrumb(ancestors: Column, title: Column, skip_empty: bool = False) -> Column:
    """Ancestor titles and the own title, joined by ' > '."""
    names = F.transform(ancestors, lambda a: a["title"])
    if skip_empty:
        names = F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")
    return F.array_join(F.concat(F.coalesce(names, F.array().cast("array<string>")), F.array(title)), " > ")


def page_body(export_view: Column, storage: Column) -> Column:
    return F.coalesce(blank_to_null(export_view), blank_to_null(storage))


def issue_labels(issues: DataFrame) -> DataFrame:
    """Label of every issue key: key, summary, status and custom fields.

    ``issues``: key, summary, status, custom (array of 'name: text' lines).
    """
    extra = F.when(F.size("custom") > 0, F.concat(F.lit("; "), F.array_join("custom", "; "))).otherwise("")
    summary = blank_to_null(F.col("summary"))
    named = F.concat(F.col("key"), F.lit(": "), summary)
    state = F.concat(F.lit(" ("), blank_to_null(F.col("status")), F.lit(")"))
    return issues.select("key", F.concat(F.coalesce(F.concat(named, state), named, F.col("key")), extra).alias("label"))


def link_labels(pages: DataFrame, issues: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, labels map) for pages with links whose label comes from an issue or a project.

    Every link key is looked up by a join; the per-page map only holds that page's own keys.
    """
    wanted = pages.filter(F.contains(F.lower("body"), F.lit("<a")) | F.contains(F.lower("body"), F.lit("<span"))).select(
        "id", F.explode(html.html_lookup_keys("body")).alias("link")).select("id", "link.kind", "link.key").distinct()
    issue = wanted.filter(F.col("kind") == "issue").join(issue_labels(issues), "key")
    named = projects.filter(blank_to_null(F.col("name")).isNotNull()).select(
        "key", F.concat("name", F.lit(" ("), "key", F.lit(")")).alias("label"))
    project = wanted.filter(F.col("kind") == "project").join(named, "key")
    found = issue.unionByName(project).groupBy("id", "key").agg(F.min("label").alias("label"))
    return found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "label"))).alias("labels"))


def page_text(pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Pages with ``text``: mark-up with links and tables rewritten, or the rich document when it is empty."""
    no_labels = F.lit(None).cast("map<string,string>")
    joined = pages.withColumn("labels", no_labels) if labels is None else pages.join(labels, "id", "left")
    from_html = html.html_text(F.col("body"), F.col("title"), F.col("labels"))
    rich = F.regexp_replace(richdoc.rich_markdown(F.col("adf")), r"(?U)^\s+|\s+$", "")
    from_rich = F.when(rich != "", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), rich))
    return joined.withColumn("text", F.when(F.col("body").isNotNull(), from_html).otherwise(from_rich)).drop("labels")


def number_chunks(rows: DataFrame, pieces: Column) -> DataFrame:
    """One row per piece with its 0-based index and the piece count."""
    # the outer form keeps the planner from testing the pieces once more in a pushed-down filter
    cut = rows.withColumn("_pieces", pieces).select(
        *rows.columns, F.size("_pieces").alias("chunk_count"), F.posexplode_outer("_pieces").alias("chunk_index", "piece"))
    return cut.filter(F.col("chunk_index").isNotNull())


def chunk_header(index: Column, count: Column) -> Column:
    return F.concat(F.lit("Chunk: "), (index + 1).cast("string"), F.lit("/"), count.cast("string"), F.lit("\n\nContent:\n"))


def page_prefix(kind: Column, space_name: Column, space: Column, crumb: Column) -> Column:
    return F.concat(
        F.lit("Content type: "), kind, F.lit("\nSpace: "), space_name, F.lit(" ("), space,
        F.lit(")\nDocument location: "), crumb, F.lit("\n\n"))


def _chunk_id(page_id: Column) -> Column:
    return F.concat_ws(":", page_id, F.col("chunk_index").cast("string"))


def page_chunks(pages: DataFrame, pieces: Column | None = None) -> DataFrame:
    """Enriched chunk rows of pages.

    ``pages``: id, title, kind, url, space, space_name, breadcrumb, text.
    """
    usable = pages.filter(blank_to_null(F.col("text")).isNotNull())
    rows = number_chunks(usable, splitter.table_aware_chunks("text") if pieces is None else pieces)
    prefix = page_prefix(F.col("kind"), F.col("space_name"), F.col("space"), F.col("breadcrumb"))
    return rows.select(
        _chunk_id(F.col("id")).alias("chunk_id"), F.col("id").alias("page_id"), "title", "url", "space", "space_name", "breadcrumb",
        F.col("kind").alias("content_type"), F.lit(fv.WIKI).alias("source_type"), "chunk_index",
        F.concat(prefix, chunk_header(F.col("chunk_index"), F.col("chunk_count")), F.col("piece")).alias("page_content"),
    )


def with_location(pages: DataFrame, space: str | Column, space_name: str | Column, site: str, base: str) -> DataFrame:
    """Landed pages with body, breadcrumb, link and space columns."""
    return pages.select(
        "id", "title", F.coalesce("type", F.lit("page")).alias("kind"), page_body(F.col("export_view"), F.col("storage")).alias("body"),
        "adf", breadcrumb(F.col("ancestors"), F.col("title")).alias("breadcrumb"),
        content_url(F.col("webui"), F.col("type"), F.col("id"), F.lit(space), F.col("base"), F.lit(site), F.lit(base)).alias("url"),
        F.lit(space).alias("space"), F.lit(space_name).alias("space_name"),
    )


def object_text(title: Column, item_id: Column, space_name: Column, space: Column, crumb: Column, parent_type: Column,
                parent_id: Column, version: Column, children: Column) -> Column:
    """Descriptive lines of a structured object."""
    child_lines = F.transform(children, lambda c: F.concat(
        F.lit("- "), F.coalesce(c["type"], F.lit("content")), F.lit(": "), F.coalesce(blank_to_null(c["title"]), c["id"])))
    number = F.coalesce(version["number"].cast("string"), F.lit("unknown"))
    lines = F.array_compact(F.array(
        F.lit("Content type: database"), F.concat(F.lit("Title: "), title), F.concat(F.lit("Database ID: "), item_id),
        F.concat(F.lit("Space: "), space_name, F.lit(" ("), space, F.lit(")")), F.concat(F.lit("Document location: "), crumb),
        F.concat(F.lit("Parent: "), F.coalesce(blank_to_null(parent_type), F.lit("content")), F.lit(" "), blank_to_null(parent_id)),
        F.when(version.isNotNull(), F.concat(F.lit("Version: "), number)),
        F.concat(F.lit("Version created at: "), blank_to_null(version["createdAt"])),
        F.when(F.size(children) > 0, F.lit("Direct children:")),
    ))
    note = F.array(F.lit(
        "Note: Confluence's public REST API exposes database metadata, but not database rows/entries for indexing."))
    return F.array_join(F.concat(lines, F.coalesce(child_lines, F.array().cast("array<string>")), note), "\n")


def object_chunks(objects: DataFrame, space: str, space_name: str, site: str, base: str) -> DataFrame:
    """Chunk rows of structured objects: id, title, parentId, parentType, spaceKey, version, directChildren, ancestors."""
    title = F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled database"))
    crumb = breadcrumb(F.col("ancestors"), title, skip_empty=True)
    rows = objects.select(
        "id", title.alias("title"), crumb.alias("breadcrumb"), F.lit(space).alias("space"), F.lit(space_name).alias("space_name"),
        content_url(F.lit(None).cast("string"), F.lit("database"), F.col("id"), F.col("spaceKey"), F.lit(None).cast("string"),
                    F.lit(site), F.lit(base)).alias("url"),
        object_text(title, F.col("id"), F.lit(space_name), F.lit(space), crumb, F.col("parentType"), F.col("parentId"),
                    F.col("version"), F.col("directChildren")).alias("text"),
    )
    return number_chunks(rows, splitter.recursive_chunks("text")).select(
        _chunk_id(F.col("id")).alias("chunk_id"), F.col("id").alias("page_id"), "title", "url", "space", "space_name", "breadcrumb",
        F.lit("database").alias("content_type"), F.lit(fv.WIKI).alias("source_type"), "chunk_index",
        F.concat(chunk_header(F.col("chunk_index"), F.col("chunk_count")), F.col("piece")).alias("page_content"))


def image_rows(pages: DataFrame, site: str, base: str) -> DataFrame:
    """One descriptive row per distinct image of a page.

    ``pages``: id, title, body, space, space_name, breadcrumb, url.
    """
    found = pages.select(*[c for c in pages.columns if c != "body"], F.explode(html.html_images("body")).alias("image")).select("*", "image.*")
    link = F.when(blank_to_null(F.col("link")).isNotNull(), absolute_url(F.col("link"), F.lit(site), F.lit(base))).otherwise("")
    located = found.withColumn("image_url", link)
    name = F.regexp_extract(F.regexp_extract("image_url", r"^(?:https?://[^/?#]*)?([^?#]*)", 1), r"([^/]*)$", 1)
    from_url = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    named = located.withColumn("filename", F.coalesce(blank_to_null(F.col("file")), from_url, F.lit(""))).withColumn(
        "alt_text", F.coalesce(blank_to_null(F.col("alt")), F.col("filename")))
    key = F.coalesce(blank_to_null(F.col("image_url")), F.concat_ws(":", "id", "filename", F.col("image_no").cast("string")))
    once = best_per_key(named.withColumn("key", key).drop("image"), ["id", "key"], [F.col("image_no")]).filter(
        (F.col("image_url") != "") | (F.col("filename") != "") | (F.col("alt_text") != ""))

    def line(label, c):
        return F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))

    text = F.concat_ws(
        "\n", F.lit("Content type: image"), F.concat(F.lit("Parent page: "), F.col("title")),
        F.concat(F.lit("Space: "), F.col("space_name"), F.lit(" ("), F.col("space"), F.lit(")")),
        F.concat(F.lit("Document location: "), F.col("breadcrumb")),
        line("Filename: ", "filename"), line("Alt text: ", "alt_text"), line("Image URL: ", "image_url"),
        F.when(F.col("near") != "", F.concat(F.lit("\nSurrounding text:\n"), F.col("near"))))
    fallback = F.concat(F.col("title"), F.lit(" image "), (F.col("image_no") + 1).cast("string"))
    return once.select(
        F.col("id").alias("page_id"), F.coalesce(blank_to_null(F.col("filename")), fallback).alias("title"), "url", "image_url",
        F.col("title").alias("parent_title"), F.lit("image").alias("content_type"), F.col("image_no").alias("chunk_index"),
        text.alias("page_content"))


def merge_by_id(primary: DataFrame, fallback: DataFrame, key: str = "id") -> DataFrame:
    """Union of two listings; the primary row wins, rows without an id are dropped."""
    both = primary.withColumn("_side", F.lit(0)).unionByName(fallback.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_side"), *[F.col(c) for c in primary.columns if c != key]]
    return best_per_key(both.filter(blank_to_null(F.col(key).cast("string")).isNotNull()), [key], order).drop("_side")


def listing_diff(primary: DataFrame, fallback: DataFrame, key: str = "id") -> DataFrame:
    """Ids that only the fallback listing found."""
    return fallback.select(key).filter(F.col(key).isNotNull()).distinct().join(primary.select(key), key, "left_anti")


def completeness(primary: DataFrame, fallback: DataFrame, key: str = "id") -> DataFrame:
    """Row counts of both listings, of their merge and of the ids only the fallback found, in one pass."""
    tagged = primary.select(key, F.lit(1).alias("p"), F.lit(0).alias("f")).unionByName(
        fallback.select(key, F.lit(0).alias("p"), F.lit(1).alias("f")))
    per_id = tagged.groupBy(key).agg(F.sum("p").alias("p"), F.sum("f").alias("f"))
    has_id = F.col(key).isNotNull()
    return per_id.agg(
        F.sum("p").alias("primary_rows"), F.sum("f").alias("fallback_rows"), F.count_if(has_id).alias("merged_rows"),
        F.count_if(has_id & (F.col("p") == 0)).alias("fallback_only"))


def tree_roots(pages: DataFrame) -> DataFrame:
    """Pages without ancestors; all pages when every page has some. ``pages``: id, ancestors."""
    usable = pages.filter(blank_to_null(F.col("id").cast("string")).isNotNull())
    is_root = F.coalesce(F.size("ancestors"), F.lit(0)) < 1
    any_root = usable.agg(F.coalesce(F.max(is_root), F.lit(False)).alias("any_root")).withColumn("_k", F.lit(1))
    return usable.withColumn("is_root", is_root).withColumn("_k", F.lit(1)).join(any_root, "_k").filter(
        F.col("is_root") | ~F.col("any_root")).drop("is_root", "any_root", "_k")


def descendants(pages: DataFrame) -> DataFrame:
    """Distinct (root, id): pages below each root page, by their ancestor lists."""
    roots = tree_roots(pages).select(F.col("id").alias("root"))
    above = pages.select("id", F.explode("ancestors").alias("root")).distinct()
    return above.join(roots, "root").groupBy("id").agg(F.min("root").alias("root"))


def enrich(listing: DataFrame, details: DataFrame, key: str = "id", kind: str = "database") -> DataFrame:
    """Detail columns override the listing; missing details keep the listing row."""
    shared = [c for c in details.columns if c != key]
    renamed = details.select(key, *[F.col(c).alias(f"_d_{c}") for c in shared], F.lit(True).alias("_found"))
    joined = listing.filter(F.col(key).isNotNull()).join(renamed, key, "left")
    out = [F.coalesce(f"_d_{c}", c).alias(c) if c in shared else F.col(c) for c in listing.columns if c not in (key, "type")]
    extra = [F.col(f"_d_{c}").alias(c) for c in shared if c not in listing.columns]
    names = [F.col("_d_type")] if "type" in shared else []
    names += [F.col("type")] if "type" in listing.columns else []
    kind_col = F.coalesce(*names, F.when(F.col("_found"), F.lit(kind)))
    return joined.select(key, *out, *extra, kind_col.alias("type"))


def skipped(pages: DataFrame, chunks: DataFrame, sample: int | None = 20) -> DataFrame:
    """Pages that gave no chunk; a sample by id, or all of them."""
    missing = pages.join(chunks.select(F.col("page_id").alias("id")), "id", "left_anti")
    return missing if sample is None else missing.orderBy("id").limit(sample)
