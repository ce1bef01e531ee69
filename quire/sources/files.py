"""Readers of link, file and text sources, and writers of exports and event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import equal
from .markdown import page_markdown

#: The export's columns and their headers.
EXPORT = {
    "building_id": "Building ID", "building_name": "Building Name", "room_id": "Room ID", "room_name": "Room Name", "product": "Product", "material_description": "Material Description", "extent": "Extent",
    "location": "Location", "friable": "Friable", "material_condition": "Material Condition", "risk_status": "Risk Status", "result": "Result", "page_number": "Page Number",
}


def page_text(html: Column) -> Column:
    """Visible text of a web page: scripts, styles and comments go, blocks end a line, five named entities are read."""
    x = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r" ?\n\s*", "\n"), r"^\s+|\s+$", "")


def link_sources(pages: DataFrame, markdown: bool = False) -> DataFrame:
    """id, title, url, full_text of web pages (page_id, url, html); the text with its structure as markdown, or plain."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select(F.concat(F.lit("source:page"), F.col("page_id").cast("string")).alias("id"), F.nullif(title, F.lit("")).alias("title"), F.col("url"), (page_markdown("html") if markdown else page_text(F.col("html"))).alias("full_text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("full_text"))


def consolidated(files: DataFrame) -> DataFrame:
    """folder and one text of its markdown files in order of name, each under a heading; index.md is left out."""
    x = files.where(F.endswith("path", F.lit(".md"))).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), "full_text").where("name <> 'index'")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("name", "full_text"))), lambda p: F.concat(F.lit("## "), p["name"], F.lit("\n\n"), p["full_text"]))
    return x.groupBy("folder").agg(F.array_join(parts, "\n\n").alias("text"))


def export_rows(records: DataFrame, source_id: str | None = None) -> DataFrame:
    """The export's columns under their headers, nulls and page 0 as '', in order of building and room; columns that
    records lack are ''."""
    x = equal(records, source_id=source_id).orderBy("building_id", "room_id", "id")
    text = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("0")) if c == "page_number" else F.col(c).cast("string"), F.lit(""))
    return x.select(*[(text(c) if c in records.columns else F.lit("")).alias(header) for c, header in EXPORT.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, emptyValue="")


def export_name(title: Column) -> Column:
    return F.concat(F.lit("acm_export_"), F.replace(title, F.lit(" "), F.lit("_")), F.lit(".csv"))


def event_frames(rows: DataFrame) -> DataFrame:
    """frame: each row as an event frame `data: {json}`."""
    return rows.select(F.concat(F.lit("data: "), F.to_json(F.struct(*rows.columns)), F.lit("\n\n")).alias("frame"))


def parsed_frames(frames: DataFrame, schema: str) -> DataFrame:
    """Rows of the schema from texts of event frames; lines that are no data or no JSON are skipped."""
    lines = frames.select(F.explode(F.split("frame", "\n")).alias("line")).where(F.startswith("line", F.lit("data: ")))
    broken = F.from_json(F.substring("line", 7, 1 << 30), schema + ", __broken string", {"columnNameOfCorruptRecord": "__broken"})
    return lines.select(broken.alias("x")).where("x.__broken IS NULL").select("x.*").drop("__broken")
