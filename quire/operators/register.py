"""Register records from markdown: headings give the context, tables give the rows.

A document's lines are numbered and classified by expressions; what a heading sets is carried on by windows over one
document, whose length bounds a window's partition. Lines of a table never set context, so a row's context is that of
the table's first line.

What is rebuilt as it is: a result that names "detected" becomes Detected, even "Not Detected"; a heading may count as
building and room at once; a room keeps the area of an earlier one in its building; one blank line does not end a
table; empty header cells are dropped and empty data cells are not.

Null and empty texts give no rows. Documents with one id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: The patterns of headings and marks, and the words of table headers.
BUILDING = r"(?i)^#+\s*(?:Building[:\s]*)?([A-Z]\d+[A-Z]?)\s*[-–]\s*([^-–\n]+?)(?:\s*[-–]\s*(\d{4}))?(?:\s*[-–]\s*([^-–\n]+?))?$"
ROOM = r"(?i)^#+\s*(?:Room[:\s]*)?([A-Z0-9]+-?R?\d+)\s*[-–]\s*([^-–\n]+?)(?:\s*[-–]\s*([\d.]+)\s*m²)?$"
AREA = r"(?i)^#+\s*(?:Area\s*Type[:\s]*)?(\bExterior\b|\bInterior\b|\bGrounds\b)"
SCHOOL = r"(?im)^#\s*([^-–\n]+?)(?:\s*[-–]\s*(?:Asbestos|ACM|SAMP).*)?$"
PAGE = r"(?i)(?:^|\n)[-—]+\s*Page\s+(\d+)\s*[-—]+"
HEADERS = ["product", "result", "material description"]
#: Which words of a header name which field; the first that holds counts.
FIELDS = [("product", ["product"]), ("material_description", ["material", "desc"]), ("extent", ["extent"]), ("location", ["location"]), ("friable", ["friable"]), ("material_condition", ["condition"]), ("risk_status", ["risk"]), ("result", ["result"])]


def _found(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def _groups(line: Column, pattern: str, n: int) -> Column:
    """All n groups of a pattern that takes a whole line, matched once; null if it does not match. A line holds no line end."""
    found = F.split(F.regexp_replace(line, pattern, "\n".join(f"${i + 1}" for i in range(n))), "\n", -1)
    return F.when(F.size(found) == n, found)


def _group(found: Column, i: int) -> Column:
    return F.nullif(F.get(found, F.lit(i - 1)), F.lit(""))


#: Every character of Unicode's white space.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _strip(c: Column) -> Column:
    # mostly only spaces stand at the ends; each of the others is looked for only if an end is not plain
    x = F.trim(c)
    plain = F.left(x, F.lit(1)).between("!", "~") & F.right(x, F.lit(1)).between("!", "~")
    return F.when((x == "") | plain, x).otherwise(F.btrim(x, F.lit(WHITE)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that are not blank, stripped, and their places."""
    x = docs.select(F.col(id_col).alias("source_id"), F.xxhash64(text_col).alias("doc"), F.col(text_col).alias("text"))
    # rows that are repeated are one document; empty ones go after that, as a filter on the text would have the text made twice
    x = x.groupBy("doc", "source_id").agg(F.first("text").alias("text")).where(F.length("text") > 0)
    school = F.coalesce(_strip(_found(F.col("text"), SCHOOL, 1)), F.lit("Unknown School"))
    x = x.select("source_id", "doc", school.alias("school_name"), F.split("text", "\n").alias("lines"))  # once a text, not once a line
    return x.select("source_id", "doc", "school_name", F.posexplode("lines").alias("n", "raw")).select("source_id", "doc", "school_name", "n", _strip(F.col("raw")).alias("line")).where("line <> ''")


def _document() -> tuple[WindowSpec, WindowSpec]:
    """A document's lines in their order, and those up to a line. All windows have this order, so that lines are sorted once."""
    doc = Window.partitionBy("doc", "source_id").orderBy("n")
    return doc, doc.rowsBetween(Window.unboundedPreceding, 0)


def _marked(lines: DataFrame) -> DataFrame:
    """Adds which lines belong to a table, and which are its header; of the others only pipes, headings and page marks stay."""
    line, n = F.col("line"), F.col("n")
    doc, so_far = _document()
    has = lambda word: F.contains(F.lower("line"), F.lit(word))
    x = lines.withColumn("pipe", F.contains(line, F.lit("|")))
    # blank lines are gone: a run of pipes goes on over one of them, and ends at two or at any other line
    x = x.withColumn("begins", ~F.col("pipe") | ~F.coalesce(F.lag("pipe").over(doc) & (n - F.lag("n").over(doc) <= 2), F.lit(False)))
    cells = F.array_join(F.filter(F.transform(F.split(F.lower("line"), r"\|"), _strip), lambda c: c != ""), " ")
    x = x.withColumn("head", F.col("pipe") & (has(HEADERS[0]) | has(HEADERS[1]) | (has(HEADERS[2].split(" ")[0]) & F.contains(cells, F.lit(HEADERS[2])))))
    # a line is in a table if its run has a header before it
    began = F.max(F.when(F.col("begins"), n)).over(so_far)
    header = F.max(F.when(F.col("head"), n)).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("in_table", F.coalesce(header >= began, F.lit(False)))
    return x.where(F.col("pipe") | F.left(line, F.lit(1)).isin("#", "-", "—"))


def _context(x: DataFrame) -> DataFrame:
    """Rows of tables (lines with cells) with the places of their table's fields, and the context that holds at each."""
    outside = F.when(~F.col("in_table"), F.col("line"))
    # a heading begins with #, a page's mark with a dash: no other line is matched against patterns
    line, mark = F.when(F.startswith(outside, F.lit("#")), outside), F.when(F.left(outside, F.lit(1)).isin("-", "—"), outside)
    x = x.withColumns({"b": _groups(line, BUILDING, 4), "r": _groups(line, ROOM, 3), "a": F.initcap(_found(line, AREA, 1)), "page": _found(mark, PAGE, 1).cast("int")})
    new, b, r = F.col("b").isNotNull(), F.col("b"), F.col("r")
    building = F.when(new, F.struct(_strip(_group(b, 1)).alias("id"), _strip(_group(b, 2)).alias("name"), _group(b, 3).cast("int").alias("year"), _strip(_group(b, 4)).alias("construction")))
    room = F.when(r.isNotNull(), F.struct(_strip(_group(r, 1)).alias("id"), _strip(_group(r, 2)).alias("name")))
    names = F.filter(F.transform(F.split(F.lower("line"), r"\|"), _strip), lambda c: c != "")
    fields = F.when(F.col("head") & ~F.col("in_table"), F.transform(names, _field_of))
    # the last header of a field counts; null if there is none
    where = {f: F.size("fields") - F.nullif(F.array_position(F.reverse("fields"), f), F.lit(0)) for f, _ in FIELDS}
    where = F.when(F.col("fields").isNotNull(), F.struct(*[c.cast("int").alias(f) for f, c in where.items()]))
    row = F.col("in_table") & F.col("pipe") & ~F.contains("line", F.lit("---"))
    # what a building or a room sets; a building sets what it lacks to null
    set_by = lambda c: F.when(new | c.isNotNull(), F.struct(c.alias("x")))
    x = x.withColumn("fields", fields).withColumn("where", where)
    x = x.select("source_id", "doc", "n", "school_name", F.when(row, _cells(F.col("line"))).alias("cells"), F.col("where"), building.alias("building"), set_by(room).alias("room"), set_by(_group(r, 3).try_cast("double")).alias("room_area"), F.when(new, "Interior").otherwise(F.col("a")).alias("area_type"), F.col("page").alias("page_number"))
    held = {c: F.last(c, ignorenulls=True).over(_document()[1]) for c in ("where", "building", "room", "room_area", "area_type", "page_number")}
    held |= {"room": held["room"]["x"], "room_area": held["room_area"]["x"], "area_type": F.coalesce(held["area_type"], F.lit("Interior")), "page_number": F.coalesce(held["page_number"], F.lit(1))}
    return x.withColumns(held).where(F.size("cells") >= 2)


def _cells(line: Column) -> Column:
    """Cells of a data row; one empty cell goes at either end."""
    return F.transform(F.split(F.regexp_replace(line, r"^\||\|\z", ""), r"\|", -1), _strip)


def _field_of(header: Column) -> Column:
    out = None
    for field, needed in FIELDS:
        here = F.contains(header, F.lit(needed[0]))
        for w in needed[1:]:
            here = here & F.contains(header, F.lit(w))
        out = F.when(here, field) if out is None else out.when(here, field)
    return out.otherwise(F.lit(""))


def extract_records(docs: DataFrame, id_col: str = "id", text_col: str = "full_text") -> DataFrame:
    """One row for each record, in the shape of the register; `row_number` is its place among the document's lines."""
    table = _context(_marked(_lines(docs, id_col, text_col)))

    def cell(field: str) -> Column:
        return F.nullif(F.get("cells", F.col("where")[field]), F.lit(""))

    result = cell("result")
    result = F.when(F.contains(F.lower(result), F.lit("no asbestos")), "Not Detected").when(F.contains(F.lower(result), F.lit("detected")), "Detected").otherwise(F.coalesce(result, F.lit("")))
    out = table.select(
        "source_id", "school_name", F.lit(None).cast("string").alias("school_code"), F.coalesce("building.id", F.lit("Unknown")).alias("building_id"), F.col("building.name").alias("building_name"), F.col("building.year").alias("building_year"),
        F.col("building.construction").alias("building_construction"), F.col("room.id").alias("room_id"), F.col("room.name").alias("room_name"), "room_area", "area_type", "page_number",
        *[cell(f).alias(f) for f, _ in FIELDS if f != "result"], result.alias("result"), F.col("n").alias("row_number"),
    )
    return out.where(F.col("product").isNotNull() & F.col("material_description").isNotNull())


REQUIRED = ["school_name", "building_id", "product", "material_description", "result"]


def validated(records: DataFrame) -> DataFrame:
    """Adds `valid`: the required fields are not blank."""
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.coalesce(_strip(F.col(c)) != "", F.lit(False))
    return records.withColumn("valid", ok)


def extraction_tally(docs: DataFrame, existing: DataFrame, id_col: str = "id", text_col: str = "full_text") -> DataFrame:
    """created, deleted, failed: a document's old records go before its new ones are made, even if there are none."""
    x = validated(extract_records(docs, id_col, text_col)).agg(F.count_if("valid").alias("created"), F.count_if(~F.col("valid")).alias("failed"))
    ids = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("source_id")).distinct()
    return x.join(existing.join(ids, "source_id", "left_semi").agg(F.count("*").alias("deleted"))).select("created", "deleted", "failed")
