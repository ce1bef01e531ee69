from quire.operators import register

REGISTER = """# Northgate School - Asbestos Register

--- Page 1 ---

## Building: H12C - Annex - 1938 - Timber

### Area Type: Exterior

#### Room: H12C-R004 - Porch - 17.5m²

| Product | Material Description | Extent | Location | Friable | Condition | Risk | Result |
|---|---|---|---|---|---|---|---|
| Floor Tiles | Vinyl tiles | 6m² | Floor | Non Friable | Good | Low | Detected |
| Lagging | Insulation | 8m | Ceiling | Friable | Fair | Medium | Not Detected |

| Vents | Cement | 1m | Wall | Friable | Fair | High | No Asbestos |

#### Room: H12C-R007 - Store

| Product | Material Description | Result |
|---|---|---|
| Door | | Detected |
| Panel | Board |  |
--- Page 2 ---
## Building: M3 - Hall

| Product | Material Description | Result |
|---|---|---|
| Roof | Sheet | Unknown |
"""


def extracted(spark, text, id="source:1"):
    df = spark.createDataFrame([(id, text)], "id string, full_text string")
    return [r.asDict() for r in register.extract_records(df).orderBy("source_id", "row_number").collect()]


def test_context_and_rows(spark):
    got = extracted(spark, REGISTER)
    assert [r["product"] for r in got] == ["Floor Tiles", "Lagging", "Vents", "Panel", "Roof"]
    assert {r["school_name"] for r in got} == {"Northgate School"}
    first = got[0]
    assert (first["building_id"], first["building_name"], first["building_year"], first["building_construction"]) == ("H12C", "Annex", 1938, "Timber")
    assert (first["room_id"], first["room_name"], first["room_area"], first["area_type"], first["page_number"]) == ("H12C-R004", "Porch", 17.5, "Exterior", 1)
    assert first["extent"] == "6m²" and first["risk_status"] == "Low" and first["school_code"] is None


def test_results(spark):
    # "Not Detected" names "detected"; only "no asbestos" is none; an empty cell stays empty
    assert [r["result"] for r in extracted(spark, REGISTER)] == ["Detected", "Detected", "Not Detected", "", "Unknown"]


def test_area_of_an_earlier_room_stays_and_a_building_resets(spark):
    got = extracted(spark, REGISTER)
    assert (got[3]["room_id"], got[3]["room_area"]) == ("H12C-R007", 17.5)
    last = got[4]
    assert (last["building_id"], last["building_year"], last["room_id"], last["room_area"], last["area_type"], last["page_number"]) == ("M3", None, None, None, "Interior", 2)


def test_unprefixed_room_heading_is_a_building_too(spark):
    got = extracted(spark, "#### Q5-R3 - Boiler Room\n| Product | Material Description |\n| A | B |\n")[0]
    assert (got["building_id"], got["building_name"], got["building_construction"], got["room_id"]) == ("Q5", "R3", "Boiler Room", "Q5-R3")


def test_building_heading_is_a_room_too(spark):
    got = extracted(spark, "## Q5 - Main\n| Product | Material Description |\n| A | B |\n")[0]
    assert (got["building_id"], got["room_id"]) == ("Q5", "Q5")


def test_blank_header_cells_shift_columns(spark):
    got = extracted(spark, "| | Product | Material Description |\n|---|---|---|\n| x | A | B |\n")
    assert [(r["product"], r["material_description"]) for r in got] == [("x", "A")]


def test_two_blank_lines_end_a_table(spark):
    text = "| Product | Material Description |\n| A | B |\n\n\n| C | D |\n"
    assert [r["product"] for r in extracted(spark, text)] == ["A"]


def test_defaults_and_nothing(spark):
    got = extracted(spark, "| Product | Material Description | Result |\n| A | B | C |")[0]
    assert (got["school_name"], got["building_id"], got["area_type"], got["page_number"]) == ("Unknown School", "Unknown", "Interior", 1)
    for text in (None, "", "no table", "| Product | Material Description |"):
        assert extracted(spark, text) == []


def test_validation_and_tally(spark):
    docs = spark.createDataFrame([("source:1", REGISTER), ("source:2", "")], "id string, full_text string")
    old = spark.createDataFrame([("source:1",), ("source:1",), ("source:2",)], "source_id string")
    assert register.extraction_tally(docs, old).first().asDict() == {"created": 4, "deleted": 2, "failed": 1}


def test_strip_takes_unicode_white_space(spark):
    """btrim() over the listed characters takes what the pattern of Unicode's white space takes, for every character."""
    from pyspark.sql import functions as F

    from quire.operators import register

    x = spark.range(1, 0xD800).select(F.concat(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), F.lit(" x "), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')")).alias("t"))
    assert x.where(register._strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")).count() == 0


def test_texts_are_made_once_and_lines_sorted_once(spark):
    """A text that Python computes is computed once a row, and all windows over lines share one sort."""
    import re

    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType

    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf(StringType())
    def text(x):
        made.add(len(x))
        return x.map(lambda i: REGISTER + f"| Extra{i} | Sheet | Unknown |\n")

    docs = spark.range(10).select("id", text("id").alias("full_text"))
    out = register.extract_records(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[.*\bn#\d+", plan)) == 1
    assert out.count() == 10 * 6
    assert made.value == 10


def test_odd_tables(spark):
    """Rows at the ends of tables, blank and missing cells, a header's word in a row, a building that takes room and area away."""
    text = "## B1 - Hall\n#### R2-R003 - Porch - 3 m²\n| a | PRODUCT | Material Description |\n\n| 1 | p1 | m1 |\n| 2 | Product | m2 | x |\n||\n| 3 |  | m3 |\n4|p4|m4\n\n## C1 - Yard\n|Material Description|product|\n| m5 | \u2003p5 \u3000|"
    got = [(r["building_id"], r["room_id"], r["room_area"], r["product"], r["material_description"], r["row_number"]) for r in extracted(spark, text)]
    room = ("B1", "R2-R003", 3.0)
    assert got == [(*room, "p1", "m1", 4), (*room, "Product", "m2", 5), (*room, "p4", "m4", 8), ("C1", "C1", None, "p5", "m5", 12)]
