"""Context sections deal out digests, and read whole lines again for those few that stay."""

from pyspark.sql import functions as F

from trustloom import context


def test_first_of_like_lines_stay_and_texts_are_not_dealt_out(spark, monkeypatch):
    rows = [("m1", "Prefer  Short\nwords", "active", None, 2), ("m2", "prefer short words", "active", None, 1), ("m3", "The backend uses Flask.", "superseded", "m4", 3), ("m4", "The backend uses FastAPI.", "active", None, 4),
            ("m5", "", "active", None, 5)]
    records = spark.createDataFrame(rows, "memory_id string, content string, status string, superseded_by string, created_s long").withColumns({"source_ref": F.lit(""), "sensitivity": F.lit("public")})
    records = records.unionByName(records.filter("memory_id = 'm5'").withColumns({"memory_id": F.lit("m6"), "sensitivity": F.lit("pii")}))
    seen, write = [], context.stored
    monkeypatch.setattr(context, "stored", lambda df: seen.append(set(df.columns)) or write(df))
    got = {(r.section, r.place, r.line) for r in context.section_rows(records).collect()}
    assert {("Coding Rules", 1, "prefer short words"), ("Tech Stack", 1, "Backend framework: FastAPI"), ("Important Decisions", 3, "Sensitive memory omitted from generated context."),
            ("Deprecated/Outdated Decisions", 1, "Backend framework was previously Flask; superseded by FastAPI.")} <= got
    assert not any("Prefer" in line for _, _, line in got) and seen == [{"section", "place", "_key", "_late", "created_s", "memory_id"}]
