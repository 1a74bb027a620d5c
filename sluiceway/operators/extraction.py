"""Candidates from bodies and tables, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attachment_locator, body_locator, cell_locator, currency_of, mapping_confidence, normal_label, normal_value, parse_amount, parse_date, plain_header


def typed(candidates: DataFrame) -> DataFrame:
    """Adds value_norm, value_dec and value_date by field_type."""
    return candidates.withColumns({
        "value_norm": normal_value(F.col("value_raw"), F.col("field_type")),
        "value_dec": F.when(F.col("field_type") == "decimal", parse_amount(F.col("value_raw"))),
        "value_date": F.when(F.col("field_type") == "date", parse_date(F.col("value_raw"))),
    })


def extract_body(segments: DataFrame, fields: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Candidates 'label: value' of segments (run_id, type, segment_index, text); fields: type, field, field_type, alias."""
    found = _labelled(segments, fields)
    return typed(found.select("run_id", "field", "field_type", "value_raw", body_locator(F.col("segment_index")).alias("source"), "segment_index", F.lit(confidence).cast("decimal(5,4)").alias("confidence"), F.lit("body_parser").alias("producer")))


def extract_texts(texts: DataFrame, types: DataFrame, fields: DataFrame, producer: str, confidence: float = 0.8) -> DataFrame:
    """Candidates 'label: value' of document pages (run_id, file, page_no, text); types: run_id, type."""
    found = _labelled(texts.where("error_code is null").join(types, "run_id"), fields)
    source = attachment_locator(F.col("file"), F.concat(F.lit("p"), F.col("page_no").cast("string")))
    return typed(found.select("run_id", "field", "field_type", "value_raw", source.alias("source"), F.lit(None).cast("int").alias("segment_index"), F.lit(confidence).cast("decimal(5,4)").alias("confidence"), F.lit(producer).alias("producer")))


def _labelled(texts: DataFrame, fields: DataFrame) -> DataFrame:
    """The lines 'label: value' of texts (type, text, ...) whose label means a field of the type."""
    kept = [c for c in texts.columns if c != "text"]
    lines = texts.select(*kept, F.explode(F.split("text", "\n")).alias("line"))
    pairs = lines.select(*kept, normal_label(F.regexp_extract("line", r"^\s*([^:=]{2,40})\s*[:=]", 1)).alias("label"), F.trim(F.regexp_extract("line", r"^[^:=]{2,40}[:=]\s*(.+)$", 1)).alias("value_raw")).where("label <> '' and value_raw <> ''")
    named = fields.select("type", "field", "field_type", normal_label(F.col("alias")).alias("label"))
    return pairs.join(F.broadcast(named), ["type", "label"])


def extract_rows(rows: DataFrame, types: DataFrame, fields: DataFrame, producer: str, confidence: float = 0.9) -> DataFrame:
    """Candidates of table rows (run_id, file, sheet, row_no, cells, places); types: run_id, type.

    A cell is as sure as its parser times how surely its column means the field (see scalars.mapping_confidence).
    """
    table = ["run_id", "file", "_sheet"]
    named = fields.select("type", "field", "field_type", normal_label(F.col("alias")).alias("label")).distinct()
    good = rows.where("error_code is null and cells is not null").withColumn("_sheet", F.coalesce("sheet", F.lit("")))
    # Only cells whose header means a field of any type leave their task; a row without any still counts for its table.
    label = lambda header: normal_label(plain_header(header))
    meant = F.filter(F.map_entries("cells"), lambda c: F.array_contains("_labels", label(c["key"])))
    cells = F.transform(meant, lambda c: F.struct(c["key"].alias("header"), c["value"].alias("value_raw"), F.element_at("places", c["key"]).alias("place")))
    cut = good.crossJoin(F.broadcast(named.agg(F.collect_set("label").alias("_labels")))).select(*table, "sheet", cells.alias("_cells"))
    # A run is one message, which one worker has opened: its rows are dealt by run once, and that serves both counts.
    whole = cut.join(types, "run_id").withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*table)))
    # Of a plain column, Spark would infer that it is not empty, and find the labels of all cells again for that.
    each = whole.select(*table, "type", "sheet", "_rows", F.explode(F.filter("_cells", lambda c: F.trim(c["value_raw"]) != "")).alias("_c")).select(*table, "type", "sheet", "_rows", "_c.*")
    filled = each.withColumn("_filled", F.count(F.lit(1)).over(Window.partitionBy(*table, "header")))
    found = filled.withColumn("label", label(F.col("header"))).join(F.broadcast(named), ["type", "label"])
    place = F.col("place")
    source = F.when(F.col("sheet").isNull(), attachment_locator(F.col("file"), place)).otherwise(cell_locator(F.col("file"), F.col("sheet"), place))
    sure = F.lit(confidence).cast("decimal(5,4)") * mapping_confidence(F.col("label"), F.col("label"), F.col("_filled"), F.col("_rows"))
    return typed(found.select("run_id", "field", "field_type", "value_raw", source.alias("source"), F.lit(None).cast("int").alias("segment_index"), sure.cast("decimal(5,4)").alias("confidence"), F.lit(producer).alias("producer")))


def choose_sheet(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(run_id, file, sheet, hits, reason): the sheet with most headers that mean a field; ties go to the first name.

    Where rows have a type, aliases (type, alias) count for their own type only.
    """
    typed_by = ["type"] if "type" in rows.columns and "type" in aliases.columns else []
    heads = rows.where("sheet is not null").select("run_id", "file", "sheet", *typed_by, F.explode(F.map_keys("cells")).alias("header")).distinct().withColumn("label", normal_label(plain_header(F.col("header"))))
    named = aliases.select(*typed_by, normal_label(F.col("alias")).alias("label"), F.lit(1).alias("hit")).distinct()
    per = heads.join(F.broadcast(named), [*typed_by, "label"], "left").groupBy("run_id", "file", "sheet").agg(F.count("hit").alias("hits"))
    best = per.groupBy("run_id", "file").agg(F.min(F.struct((-F.col("hits")).alias("h"), "sheet")).alias("b"))
    hits = -F.col("b.h")
    return best.select("run_id", "file", "b.sheet", hits.alias("hits"), F.concat(hits.cast("string"), F.lit(" headers mean a field")).alias("reason"))


def validate(resolved: DataFrame, fields: DataFrame) -> DataFrame:
    """(run_id, code) of resolved values (run_id, type, field, ...) that break their field's validation."""
    joined = resolved.join(F.broadcast(fields), ["type", "field"])
    other = resolved.select("run_id", F.col("field").alias("not_before"), F.col("value_date").alias("other_date"))
    joined = joined.join(other, ["run_id", "not_before"], "left")
    bad = (
        F.coalesce(F.col("min").isNotNull() & ~F.coalesce(F.col("value_dec") >= F.col("min"), F.lit(False)), F.lit(False))
        | F.coalesce(F.col("currency_required") & currency_of(F.col("value_raw")).isNull(), F.lit(False))
        | F.coalesce((F.col("format") == "iso-8601") & F.try_to_date("value_raw", "yyyy-MM-dd").isNull(), F.lit(False))
        | F.coalesce(F.col("value_date") < F.col("other_date"), F.lit(False))
        | F.coalesce(F.col("pattern").isNotNull() & ~F.regexp_like("value_raw", F.col("pattern")), F.lit(False))
    )
    return joined.where(bad).select("run_id", F.concat(F.lit("schema_validation_failed:"), "field").alias("code")).distinct()
