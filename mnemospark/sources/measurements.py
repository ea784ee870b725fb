"""Readers of measurements: wide sheets of lab values, XML records of sensors, ledgers of events.

A catalog is three small tables: metrics (metric, canonical_unit, type), aliases (alias, metric), units (spelling, unit).
What can't be placed keeps its row with a ``reason`` instead of being dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import values
from mnemospark.functions.keys import any_date, number, when

# The names of a sheet's columns that aren't dates.
COLUMNS = {
    "metric": ["項目", "項目名", "metric", "item"],
    "abbreviation": ["項目略称", "略称", "abbr", "abbreviation", "abbrev"],
    "unit": ["単位", "unit"],
    "reference": ["基準値", "基準値範囲", "reference", "reference_range"],
    "low": ["基準値min", "基準値下限", "ref_min", "reference_min"],
    "high": ["基準値max", "基準値上限", "ref_max", "reference_max"],
}
# A range written as text; what a ledger's entries may say; the type of sleep records.
RANGE = r"^\s*(-?\d+(?:\.\d+)?)\s*[-−–~〜]\s*(-?\d+(?:\.\d+)?)\s*$"
KINDS = ["medication_start", "medication_stop", "dose_change", "supplement_start", "supplement_stop", "smoking_stop", "alcohol_change", "exercise_change", "illness", "procedure", "travel", "context_change"]
SOURCES, CONFIDENCES = ["self_report", "clinician", "document"], ["confirmed", "estimated", "uncertain"]
SLEEP = "HKCategoryTypeIdentifierSleepAnalysis"

RECORD = "_type string, _sourceName string, _unit string, _value string, _startDate string, _endDate string, _device string"
ENTRY = "id string, kind string, label string, start string, `end` string, dose struct<value:string, unit:string>, source string, confidence string, notes string, supersedes string, status string"


def _cell(name: str | None) -> Column:
    return F.nullif(F.trim(F.col(f"`{name}`")), F.lit("")) if name else F.lit(None).cast("string")


def normalised(rows: DataFrame, units: DataFrame, needs_unit: bool) -> DataFrame:
    """Adds value_num, value_text, unit and quality to rows with raw_value, raw_unit and canonical_unit.

    A number of a unit other than the metric's is kept as text and provisional; without a unit it counts unless
    needs_unit. units is small: one row for each spelling.
    """
    known = units.select(F.col("spelling").alias("raw_unit"), F.col("unit").alias("_unit")).dropDuplicates(["raw_unit"])
    value = number(F.col("raw_value"))
    other = ~F.col("_unit").eqNullSafe(F.col("canonical_unit")) | F.col("_unit").isNull()
    wrong = value.isNotNull() & other if needs_unit else value.isNotNull() & F.col("raw_unit").isNotNull() & other
    good = value.isNotNull() & ~wrong
    return (
        rows.join(known, "raw_unit", "left")
        .withColumn("value_num", F.when(good, value))
        .withColumn("value_text", F.when(~good, F.col("raw_value")))
        .withColumn("unit", F.when(good & F.col("raw_unit").isNotNull(), F.col("canonical_unit")))
        .withColumn("quality", F.when(wrong, "provisional").otherwise("valid"))
        .drop("_unit")
    )


def read_sheet(spark: SparkSession, path: str, metrics: DataFrame, aliases: DataFrame, units: DataFrame) -> DataFrame:
    """One row for each filled cell of a sheet whose first column names metrics and whose other columns are dates.

    A name that no alias has falls back on the abbreviation; if that is unknown too, reason is unknown_metric. Cells
    beyond the header make the reason too_many_cells. The header alone is looked at on the driver.
    """
    head = spark.read.option("header", True).csv(path)
    of: dict[str, str] = {}
    dates = []
    for name in head.columns:
        label = next((k for k, names in COLUMNS.items() if name.strip().lower() in names and k not in of), None)
        if label:
            of[label] = name
        else:
            dates.append(name)
    if not head.columns or of.get("metric") != head.columns[0]:
        raise ValueError("the first column must name the metric")
    days = spark.createDataFrame([(d,) for d in dates], "day_name string").select("day_name", any_date(F.col("day_name")).alias("observed")) if dates else None
    if days is None or days.where("observed IS NULL").count():
        raise ValueError("a column is neither a known label nor a date")
    schema = ", ".join(f"`{c}` string" for c in head.columns) + ", `_bad` string"
    raw = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_bad").csv(path).where(_cell(of["metric"]).isNotNull())
    # Short lines are malformed for the reader as well; only long ones fill the last column.
    long_line = F.col("_bad").isNotNull() & F.col(f"`{head.columns[-1]}`").isNotNull()
    text = _cell(of.get("reference"))
    low, high = number(_cell(of.get("low"))), number(_cell(of.get("high")))
    given = low.isNotNull() | high.isNotNull()
    bound = lambda i, own: F.when(given, own).otherwise(F.regexp_extract(text, RANGE, i).try_cast("double"))
    base = raw.select(_cell(of["metric"]).alias("original_metric"), _cell(of.get("abbreviation")).alias("abbreviation"), _cell(of.get("unit")).alias("raw_unit"), bound(1, low).alias("reference_low"), bound(2, high).alias("reference_high"), text.alias("reference_text"), long_line.alias("_long"), *(F.trim(F.col(f"`{d}`")).alias(d) for d in dates))
    ids = ["original_metric", "abbreviation", "raw_unit", "reference_low", "reference_high", "reference_text", "_long"]
    cells = base.unpivot(ids, dates, "day_name", "raw_value").where("raw_value <> ''").join(days, "day_name")
    full = aliases.select(F.col("alias").alias("original_metric"), F.col("metric").alias("_full")).dropDuplicates(["original_metric"])
    short = aliases.select(F.col("alias").alias("abbreviation"), F.col("metric").alias("_short")).dropDuplicates(["abbreviation"])
    named = cells.join(full, "original_metric", "left").join(short, "abbreviation", "left").withColumn("metric", F.coalesce("_full", "_short"))
    placed = named.join(metrics.select("metric", "canonical_unit"), "metric", "left")
    reason = F.when(F.col("_long"), "too_many_cells").when(F.col("metric").isNull(), "unknown_metric")
    return normalised(placed, units, needs_unit=False).select("metric", "original_metric", "observed", "raw_value", "raw_unit", "value_num", "value_text", "unit", "quality", "reference_low", "reference_high", "reference_text", reason.alias("reason"))


def _instant(text: Column) -> Column:
    return values.instant(text, ("yyyy-MM-dd HH:mm:ss Z",))


def read_records(spark: SparkSession, path: str, metrics: DataFrame, units: DataFrame, tag: str = "Record") -> DataFrame:
    """Sensor records from XML: allowed types alone, repeated records once, 1970 and unreadable dates with a reason.

    Sleep is a category; its value is the minutes between start and end. The day is the one at the record's own offset.
    """
    raw = spark.read.format("xml").option("rowTag", tag).schema(RECORD).load(path)
    start, end = F.coalesce("_startDate", F.lit("")), F.coalesce("_endDate", "_startDate", F.lit(""))
    rows = raw.select(F.col("_type").alias("type"), F.trim("_value").alias("raw_value"), F.nullif(F.trim("_unit"), F.lit("")).alias("raw_unit"), F.trim(F.coalesce("_sourceName", F.lit("unknown"))).alias("source"), F.col("_device").alias("device"), start.alias("start_text"), end.alias("end_text"))
    allowed = metrics.where("type IS NOT NULL").select("type", "metric", "canonical_unit")
    rows = rows.join(allowed, "type").where("raw_value <> '' AND start_text <> ''")
    rows = rows.withColumn("fingerprint", F.sha2(F.concat_ws("|", "type", "source", "start_text", "end_text", "raw_value", F.coalesce("raw_unit", F.lit(""))), 256)).dropDuplicates(["fingerprint"])
    rows = rows.withColumn("started", _instant(F.col("start_text"))).withColumn("ended", _instant(F.col("end_text"))).withColumn("observed", F.when(F.col("started").isNotNull(), F.try_to_date(F.left("start_text", F.lit(10)), "yyyy-MM-dd")))
    sleep, minutes = F.col("type") == SLEEP, values.minutes_between("started", "ended")
    found = normalised(rows, units, needs_unit=True)
    return found.select(
        "metric", "type", "raw_value", "raw_unit", "source", "device", "started", "ended", "observed", "fingerprint",
        F.when(sleep, minutes).otherwise(F.col("value_num")).alias("value_num"), F.when(sleep, F.col("raw_value")).otherwise(F.col("value_text")).alias("value_text"),
        F.when(sleep, F.when(minutes.isNotNull(), "min")).otherwise(F.col("unit")).alias("unit"), F.when(sleep, F.when(minutes.isNotNull(), "valid").otherwise("provisional")).otherwise(F.col("quality")).alias("quality"),
        F.when(~sleep & (F.col("started") == F.col("ended")), "instant").otherwise("interval").alias("precision"),
        F.when(F.col("started").isNull() | (F.year("observed") <= 1970), "sentinel_date").alias("reason"),
    )


def ignored_types(spark: SparkSession, path: str, metrics: DataFrame, tag: str = "Record") -> DataFrame:
    """How many records of each type no metric asks for; only the types are read."""
    raw = spark.read.format("xml").option("rowTag", tag).schema("_type string").load(path).select(F.coalesce("_type", F.lit("")).alias("type"))
    return raw.join(metrics.where("type IS NOT NULL").select("type"), "type", "left_anti").groupBy("type").agg(F.count("*").alias("n"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a ledger in JSON lines, with uncertain dates as intervals and what is wrong with each."""
    raw = spark.read.schema(ENTRY).json(path).withColumn("source", F.coalesce("source", F.lit("self_report"))).withColumn("confidence", F.coalesce("confidence", F.lit("uncertain")))
    rows = raw.withColumn("_s", when(F.col("start"))).withColumn("_e", when(F.col("end")))
    wrong = {
        "no_id": F.coalesce(F.trim("id"), F.lit("")) == "",
        "kind": ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)),
        "source": ~F.col("source").isin(SOURCES),
        "confidence": ~F.col("confidence").isin(CONFIDENCES),
        "dose": F.col("dose").isNotNull() & (F.col("dose.value").try_cast("double").isNull() | F.col("dose.unit").isNull()),
        "start": F.col("_s.raw").isNotNull() & F.col("_s.earliest").isNull(),
        "end": F.col("_e.raw").isNotNull() & F.col("_e.earliest").isNull(),
    }
    violations = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in wrong.items())))
    digest = F.sha2(F.to_json(F.struct(*raw.columns)), 256)
    return rows.select("id", "kind", "label", "source", "confidence", "dose", "supersedes", "status", F.col("_s.earliest").alias("start_earliest"), F.col("_s.latest").alias("start_latest"), F.col("_s.precision").alias("start_precision"), F.col("_e.earliest").alias("end_earliest"), F.col("_e.latest").alias("end_latest"), digest.alias("entry_hash"), violations.alias("violations"))


def append_plan(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """id, action of each entry: append or skip, or why the whole batch must not be written.

    A stored id with another content, an id twice in the batch, a superseded entry that is nowhere, and any violation
    reject; the caller writes only if no action but append and skip is there.
    """
    known = stored.select("id", F.col("entry_hash").alias("old_hash"))
    twice = entries.groupBy("id").agg(F.count("*").alias("n"))
    targets = stored.select("id").unionAll(entries.select("id")).distinct().select(F.col("id").alias("supersedes"), F.lit(True).alias("_there"))
    rows = entries.join(known, "id", "left").join(twice, "id", "left").join(targets, "supersedes", "left")
    action = F.when(F.size("violations") > 0, "invalid").when(F.col("n") > 1, "repeated").when(F.col("old_hash") == F.col("entry_hash"), "skip").when(F.col("old_hash").isNotNull(), "changed").when(F.col("supersedes").isNotNull() & F.col("_there").isNull(), "no_target").otherwise("append")
    return rows.select("id", action.alias("action"))
