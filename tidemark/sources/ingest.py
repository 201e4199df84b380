"""Typed ingest: header checks, reject reports, nested JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_typed_csv(spark: SparkSession, path: str, casts: dict[str, Callable[[Column], Column]], required: set[str]) -> DataFrame:
    """Columns of `casts`, read as text and cast one by one. Header names are compared in lower case; a missing required
    column fails before any row is read, a missing optional one is null, others are ignored."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])
    if lost := sorted(required - set(raw.columns)):
        raise ValueError(f"{path} lacks the columns {', '.join(lost)}")
    return raw.select(*[cast(F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c, cast in casts.items()])


def read_text_csv(spark: SparkSession, path: str, required: set[str] = frozenset()) -> DataFrame:
    """All columns as text under lower-case names, and line, the row's place in its file (2 is the first below the header).
    A missing required column fails before any row is read. A file is taken as one split, so places hold."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    raw = raw.toDF(*[c.lstrip("\ufeff").strip().lower() for c in raw.columns])
    if lost := sorted({c.lower() for c in required} - set(raw.columns)):
        raise ValueError(f"{path} lacks the columns {', '.join(lost)}")
    return raw.withColumn("line", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 2)


def split_valid_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold to all rules, and the others with the first broken one as reject_reason. A rule that is null is broken."""
    reason = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    marked = df.withColumn("reject_reason", reason)
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def import_report(rejects: DataFrame) -> DataFrame:
    """Rejected rows by reason; none for no rejects."""
    return rejects.groupBy("reject_reason").agg(F.count("*").alias("n_rows"))


def import_summary(valid: DataFrame, rejects: DataFrame, line: str = "line", first: int = 10) -> DataFrame:
    """One row: parsed, skipped, and issues, the messages of the first rejected lines. Only those `first` rows are gathered."""
    told = rejects.orderBy(line, "reject_reason").limit(first).select(F.col(line).alias("_l"), F.concat(F.lit("line "), F.col(line).cast("string"), F.lit(": "), F.col("reject_reason")).alias("_m"))
    issues = told.agg(F.transform(F.array_sort(F.collect_list(F.struct("_l", "_m"))), lambda x: x["_m"]).alias("issues"))
    return valid.agg(F.count("*").alias("parsed")).crossJoin(rejects.agg(F.count("*").alias("skipped"))).crossJoin(issues)  # one row each


def flatten_hourly_json(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """(keys, time, temperature_c) of {"hourly": {"time": [...], "temperature_2m": [...]}}; null temperatures go."""
    parsed = F.from_json(payload, "hourly struct<time:array<string>,temperature_2m:array<double>>")
    zipped = df.select(*keys, F.explode(F.arrays_zip(parsed["hourly"]["time"].alias("time"), parsed["hourly"]["temperature_2m"].alias("temperature_c"))).alias("z"))
    return zipped.select(*keys, F.col("z.time").try_cast("timestamp_ntz").alias("time"), F.col("z.temperature_c")).where("temperature_c IS NOT NULL")


def flatten_indicator_json(countries: DataFrame, observations: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Pages of an indicator service, [{...}, [rows]], one per row of `payload`.

    Countries (country, name, region): without those of region NA, which are aggregates. Observations (country, indicator,
    year, value) of these countries; null values, years that are no number and other countries are left out; a page that
    cannot be read gives no rows.
    """
    page = lambda kind: F.from_json(F.regexp_extract(payload, r"(?s)^\s*\[\s*\{.*?\}\s*,\s*(\[.*\])\s*\]\s*$", 1), kind)
    place = countries.select(F.explode(page("array<struct<id:string,name:string,region:struct<id:string,value:string>>>")).alias("c")).select(F.col("c.id").alias("country"), F.col("c.name").alias("name"), F.col("c.region.value").alias("region"), F.col("c.region.id").alias("_r"))
    place = place.where("country IS NOT NULL AND country <> '' AND coalesce(_r, '') <> 'NA'").drop("_r").dropDuplicates(["country"])
    rows = observations.select(F.explode(page("array<struct<countryiso3code:string,date:string,value:double,indicator:struct<id:string>>>")).alias("o")).select(F.col("o.countryiso3code").alias("country"), F.col("o.indicator.id").alias("indicator"), F.col("o.date").try_cast("int").alias("year"), F.col("o.value").alias("value"))
    return place, rows.where("value IS NOT NULL AND year IS NOT NULL").join(place.select("country"), "country", "left_semi")


#: Chapters of goods that come out of the ground.
RESOURCE_CHAPTERS = ("25", "26", "27", "44", "71")


def flatten_trade_json(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Exports from the trade service's document, one per row: to partners (country, partner, value, former) and of products
    (country, product, value, resource). Numbers become country codes by the document's own list; values of zero, less or
    null and countries without a code are left out; a partner keeps its row without one, with a null code."""
    kind = "data struct<locationCountry:array<struct<countryId:string,iso3Code:string,formerCountry:boolean>>,countryCountryYear:array<struct<countryId:string,partnerCountryId:string,exportValue:double>>,productHs92:array<struct<productId:string,code:string>>,countryProductYear:array<struct<countryId:string,productId:string,exportValue:double>>>"
    doc = df.select(F.monotonically_increasing_id().alias("_d"), F.from_json(payload, kind)["data"].alias("x"))
    rows = lambda field: doc.select("_d", F.explode(f"x.{field}").alias("r")).select("_d", "r.*")
    places = rows("locationCountry").dropDuplicates(["_d", "countryId"])
    code = lambda number, name: places.select("_d", F.col("countryId").alias(number), F.col("iso3Code").alias(name))
    sold = rows("countryCountryYear").where("exportValue > 0").join(code("countryId", "country"), ["_d", "countryId"]).where("country IS NOT NULL")
    partners = sold.join(places.select("_d", F.col("countryId").alias("partnerCountryId"), F.col("iso3Code").alias("partner"), F.coalesce("formerCountry", F.lit(False)).alias("former")), ["_d", "partnerCountryId"], "left")
    goods = rows("productHs92").select("_d", "productId", F.coalesce(F.col("code").isin(*RESOURCE_CHAPTERS), F.lit(False)).alias("resource"))
    products = rows("countryProductYear").where("exportValue > 0").join(code("countryId", "country"), ["_d", "countryId"]).where("country IS NOT NULL").join(goods, ["_d", "productId"], "left")
    return partners.select("country", "partner", F.col("exportValue").alias("value"), F.coalesce("former", F.lit(False)).alias("former")), products.select("country", F.col("productId").alias("product"), F.col("exportValue").alias("value"), F.coalesce("resource", F.lit(False)).alias("resource"))


#: What a register of batteries must hold.
ASSET_FIELDS = ("slug", "name", "region", "owner", "custodian", "aemo_survey_id", "commitment_status", "is_spike_cohort")
UNIT_FIELDS = ("duid", "direction_model", "effective_from", "power_capacity_mw", "storage_capacity_mwh", "aemo_generation_info_unit_id", "unit_name", "connection_point_id", "notes")


def registry_flatten(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Registrations of a register document (one per row of df) and what is wrong with it: (slug, duid, effective_from,
    problem). A registration with a problem is left out of the first: a field missing from it or its asset, a date that is
    none, an end before the start, a capacity that is no number above zero, or a repeated slug, unit and start."""
    text = lambda names: ",".join(f"{n}:string" for n in names)
    kind = f"assets array<struct<{text(ASSET_FIELDS)},registrations:array<struct<{text(UNIT_FIELDS)},effective_to:string>>>>"
    asset = df.select(F.explode(F.from_json(payload, kind)["assets"]).alias("a"))
    rows = asset.select("a", F.explode_outer("a.registrations").alias("r")).select(*[F.col(f"a.{c}").alias(c) for c in ASSET_FIELDS], F.col("r.*"), F.col("r").isNull().alias("_none"))
    day = lambda c: F.when(F.rlike(F.col(c), F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.col(c).try_cast("date"))
    number = lambda c: F.col(c).try_cast("decimal(18,3)")
    again = F.count("*").over(Window.partitionBy("slug", "duid", "effective_from")) > 1
    problem = F.when(F.col("_none"), "no registrations")
    for c in (*ASSET_FIELDS, *UNIT_FIELDS):
        problem = problem.when(F.col(c).isNull(), f"{c} is missing")
    problem = problem.when(day("effective_from").isNull(), "effective_from is no date").when(F.col("effective_to").isNotNull() & (F.col("effective_to") != "") & day("effective_to").isNull(), "effective_to is no date").when(day("effective_to") < day("effective_from"), "effective_to is before effective_from")
    for c in ("power_capacity_mw", "storage_capacity_mwh"):
        problem = problem.when(~F.coalesce(number(c) > 0, F.lit(False)), f"{c} is no number above zero")
    marked = rows.withColumn("problem", problem.when(again, "repeated registration"))
    good = marked.where("problem IS NULL").select("slug", "name", "region", "duid", day("effective_from").alias("effective_from"), day("effective_to").alias("effective_to"), number("power_capacity_mw").alias("power_capacity_mw"), number("storage_capacity_mwh").alias("storage_capacity_mwh"))
    return good, marked.where("problem IS NOT NULL").select("slug", "duid", "effective_from", "problem")


def write_csv_exports(frames: dict[str, DataFrame], path: str, by: str = "region") -> None:
    """Each frame as CSV with a header in a folder of its name, a folder of each region below; what was there is replaced.
    The audit exports are prices, weather, features, forecasts and scores; an empty frame writes no file."""
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy(by).option("header", True).csv(f"{path}/{name}")
