"""File indexes, download manifests, scene lists and the processing ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# name patterns (fixed values)
MOSAIC_DATE = r"(\d{8})_mosaic"
SWATH_DATE = r"OL_1_EFR____(\d{8})T\d{6}"


def index_files(names: DataFrame, kind: str, col: str = "name") -> DataFrame:
    """Date (and, for the model, product, hour, cycle, format) read off file names; names that
    do not fit have a null date. `kind` is mosaic, swath or model."""
    name = F.col(col)
    if kind in ("mosaic", "swath"):
        token = F.regexp_extract(name, MOSAIC_DATE if kind == "mosaic" else SWATH_DATE, 1)
        return names.withColumn("date_str", F.when(token != "", token))
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), r"\.")
    at = lambda i: F.get(parts, F.lit(i))
    is_date = lambda c: F.coalesce(c.rlike(r"^\d{8}$"), F.lit(False))
    first = (F.size(parts) >= 6) & (at(0) == "nos") & (at(1) == "gomofs") & is_date(at(4))
    second = (F.size(parts) >= 5) & (at(0) == "gomofs") & is_date(at(2))
    pick = lambda a, b: F.when(first, a).when(second, b)
    return names.withColumns(
        {
            "date_str": pick(at(4), at(2)),
            "product": pick(at(2), at(3)),
            "fhour": pick(at(3), at(4)),
            "cycle": pick(at(5), at(1)),
            "format": pick(F.lit("A"), F.lit("B")),
        }
    )


def unrecognised(files: DataFrame, dates: list[str]) -> DataFrame:
    """How many files there are and how many fit none of the patterns behind the `dates` columns."""
    known = F.coalesce(*[F.col(c) for c in dates]).isNotNull()
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~known).alias("n_unrecognised"))


def one_file_per_date(index: DataFrame, keep: str = "last", col: str = "name") -> DataFrame:
    """One name per date, the last in name order; `keep="all"` lists them all in order."""
    known = index.where(F.col("date_str").isNotNull())
    picked = F.max(col) if keep == "last" else F.sort_array(F.collect_set(col))
    return known.groupBy("date_str").agg(picked.alias(col))


def acquisition_manifest(
    days: DataFrame,
    cycles: list[str],
    products: list[str],
    hours: list[str],
    station_types: list[str],
    base_url: str,
    day: str = "day",
) -> DataFrame:
    """File name and URL per day, cycle and product; gridded products once per forecast hour,
    station files once per station type. The lists are literals, so this only explodes."""
    variants = []
    for product in products:
        for detail in station_types if product == "stations" else hours:
            for cycle in cycles:
                variants.append(F.struct(F.lit(product).alias("product"), F.lit(detail).alias("detail"), F.lit(cycle).alias("cycle")))
    file_name = F.concat_ws(".", F.lit("nos.gomofs"), "product", "detail", F.date_format(day, "yyyyMMdd"), "cycle", F.lit("nc"))
    return (
        days.select(day, F.explode(F.array(*variants)).alias("_v"))
        .select(day, "_v.*")
        .withColumn("file_name", file_name)
        .withColumn("url", F.concat(F.lit(base_url), F.date_format(day, "yyyy/MM/"), "file_name"))
    )


def model_urls(observations: DataFrame, base_url: str, cycle: str = "t12z", hour: str = "n001", day: str = "obs_date") -> DataFrame:
    """One model file URL per distinct observation day, in the newer naming."""
    name = F.concat_ws(".", F.lit("gomofs"), F.lit(cycle), F.date_format(day, "yyyyMMdd"), F.lit("2ds"), F.lit(hour), F.lit("nc"))
    return observations.select(day).distinct().withColumn("url", F.concat(F.lit(base_url), F.date_format(day, "yyyy/MM/"), name))


def scene_stem(line: Column) -> Column:
    """Bare scene id of a path: last path part without .zip and .SEN3."""
    base = F.regexp_extract(F.trim(line), r"([^/]*)/*$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\.zip$", ""), r"\.SEN3$", "")


def short_scene_id(scene: Column) -> Column:
    """Prefix up to the first 15-character timestamp token; the whole id if there is none."""
    tokens = F.split(scene, "_")
    stamp = F.filter(tokens, lambda t: (F.length(t) == 15) & t.rlike(r"^\d") & t.contains("T"))
    until = F.array_position(tokens, F.try_element_at(stamp, F.lit(1)))
    return F.when(F.size(stamp) > 0, F.concat_ws("_", F.slice(tokens, F.lit(1), until.cast("int")))).otherwise(scene)


def normalize_scene_list(lines: DataFrame, col: str = "line") -> DataFrame:
    """Distinct scene ids of a text list, blanks and comments dropped, with their short id,
    satellite and sensing time."""
    text = F.trim(F.col(col))
    scenes = lines.where((text != "") & ~text.startswith("#")).select(scene_stem(text).alias("scene")).distinct()
    tokens = F.split("scene", "_")
    return scenes.withColumns(
        {
            "short_id": short_scene_id(F.col("scene")),
            "satellite": F.get(tokens, F.lit(0)),
            "sensing_time": F.get(tokens, F.lit(7)),
        }
    )


def pending_work(everything: DataFrame, wanted: DataFrame, done: DataFrame, col: str = "scene") -> DataFrame:
    """Scenes on the wanted list that are not done, under their full or their short id."""
    finished = done.select(F.col(col).alias("_done")).distinct()
    listed = everything.join(wanted.select(col).distinct(), col, "left_semi")
    return listed.join(finished, F.col(col) == F.col("_done"), "left_anti").join(
        finished, short_scene_id(F.col(col)) == F.col("_done"), "left_anti"
    )


def catalog_search(
    catalog: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str, limit: int | None = None
) -> DataFrame:
    """Full-resolution scenes that meet the box and the dates, by start time; the first `limit` of them if given."""
    west, south, east, north = bbox
    found = (
        catalog.where(F.col("name").contains("OL_1_EFR"))
        .where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
        .where(F.col("start_time").between(F.lit(start).cast("timestamp"), F.lit(f"{end} 23:59:59.999").cast("timestamp")))
        .orderBy("start_time", "name")
    )
    return found if limit is None else found.limit(limit)


def scene_status(df: DataFrame) -> DataFrame:
    """Ledger status from `output_exists`, `found`, `usable`, `processed`."""
    status = (
        F.when(F.col("output_exists"), "skipped_exists")
        .when(~F.col("found"), "failed")
        .when(~F.col("usable"), "skipped_cloud")
        .when(F.col("processed"), "success")
        .otherwise("failed_gpt")
    )
    return df.withColumn("status", status)


def scene_ledger_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n_scenes"))
