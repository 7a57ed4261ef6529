"""Listing source files, dropping own outputs, normalising catalogues and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.spread import dense_index

# fixed values: file types that count as sources
EXTENSIONS = ["jpg", "jpeg", "png", "heic", "tif", "tiff"]
PRODUCER = "tessera"
DEFAULT_FOCAL_FACTOR = 0.9


def scan_files(spark: SparkSession, paths: list[str], extensions: list[str] = EXTENSIONS) -> DataFrame:
    """Catalogue of files given directly or one level below given folders, by file name.

    Only metadata is read: the content column is pruned.
    """
    pattern = r"(?i)\.(" + "|".join(extensions) + ")$"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return (found.select("path", "length", "modificationTime").filter(F.col("path").rlike(pattern))
            .withColumn("name", name).orderBy("name", "path"))


def exclude_own(catalog: DataFrame, producer: str = PRODUCER, outputs: DataFrame | None = None) -> DataFrame:
    """Leave out what this library wrote: by producer tag and, if given, by an output manifest's path."""
    kept = catalog
    if "producer" in catalog.columns:
        kept = kept.filter(F.col("producer").isNull() | (F.col("producer") != producer))
    return kept if outputs is None else kept.join(outputs.select("path").distinct(), "path", "left_anti")


def write_groups(df: DataFrame, base: str, name: str = "output", fmt: str | None = None,
                 key: str = "group_id", default_fmt: str = "parquet") -> DataFrame:
    """Write one output folder per group below ``base`` and return the manifest.

    The first group keeps ``name``; the k-th gets ``name.k``; rows without a group (NULL) are a group too, the first.  Every row
    carries the producer tag.  The format comes from ``fmt`` or the suffix of ``name``; anything unknown becomes ``default_fmt``.  Outputs of the
    same names are replaced, whatever else lies below ``base`` stays.
    """
    known = {"parquet", "orc", "json", "csv"}
    stem, _, suffix = name.rpartition(".")
    chosen = fmt or (suffix if stem and suffix in known else None)
    if chosen not in known:
        chosen = default_fmt
    if stem and suffix in known:
        name = stem
    order = dense_index(df.select(key).distinct().withColumn("_one", F.lit(1)), ["_one"], [F.col(key).asc_nulls_first()], "_k").select(key, "_k")
    label = F.when(F.col("_k") == 0, F.lit(name)).otherwise(F.concat(F.lit(name + "."), (F.col("_k") + 1).cast("string")))
    named = order.select(key, label.alias("output_name"))
    of = named.withColumnRenamed(key, "_of")
    out = df.join(of, df[key].eqNullSafe(of["_of"])).drop("_of").withColumn("producer", F.lit(PRODUCER))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(chosen).partitionBy("output_name").save(base))
    return named.withColumn("path", F.concat(F.lit(base.rstrip("/") + "/output_name="), F.col("output_name"))).withColumn(
        "producer", F.lit(PRODUCER))


def working_size(width: Column, height: Column, max_dim: int | None) -> tuple[Column, Column]:
    """Size with the longer side capped at ``max_dim``; never enlarged."""
    if max_dim is None:
        return width.cast("int"), height.cast("int")
    long = F.greatest(width, height)
    factor = F.least(F.lit(1.0), F.lit(float(max_dim)) / long)
    return tuple(F.greatest(F.lit(1), F.floor(s * factor + 0.5)).cast("int") for s in (width, height))


def normalize_catalog(meta: DataFrame, max_dim: int | None = None) -> DataFrame:
    """Signed coordinates, working size and focal length in working pixels.

    ``meta``: full_width, full_height, f35, lat, lon, lat_ref, lon_ref.  A missing hemisphere letter means N
    or E; f_px = f35 / 36 x long side; without f35 it is 0.9 x long side.
    """
    w, h = working_size(F.col("full_width"), F.col("full_height"), max_dim)
    sized = meta.withColumns({"width": w, "height": h})
    long = F.greatest("width", "height")
    return sized.withColumns({
        "lat": F.when(F.coalesce("lat_ref", F.lit("N")) == "S", -F.col("lat")).otherwise(F.col("lat")),
        "lon": F.when(F.coalesce("lon_ref", F.lit("E")) == "W", -F.col("lon")).otherwise(F.col("lon")),
        "focal": F.coalesce(F.col("f35") / 36 * long, DEFAULT_FOCAL_FACTOR * long)})
