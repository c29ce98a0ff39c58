"""Files: listings, annotation documents, acoustic hits, state tables, models, images."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import batched, count

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.scratch import Scratch

# File name endings of images.
IMAGE_SUFFIXES = (".bmp", ".jpg", ".jpeg", ".png", ".tif", ".tiff")

ANNOTATION = "imageWidth int, imageHeight int, imagePath string, shapes array<struct<label: string, points: array<array<double>>>>"
STATE_SUMMARY = "state_label string, state_voltage double, image_frames bigint, vapor_area_fraction_mean double, vapor_area_fraction_std double, active_length_fraction_mean double, vapor_front_x_px_mean double, thermal_rows bigint, time_start_s double, time_end_s double, voltage_mean_v double, power_mean_w double, heat_flux_mean_w_cm2 double, inlet_subcooling_mean_c double, pressure_drop_mean_kpa double, htc_mean_w_m2k double, quality_x7_mean double, ae_hits double, ae_hit_rate_hz double, ae_abs_energy_rate double, ae_amp_mean_db double, ae_ch1_hit_rate_hz double, ae_ch2_hit_rate_hz double"
FRAME_METRICS = "state_label string, state_voltage double, frame_name string, vapor_area_fraction double, active_length_fraction double, vapor_front_x_px double"
MODEL = "feature_names array<string>, foreground_mean array<double>, foreground_std array<double>, background_mean array<double>, background_std array<double>, foreground_prior double, threshold double, roi array<int>, min_area_px int, clear_top_px int"


def path_order(path: str = "path") -> Column:
    """The order of paths by their components."""
    return F.split(path, "/")


def plain_path(uri: Column) -> Column:
    """A path as listed: without the scheme of local files and without escapes."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


#: What tasks list by themselves; other file systems are listed by Spark's own client, on the driver.
LISTED_BY_TASKS = ("file", "hdfs", "s3", "gs")


def _listed_by_tasks(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a root: a level of folders at a time, dealt over tasks, of which each lists its own."""
    scratch = Scratch(spark, "listing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                head = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
                for few in batched(system.get_file_info(fs.FileSelector(at)), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array([head + i.path for i in few]), pa.array([i.type == fs.FileType.Directory for i in few])], ["path", "folder"])

    frontier, found = spark.createDataFrame([(root,)], "path string"), []
    for level in count():
        seen = scratch.table(frontier.mapInArrow(run, "path string, folder boolean"), f"level-{level}")
        found.append(seen.where("not folder").select("path"))
        frontier = seen.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism)
        if frontier.isEmpty():
            return reduce(DataFrame.unionAll, found)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a root: of local files without a scheme."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = files.makeQualified(top).toUri()
    if whole.getScheme() in LISTED_BY_TASKS:
        return _listed_by_tasks(spark, whole.getPath() if whole.getScheme() == "file" else whole.toString())
    names, it = [], files.listFiles(top, True)
    while it.hasNext():
        names.append((it.next().getPath().toString(),))
    return spark.createDataFrame(names, "path string")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, name) of images below a root, empty files included, in the order of paths."""
    listed = _listed(spark, root).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return listed.where(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*IMAGE_SUFFIXES)).orderBy(path_order())


def list_annotations(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path) of JSON documents below each root, repeated for overlapping roots."""
    return reduce(DataFrame.unionAll, [_listed(spark, root) for root in roots]).where(F.col("path").endswith(".json")).orderBy(path_order())


def read_annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Annotation documents with json_path and image_path: imagePath, or the document's own stem with .bmp, beside the document."""
    docs = spark.read.schema(ANNOTATION).json(paths, multiLine=True).withColumn("json_path", plain_path(F.col("_metadata.file_path")))
    parent = F.regexp_replace("json_path", r"[^/]+$", "")
    stem = F.regexp_extract("json_path", r"([^/]+)\.[^./]+$", 1)
    return docs.withColumn("image_path", F.concat(parent, F.coalesce("imagePath", F.concat(stem, F.lit(".bmp")))))


def in_file_order(scan: DataFrame, name: str = "row_idx") -> DataFrame:
    """The rows of a scan of files with ``name``, their place from 0: by path, then as they stand in the file.

    A file is read in splits, in any order and by any task. Rows are written once with the start of their split and a
    number that rises within it; prefix sums of the splits' sizes (a row a split) then give each row its place.
    """
    scratch = Scratch(scan.sparkSession, "file-order")
    seen = scan.select(*[F.col(f"`{c}`") for c in scan.columns if c not in ("_metadata", name)], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    written = scratch.table(seen, "rows")
    splits = written.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    # A row a file.
    before = files.select("_file", F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    offsets = splits.select("_file", "_start", "_first", F.coalesce(earlier, F.lit(0)).alias("_earlier")).join(before, "_file")
    place = F.coalesce("_before", F.lit(0)) + F.col("_earlier") + F.col("_at") - F.col("_first")
    return written.join(offsets, ["_file", "_start"]).withColumn(name, place).drop("_file", "_start", "_first", "_earlier", "_before", "_at")


def read_log(spark: SparkSession, path: str, order: str = "row_idx") -> DataFrame:
    """A log as CSV with a header, its rows numbered in their order; a column of that name in the file is replaced."""
    return in_file_order(spark.read.csv(path, header=True, inferSchema=True), order)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Acoustic hits of a text file: ch, time_s, amp, abs_energy and every named column as text.

    The header is the first line that starts with ID and holds SSSS; SIG STRENGTH is one name. Lines above it, whatever
    they hold, and lines with fewer values are left out. The text is latin-1.
    """
    lines = in_file_order(spark.read.csv(path, encoding="ISO-8859-1", sep="\u0001", quote="", schema="line string", mode="PERMISSIVE"))
    header = lines.where(F.ltrim("line").startswith("ID") & F.contains("line", F.lit("SSSS"))).orderBy("row_idx").limit(1).head()
    if header is None:
        raise ValueError(f"{path} has no header line")
    names: list[str] = []
    for name in header.line.split():
        if names and names[-1] == "SIG" and name == "STRENGTH":
            names[-1] = "SIG-STRENGTH"
        else:
            names.append(name)
    values = F.split(F.btrim("line"), r"\s+")
    rows = lines.where(F.col("row_idx") > header.row_idx).select(values.alias("v")).where(F.size("v") >= len(names))
    rows = rows.select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    number = lambda n: F.col(f"`{n}`").try_cast("double") if n in names else F.lit(None).cast("double")
    return rows.withColumns({"ch": number("CH").cast("int"), "time_s": number("SSSSSSSS.mmmuuun"), "amp": number("AMP"), "abs_energy": number("ABS-ENERGY")})


def read_summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """State tables of cases as CSV, with file_name; ae_hits is a nullable long."""
    table = spark.read.schema(STATE_SUMMARY).csv(paths, header=True).withColumn("file_name", F.col("_metadata.file_name"))
    return table.withColumn("ae_hits", F.col("ae_hits").cast("long"))


def read_frame_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(FRAME_METRICS).csv(paths, header=True)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A model as one row; clear_top_px is 6 where it isn't given."""
    return spark.read.schema(MODEL).json(path, multiLine=True).withColumn("clear_top_px", F.coalesce("clear_top_px", F.lit(6)))


def literal_path(path: str) -> str:
    """A path that a reader takes as it stands, though it holds signs of a pattern."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", path)


def read_images(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """path, height, width, channels and bytes (BGR) of images below a folder, or of the files listed; a file that can't be decoded raises."""
    image = F.col("image")
    reader = spark.read.format("image")
    found = reader.option("recursiveFileLookup", True).load(root) if isinstance(root, str) else reader.load([literal_path(p) for p in root])
    ok = F.when(image["mode"] >= 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an image: "), image["origin"])).cast("boolean"))
    return found.where(ok).select(plain_path(image["origin"]).alias("path"), image["height"].alias("height"), image["width"].alias("width"), image["nChannels"].alias("channels"), image["data"].alias("data"))


def state_folder(root: str, path: str = "path") -> Column:
    """The folder directly below a root that holds a path, at any depth; null for files of the root itself."""
    scheme = r"^(?:file:/+(?=/)|[A-Za-z][A-Za-z0-9+.-]*://[^/]*)"
    top = re.sub(scheme, "", root).rstrip("/")
    parts = F.split(F.substring(F.regexp_replace(path, scheme, ""), len(top) + 2, 1 << 30), "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))


def states_of(images: DataFrame) -> DataFrame:
    """(state_label, state_voltage) of the folders that hold images, by voltage; labels without a number go."""
    from quillon.functions.scalar import parse_voltage

    label = F.element_at(F.split("path", "/"), -2)
    return images.select(label.alias("state_label")).distinct().withColumn("state_voltage", parse_voltage(F.col("state_label"))).where("state_voltage is not null").orderBy("state_voltage", "state_label")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header: for state tables, which are small."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(F.col(column).cast(T.StringType())).coalesce(1).write.mode("overwrite").text(path)


def write_model(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.mode("overwrite").json(path)
