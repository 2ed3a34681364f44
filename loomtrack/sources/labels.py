"""Label lines: writing, parsing and checking them, and reading observation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
OBSERVATION = T.StructType(
    [
        T.StructField("class_name", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("bbox", T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])),
        T.StructField("mask", T.ArrayType(POINT)),
    ]
)
FRAMES = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("stream_epoch", T.IntegerType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("timestamp_global", T.DoubleType()),
        T.StructField("observations", T.ArrayType(OBSERVATION)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_observations(spark, path: str) -> DataFrame:
    """Frames from JSON lines (IO1): blank lines are ignored, broken ones keep ``_corrupt_record``."""
    return spark.read.schema(FRAMES).option("mode", "PERMISSIVE").json(path)


def observation_stream(spark, path: str, late: str = "30 seconds") -> DataFrame:
    """The same as a stream with an event time and its watermark (SS1)."""
    return spark.readStream.schema(FRAMES).json(path).withColumn("event_time", F.timestamp_micros((F.col("timestamp_global") * 1_000_000).cast("long"))).withWatermark("event_time", late)


def explode_detections(frames: DataFrame) -> DataFrame:
    """One row per detection with its frame's keys and ``obs_index`` (IO2). Frames without any give none."""
    keys = [c for c in frames.columns if c not in ("observations", "_corrupt_record")]
    return frames.select(*keys, F.posexplode("observations").alias("obs_index", "o")).select(*keys, "obs_index", "o.class_name", "o.confidence", "o.track_id", *(F.col(f"o.bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")), F.col("o.mask").alias("mask"))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns, lists kept (IO3)."""

    def columns(schema: T.StructType, path: str) -> list[Column]:
        out = []
        for f in schema.fields:
            name = f"{path}{f.name}"
            if isinstance(f.dataType, T.StructType):
                out += columns(f.dataType, f"{name}.")
            else:
                out.append(F.col(".".join(f"`{p}`" for p in name.split("."))).alias(name))
        return out

    return df.select(*columns(df.schema, ""))


def export_observations(df: DataFrame, path: str) -> None:
    """Flattened Parquet, partitioned by session and source (IO3)."""
    flatten(df).write.mode("overwrite").partitionBy("session_id", "source_id").parquet(path)


def observation_summary(frames: DataFrame) -> DataFrame:
    """(session_id, frames, observations): AG12."""
    return frames.groupBy("session_id").agg(F.count("*").alias("frames"), F.sum(F.coalesce(F.size("observations"), F.lit(0)).cast("long")).alias("observations"))


def file_digests(spark, path: str) -> DataFrame:
    """(path, digest): SHA-256 of each file (IO15)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"))


def yolo_label_lines(dets: DataFrame, classes: list[str], width: float = 640.0, height: float = 360.0) -> DataFrame:
    """Adds ``line``: class, centre and size over the image, six decimals (IO7, detection). Unknown classes are dropped."""
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("class_name")) - 1
    six = lambda v: F.format_string("%.6f", v)
    box = ((F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height, (F.col("x2") - F.col("x1")) / width, (F.col("y2") - F.col("y1")) / height)
    return dets.withColumn("__class", number).where("__class >= 0").withColumn("line", F.concat_ws(" ", F.col("__class").cast("string"), *map(six, box))).drop("__class")


def parse_yolo_labels(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``class_id`` and ``numbers`` (null where a part is no number): IO8."""
    parts = F.split(F.trim(line), r"\s+")
    return lines.withColumns({"class_id": F.try_element_at(parts, F.lit(1)).try_cast("int"), "numbers": F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.try_cast("double"))})


def validate_labels(parsed: DataFrame, classes: int) -> DataFrame:
    """Adds ``errors`` of detection and polygon lines, in rule order (DQ11)."""
    n = F.size("numbers")
    bad_number = F.exists("numbers", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    at = lambda k: F.get("numbers", F.lit(k))
    rules = (
        ("CLASS", F.col("class_id").isNull() | (F.col("class_id") < 0) | (F.col("class_id") >= classes)),
        ("NUMBER", bad_number),
        ("COUNT", (n < 4) | ((n > 4) & ((n < 6) | (n % 2 == 1)))),
        ("RANGE", F.exists("numbers", lambda x: (x < 0) | (x > 1))),
        ("BOX", (n == 4) & ((at(2) <= 0) | (at(3) <= 0) | (at(0) - at(2) / 2 < -1e-6) | (at(0) + at(2) / 2 > 1 + 1e-6) | (at(1) - at(3) / 2 < -1e-6) | (at(1) + at(3) / 2 > 1 + 1e-6))),
        ("AREA", (n >= 6) & (n % 2 == 0) & (F.abs(polygon_area("numbers")) < 1e-12)),
    )
    return parsed.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules))))


def polygon_area(numbers: str) -> Column:
    """Twice the signed area of a polygon given as x, y, x, y, ..."""
    n = F.size(numbers)
    steps = F.sequence(F.lit(0), F.greatest(F.floor(n / 2).cast("int") - 1, F.lit(0)))

    def term(k: Column) -> Column:
        i, j = 2 * k, (2 * k + 2) % F.greatest(n, F.lit(1))
        at = lambda p: F.get(numbers, p.cast("int"))
        return at(i) * at(j + 1) - at(j) * at(i + 1)

    return F.aggregate(F.transform(steps, term), F.lit(0.0), lambda s, x: s + x)
