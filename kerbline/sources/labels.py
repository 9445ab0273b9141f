"""Label files and run artefacts, read and written: YOLO, COCO, VOC, run-length masks, metrics, exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of label files (cls cx cy w h by line): (file, stem, class_id, cx, cy, w, h, ok); malformed lines have ok false."""
    line = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("p"), F.col("value")).where(F.length(F.trim("value")) > 0)
    n = [F.get("p", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("class_id", "cx", "cy", "w", "h"))]
    out = line.select("file", F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1).alias("stem"), F.size("p").alias("fields"), *n)
    good = (F.col("fields") == 5) & F.col("class_id").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    return out.withColumn("ok", good).withColumn("class_id", F.col("class_id").cast("int")).drop("fields")


def yolo_to_coco(boxes: DataFrame, sizes: DataFrame, class_map: dict[int, int]) -> DataFrame:
    """Pixel boxes (stem, category_id, x, y, width, height, area): unmapped classes and unknown images are skipped, corners stay inside."""
    of = F.element_at(F.create_map(*(F.lit(v) for kv in class_map.items() for v in kv)), F.col("class_id"))
    b = boxes.where("ok").withColumn("category_id", of).where("category_id is not null").join(sizes, "stem")
    w, h = F.col("w") * F.col("width"), F.col("h") * F.col("height")
    x, y = F.greatest(F.lit(0.0), F.col("cx") * F.col("width") - w / 2), F.greatest(F.lit(0.0), F.col("cy") * F.col("height") - h / 2)
    return b.select("stem", "category_id", x.alias("x"), y.alias("y"), w.alias("box_width"), h.alias("box_height"), (w * h).alias("area"))


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """(stem, label): the text of each image's label file, six decimals, values held to 0..1, in the order of class and place."""

    def held(c: str) -> Column:
        return F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))

    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("class_id").cast("int"), held("cx"), held("cy"), held("w"), held("h"))
    return boxes.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("label"))


def read_voc(spark: SparkSession, path: str, classes: dict[str, int]) -> DataFrame:
    """Boxes of VOC files: (file, filename, category_id, x, y, w, h); unknown names and empty boxes are skipped."""
    box = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
    raw = spark.read.format("xml").option("rowTag", "annotation").schema(f"filename string, object array<struct<name: string, bndbox: {box}>>").load(path)
    o = raw.select(F.input_file_name().alias("file"), "filename", F.explode("object").alias("o"))
    of = F.element_at(F.create_map(*(F.lit(v) for kv in classes.items() for v in kv)), F.col("o.name"))
    b = F.col("o.bndbox")
    out = o.select("file", "filename", of.alias("category_id"), b["xmin"].alias("x"), b["ymin"].alias("y"), (b["xmax"] - b["xmin"]).alias("w"), (b["ymax"] - b["ymin"]).alias("h"))
    return out.where("category_id is not null and w > 0 and h > 0")


def read_seg_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Bounding box of each run-length mask (label row first last): no raster is made. Runs of label 0 are background."""
    p = F.split(F.trim("value"), r"\s+")
    runs = spark.read.text(path).select(F.input_file_name().alias("file"), *(F.get(p, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(("label", "row", "first", "last"))))
    runs = runs.where("label > 0 and last is not null")
    return runs.groupBy("file").agg(F.min("first").alias("x0"), F.min("row").alias("y0"), F.max("last").alias("x1"), F.max("row").alias("y1"), F.sum(F.col("last") - F.col("first") + 1).alias("pixels"))


def pairs(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images (root, stem, path) with their label file (root, stem, label_path), or null."""
    return images.join(labels, ["root", "stem"], "left")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """run.json files below a folder with their sibling metrics; missing files give nulls."""

    def read(name: str, schema: str) -> DataFrame:
        text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
        return text.select(F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]*$", 1).alias("dir"), F.from_json("value", schema).alias(name.split(".")[0]))

    runs = read("run.json", "experiment string, seed int, status string, git_dirty boolean")
    tests = read("test_metrics.json", "map<string, double>")
    return runs.join(tests, "dir", "left").select("dir", "run.*", F.col("test_metrics").alias("metrics"))


def read_run_artefacts(spark: SparkSession, root: str) -> DataFrame:
    """Runs below a folder, a row for each run.json: (dir, experiment, seed, git_sha, git_dirty, status, metrics, per_class, per_class_split).

    Files beside it may be missing or broken: metrics of the splits val and test come from test_metrics.json, else from the run's own results;
    precisions of classes from per_class_ap.json, else there are none, of the split `unknown`. An experiment without a name has that
    of its folder; commits are cut to 8 letters.
    """
    splits = "map<string, map<string, double>>"

    def read(name: str, schema: str) -> DataFrame:
        text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
        return text.select(F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]*$", 1).alias("dir"), F.from_json("value", schema).alias("j"))

    runs = read("run.json", f"experiment string, seed int, git_sha string, git_dirty boolean, status string, results {splits}").select("dir", F.col("j").alias("run"))
    tests = read("test_metrics.json", splits).select("dir", F.col("j").alias("test"))
    classes = read("per_class_ap.json", "per_class_AP50 map<string, double>, split string").select("dir", F.col("j").alias("ap"))

    def of(m: Column) -> Column:
        kept = F.map_filter(m, lambda k, _: k.isin("val", "test"))
        return F.when(F.size(kept) > 0, kept)

    out = runs.where("run is not null").join(tests, "dir", "left").join(classes, "dir", "left")
    return out.select(
        "dir", F.coalesce(F.nullif("run.experiment", F.lit("")), F.regexp_extract("dir", r"([^/]*)$", 1)).alias("experiment"), "run.seed", F.nullif(F.substring("run.git_sha", 1, 8), F.lit("")).alias("git_sha"),
        F.coalesce("run.git_dirty", F.lit(False)).alias("git_dirty"), F.coalesce("run.status", F.lit("unknown")).alias("status"), F.coalesce(of(F.col("test")), of(F.col("run.results"))).alias("metrics"),
        F.coalesce("ap.per_class_AP50", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).alias("per_class"), F.coalesce("ap.split", F.lit("unknown")).alias("per_class_split"),
    )


def read_metrics(spark: SparkSession, path: str, key: str = "epoch") -> DataFrame:
    """Ragged metrics tables as (file, key, metric, value): blanks are dropped, not filled."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in raw.columns if c != key))
    return raw.select(F.input_file_name().alias("file"), F.col(f"`{key}`").try_cast("int").alias(key), F.explode(cells).alias("m")).select("file", key, "m.*").where("value is not null")


def write_csv(df: DataFrame, path: str, decimals: dict[str, int]) -> None:
    """An export with a header, columns rounded as given, nulls empty."""
    df.select(*(F.round(c, decimals[c]).alias(c) if c in decimals else F.col(c) for c in df.columns)).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def geojson(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One feature a row, as JSON text in column `feature`; the rows of a collection, written one to a line."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))).alias("feature"))


def materialised(splits: DataFrame) -> DataFrame:
    """(split, image) with a file name for each repeat: name, name__dup1, name__dup2."""
    again = F.row_number().over(Window.partitionBy("split", "image").orderBy("image")) - 1
    return splits.select("split", "image", F.when(again > 0, F.concat("image", F.lit("__dup"), again.cast("string"))).otherwise(F.col("image")).alias("name"))


def stage_documents(frames: DataFrame, run: str, stats: dict[str, Column]) -> DataFrame:
    """(run, document): for each run a JSON text of its statistics and of all its frames, in their order; written one to a line."""
    rest = [c for c in frames.columns if c != run]
    by = frames.groupBy(run).agg(F.struct(*(x.alias(n) for n, x in stats.items())).alias("stats"), F.array_sort(F.collect_list(F.struct(*rest))).alias("frames"))
    return by.select(run, F.to_json(F.struct("stats", "frames")).alias("document"))


def last_rows(metrics: DataFrame, run: str, epoch: str) -> DataFrame:
    """The row of each run's last epoch."""
    rest = [c for c in metrics.columns if c not in (run, epoch)]
    return metrics.groupBy(run).agg(F.max(F.struct(epoch, *rest)).alias("last")).select(run, "last.*")


def class_histogram(boxes: DataFrame, most: int = 3000) -> DataFrame:
    """(folder, class_id, n) over the boxes (folder, file, class_id) of the first `most` files of each folder by name: a look at a dataset."""
    files = boxes.select("folder", "file").distinct()
    first = files.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy("file"))).where(F.col("r") <= most).drop("r")
    return boxes.join(first, ["folder", "file"]).groupBy("folder", "class_id").agg(F.count("*").alias("n"))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Adds rows to a metric log; the first call fixes the columns and their order, later ones are brought to it, and new columns are refused."""
    spark = rows.sparkSession
    try:
        columns = spark.read.option("header", True).csv(path).columns
    except AnalysisException:
        columns = rows.columns
    if more := set(rows.columns) - set(columns):
        raise ValueError(f"the log has no columns {sorted(more)}")
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("append").option("header", True).csv(path)


def canonical(names: Column, codes: dict[str, str]) -> Column:
    """A list of class names with their codes translated, if every one is a code or a name that is known; else as it is."""
    known = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    told = F.transform(names, lambda n: F.coalesce(F.try_element_at(known, F.upper(n)), F.when(F.lower(n).isin(*codes.values()), F.lower(n))))
    return F.when(F.forall(told, lambda n: n.isNotNull()), told).otherwise(names)
