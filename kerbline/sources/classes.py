"""Class lists as data sets declare them: a map, a list or an inline list under `names` of a settings file, or a file with a name a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Files with a name a line, the first that is there counts.
NAME_FILES = ("classes.txt", "obj.names", "classes.names")

_STATE = "struct<phase: int, names: array<string>, held: array<struct<k: long, i: int, v: string>>>"
_BEFORE, _IN, _DONE = 0, 1, 2


def _bare(text: Column) -> Column:
    """Without blanks, then without quotes at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "^['\"]+|['\"]+$", "")


def declared_names(text: Column) -> Column:
    """Classes under `names`, or null: a fold over lines. An inline list ends the search; a map wins over a list, in the order of its keys, the
    last value of a key counts; the block ends at the first line that is none of its own, comments and blank lines apart."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x, i: F.struct(F.regexp_replace(x, r"^\s+|\s+$", "").alias("s"), i.alias("i")))
    start = F.struct(F.lit(_BEFORE).alias("phase"), F.array().cast("array<string>").alias("names"), F.array().cast("array<struct<k: long, i: int, v: string>>").alias("held")).cast(_STATE)

    def state(a: Column, phase: int | Column, names: Column | None = None, held: Column | None = None) -> Column:
        return F.struct((F.lit(phase) if isinstance(phase, int) else phase).alias("phase"), (a.names if names is None else names).alias("names"), (a.held if held is None else held).alias("held")).cast(_STATE)

    def step(a: Column, line: Column) -> Column:
        s = line.s
        inner = F.regexp_extract(s, r"^[^\[]*\[(.*?)(\][^\]]*)?$", 1)
        inline = F.filter(F.transform(F.split(inner, ","), _bare), lambda x: x != "")
        item = F.concat(a.names, F.array(_bare(F.substring(s, 3, 1 << 30))))
        key = F.regexp_extract(s, r"^(\d+)\s*:", 1).try_cast("long")
        pair = F.struct(key.alias("k"), line.i.alias("i"), _bare(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)).alias("v"))
        head = F.when(s.contains("["), state(a, _DONE, inline)).otherwise(state(a, _IN))
        block = (
            F.when(s.startswith("- "), state(a, _IN, item)).when(s.rlike(r"^\d[^:]*:"), F.when(key.isNotNull(), state(a, _IN, held=F.concat(a.held, F.array(pair)))).otherwise(a))
            .when((s == "") | s.startswith("#"), a).otherwise(state(a, _DONE))
        )
        return F.when(a.phase == _DONE, a).when(s.startswith("names"), head).when(a.phase == _IN, block).otherwise(a)

    def finish(a: Column) -> Column:
        last = F.filter(a.held, lambda x: ~F.exists(a.held, lambda y: (y.k == x.k) & (y.i > x.i)))
        mapped = F.transform(F.array_sort(last), lambda x: x.v)
        return F.when(F.size(a.held) > 0, mapped).when(F.size(a.names) > 0, a.names)

    return F.aggregate(lines, start, step, finish)


def listed_names(text: Column) -> Column:
    """A name a line, blank ones left out; null without any."""
    names = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(names) > 0, names)


def class_lists(files: DataFrame) -> DataFrame:
    """(dataset, file, classes) of files (dataset, file, value): the list that counts for each data set that declares one. Settings files
    (*.yaml, *.yml) come first, by their path; then files of NAME_FILES in that order, by their path. Others are ignored."""
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    settings = F.lower(name).rlike(r"\.ya?ml$")
    rank = F.when(settings, 0)
    for i, n in enumerate(NAME_FILES, 1):
        rank = rank.when(name == n, i)
    classes = F.when(settings, F.when(F.col("value").contains("names"), declared_names(F.col("value")))).otherwise(listed_names(F.col("value")))
    found = files.select("dataset", "file", rank.alias("rank"), classes.alias("classes")).where("rank is not null and classes is not null")
    best = found.groupBy("dataset").agg(F.min(F.struct("rank", "file", "classes")).alias("best"))
    return best.select("dataset", "best.file", "best.classes")


def read_class_lists(spark: SparkSession, root: str) -> DataFrame:
    """class_lists() of all files below a folder; a data set is a folder right below it."""
    text = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    return class_lists(text.select(F.regexp_extract(F.input_file_name(), rf"/\Q{base}\E/([^/]+)/", 1).alias("dataset"), F.input_file_name().alias("file"), "value").where("dataset != ''"))


def indexed(lists: DataFrame) -> DataFrame:
    """(dataset, class_id, class_name) of class_lists()."""
    return lists.select("dataset", F.posexplode("classes").alias("class_id", "class_name"))


def disagreements(lists: DataFrame) -> DataFrame:
    """(class_id, names, datasets) of class ids that data sets give more than one name."""
    by = indexed(lists).groupBy("class_id", F.lower("class_name").alias("name")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("class_id")
    many = by.withColumn("k", F.count("*").over(w)).where("k > 1")
    return many.groupBy("class_id").agg(F.sort_array(F.collect_list("name")).alias("names"), F.sum("n").alias("datasets"))
