"""Reports as JSON lines: checked against rules for each field, good ones as columns, bad ones aside with the raw record and the reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.streaming.written import Batches, kept


@dataclass(frozen=True)
class Rule:
    """A field: its type, whether it must be there, and its bounds; of a text, those of its length."""

    name: str
    kind: str
    needed: bool = False
    least: float | None = None
    most: float | None = None


# The fields of a report and of a vote.
REPORT = (
    Rule("device_id", "string", True, 3, 64), Rule("latitude", "double", True, -90, 90), Rule("longitude", "double", True, -180, 180), Rule("damage_type", "string", True, 2, 30),
    Rule("confidence", "double", False, 0, 1), Rule("severity", "int", False, 1, 5), Rule("note", "string", False, None, 280),
)
VOTE = (Rule("device_id", "string", True, 3, 64), Rule("note", "string", False, None, 280))


def _found(r: Rule) -> list[Column]:
    """What a record has in a field: its kind, its text, and whether it is missing."""
    raw = F.try_variant_get("held_", f"$.{r.name}", "variant")
    missing = raw.isNull() | F.is_variant_null(raw)
    return [F.schema_of_variant(raw).alias(f"kind_{r.name}_"), F.try_variant_get("held_", f"$.{r.name}", "string").alias(f"text_{r.name}_"), missing.alias(f"missing_{r.name}_")]


def _read(r: Rule) -> Column:
    """The text of a field that is a text, or the number of one that may be a number."""
    kind, text = F.col(f"kind_{r.name}_"), F.col(f"text_{r.name}_")
    if r.kind == "string":
        return F.when(kind == "STRING", text)
    return F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(F.trim(text).try_cast("double"))


def _value(r: Rule) -> Column:
    """The value of a field, null if it is none of its type.

    Texts must be texts. Numbers may also be texts that are numbers, or true and false; whole numbers may be written with a zero fraction.
    """
    read = value = F.col(f"read_{r.name}_")
    if r.kind != "string":
        value = F.when(~F.isnan(read) & (F.abs(read) < float("inf")), read if r.kind == "double" else F.when(read == F.floor(read), read.try_cast("int")))
    return F.when(~F.col(f"missing_{r.name}_"), value)


def _why(r: Rule) -> Column:
    """The reason why a field cannot be taken (null: it can)."""
    value = F.col(f"value_{r.name}_")
    size = F.length(value) if r.kind == "string" else value
    why = F.when(F.col(f"missing_{r.name}_"), F.lit("is missing") if r.needed else F.lit(None).cast("string")).when(value.isNull(), F.lit(f"is no {r.kind}"))
    low, high = "is too short" if r.kind == "string" else "is too small", "is too long" if r.kind == "string" else "is too great"
    if r.least is not None:
        why = why.when(size < r.least, F.lit(low))
    if r.most is not None:
        why = why.when(size > r.most, F.lit(high))
    return F.concat(F.lit(f"{r.name} "), why)


def checked(lines: DataFrame, rules: tuple[Rule, ...] = REPORT, column: str = "value") -> DataFrame:
    """lines with the fields of the rules and `problems`, the reasons against each record in the order of the rules: none if it is good.

    What is no JSON object has the single problem "no object". Further fields of a record are ignored. Works on tables and streams.
    """
    rest = [c for c in lines.columns if c != column]
    held = F.try_parse_json(F.col(column))
    parsed = lines.select(*rest, F.col(column).alias("raw"), F.when(F.schema_of_variant(held).startswith("OBJECT"), held).alias("held_"))
    # step by step, so that each step's columns are computed once; a plan of one step names a field hundreds of times
    found = parsed.select("*", *(c for r in rules for c in _found(r)))
    read = found.select("*", *(_read(r).alias(f"read_{r.name}_") for r in rules))
    values = read.select("*", *(_value(r).alias(f"value_{r.name}_") for r in rules))
    problems = F.when(F.col("held_").isNull(), F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(*(_why(r) for r in rules))))
    return values.select(*rest, "raw", *(F.col(f"value_{r.name}_").alias(r.name) for r in rules), problems.alias("problems"))


class Ingested:
    """Two tables kept from a stream of JSON lines (at, value): reports that are good, and quarantine with the raw record and its problems."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = REPORT):
        self.rules, self.path = rules, path
        fields = ", ".join(f"{r.name} {r.kind}" for r in rules)
        self.reports = Batches(spark, f"{path}/reports", f"at timestamp, {fields}")
        self.quarantine = Batches(spark, f"{path}/quarantine", "at timestamp, raw string, problems array<string>")

    def each(self, batch: DataFrame, n: int) -> None:
        rows = checked(batch.select("at", "value"), self.rules)
        good = F.size("problems") == 0
        self.quarantine.put(n, rows.where(~good).select("at", "raw", "problems"))
        self.reports.put(n, rows.where(good).select("at", *(r.name for r in self.rules)))

    def run(self, stream: DataFrame) -> None:
        kept(stream, self.path, self.each)
