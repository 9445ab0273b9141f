"""Benchmark decontamination by templates.

Numbers, names and units are replaced by typed placeholders, so that a question with other figures or names keeps its template.
Windows of WINDOW template words are hash-joined between benchmark and documents. A document contains an item if it holds at least
COVERAGE of the item's distinct windows and the slots agree: where one value of the item recurs, the document must have one value
too, for at least CONSISTENT of the slots. Copies agree trivially; a re-parameterised question does so with other values; chance
meetings of placeholders do not.

Each occurrence is judged by itself: meetings are filed by their offset (place in the document less place in the item) under two
grids of cells half as wide as the item, so that those within a quarter of its length of each other share a cell, and neighbouring
copies do not. In a cell each window of the item counts once, at the offset that most windows have. The whole document is judged
as well. An item is also contained if VERBATIM of its words stand in a row in the document. An item without any window (under WINDOW
words, or placeholders almost alone) is contained in a document that has its words and no others, case and punctuation aside.

What is compared are texts, by hash: a text that recurs is judged once, and ids, repeated or null, play no part until the end.

Documents are scanned once against the sorted hashes of the benchmark's windows, BLOCK of them at a time whatever the size of the
benchmark, so that only windows that meet one reach the shuffle. All else is joins and grouped sums.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.words import REMEMBERED, in_parts, mapped, rolling, signed, texts
from kerbline.session import written

WINDOW = 5
COVERAGE = 0.8
CONSISTENT = 0.8
#: Words in a row, literally equal, that are reported whatever share of the item they are; of VERBATIM / WINDOW distinct windows at least.
VERBATIM = 50
#: Words of a window that must not be placeholders.
LITERAL = 2
#: Hashes that a pass over the documents holds: 8 bytes each.
BLOCK = 4_000_000
LITERALS, NUMBER, NAME, UNIT = 0, 1, 2, 3
PLACEHOLDERS = (b"", b"<number>", b"<name>", b"<unit>")
#: Units of measure.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg lb lbs pound pounds ounce ounces oz ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month "
    "months year years dollar dollars cent cents euro euros percent degree degrees watt watts kw kwh mph kmh km/h m/s hz khz mhz ghz "
    "kb mb gb tb".split()
)
_EDGE = string.punctuation.encode()
_CLOSING = bytes(c for c in _EDGE if c not in b".!?:")
_NUMBER = re.compile(rb"\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?")
_ONES = re.compile(rb"one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|hundred|thousand|million")


class Templates(dict):
    """word -> number of a row of the arrays: hash and kind at the start of a sentence and inside, and whether it ends one."""

    def __init__(self) -> None:
        super().__init__()
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.hash = (array("Q"), array("Q"))
        self.kind = (array("b"), array("b"))
        self.ends, self.bare = array("b"), array("b")

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_EDGE)
        low = core.lower()
        if _NUMBER.fullmatch(core) or _ONES.fullmatch(low):
            kinds = (NUMBER, NUMBER)
        elif low.decode("utf-8", "replace") in UNITS:
            kinds = (UNIT, UNIT)
        else:
            kinds = (LITERALS, NAME if core.decode("utf-8", "replace").istitle() else LITERALS)
        text = core.decode("utf-8", "replace").lower().encode()
        for i in (0, 1):
            self.hash[i].append(xxhash.xxh64_intdigest(PLACEHOLDERS[kinds[i]] or text, 5))
            self.kind[i].append(kinds[i])
        self.ends.append(word.rstrip(_CLOSING).endswith((b".", b"!", b"?", b":")))
        self.bare.append(not core)
        n = self[word] = len(self.ends) - 1
        return n


_templates = Templates()


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Of the texts laid end to end: the hash of each window in one text, where it starts, where texts start, kinds, and the words."""
    if len(_templates) > REMEMBERED:
        _templates.empty()
    words = [t.split() for t in texts(column)]
    rows = [np.fromiter(map(_templates.__getitem__, w), np.int64, len(w)) for w in words]
    bare = np.frombuffer(_templates.bare, np.int8).astype(bool)
    for i, r in enumerate(rows):
        if len(r) and (drop := bare[r]).any():  # marks that stand alone are no words
            rows[i], words[i] = r[~drop], list(compress(words[i], ~drop))
    first = np.zeros(len(words) + 1, np.int64)
    first[1:] = np.cumsum([len(w) for w in words])
    row = np.concatenate([np.zeros(0, np.int64), *rows])
    starts = np.zeros(len(row) + 1, bool)
    starts[1:] = np.frombuffer(_templates.ends, np.int8)[row] if len(row) else False
    starts[first] = True
    starts = starts[: len(row)]

    def pick(pair, kind):
        return np.where(starts, np.frombuffer(pair[0], kind)[row], np.frombuffer(pair[1], kind)[row]) if len(row) else np.zeros(0, kind)

    h, kinds = pick(_templates.hash, np.uint64), pick(_templates.kind, np.int8)
    n = max(0, len(row) - WINDOW + 1)
    of = np.repeat(np.arange(len(words)), np.diff(first))[:n]
    literal = np.cumsum(np.append(0, kinds == LITERALS))
    ok = (np.arange(n) + WINDOW <= first[of + 1]) & (literal[WINDOW : WINDOW + n] - literal[:n] >= LITERAL)
    at = np.nonzero(ok)[0]
    return rolling(h, WINDOW, 0x9E3779B97F4A7C15)[at], at, first, kinds, words


#: whole: 0, or the words of a text whose whole stands for a window.
WINDOWS = "key long, at long, hash long, slots array<struct<kind: int, value: string>>, whole long"


def whole_text(words: list[bytes]) -> int:
    """The hash of all words of a text, which stands for the windows it lacks."""
    return xxhash.xxh64_intdigest(b" ".join(w.strip(_EDGE).decode("utf-8", "replace").lower().encode() for w in words), 9)


def _rows(batches: Iterator[pa.RecordBatch], wanted, longest: int) -> Iterator[pa.RecordBatch]:
    """(key, at, hash, slots, n_words): the windows whose hash is wanted, or all. Of all, a text without windows has its whole as one; of
    those wanted, texts of at most `longest` words have theirs besides."""
    hashes = wanted.value if wanted is not None else None
    if hashes is not None:
        seen = np.zeros(1 << 22, bool)
        seen[hashes & np.uint64((1 << 22) - 1)] = True
    for part in in_parts(batches):
        h, at, first, kinds, words = windows(part.column(1))
        of = np.searchsorted(first, at, side="right") - 1
        lone = np.array([0 < len(w) <= longest for w in words]) if hashes is not None else np.array([len(w) > 0 for w in words]) & (np.bincount(of, minlength=len(words)) == 0)
        lone = np.nonzero(lone)[0]
        h, at = np.append(h, np.array([whole_text(words[d]) for d in lone], np.uint64)), np.append(at, first[lone])
        of, whole = np.append(of, lone), np.append(np.zeros(len(of), bool), np.ones(len(lone), bool))
        if hashes is not None:
            maybe = np.nonzero(seen[h & np.uint64((1 << 22) - 1)])[0]
            place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            maybe = maybe[hashes[place] == h[maybe]]
            h, at, of, whole = h[maybe], at[maybe], of[maybe], whole[maybe]
        if not len(at):
            continue
        slots = []
        for i, d, lone in zip(at, of, whole, strict=True):
            if lone:
                slots.append([])
                continue
            own, k = words[d][i - first[d] : i - first[d] + WINDOW], kinds[i : i + WINDOW]
            slots.append([{"kind": int(x), "value": w.strip(_EDGE).decode().lower()} for w, x in zip(own, k, strict=True) if x != LITERALS])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string())]))
        size = pa.array(np.where(whole, np.diff(first)[of], 0))
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(at - first[of]), pa.array(signed(h)), pa.array(slots, kind), size], ["key", "at", "hash", "slots", "whole"])
    _templates.empty()


def text_key(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def template_windows(texts: DataFrame, wanted=None, longest: int = 0) -> DataFrame:
    """Of texts (key, text)."""
    return mapped(texts, lambda b: _rows(b, wanted, longest), WINDOWS)


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """Rows (doc, item, coverage, consistency, reparameterised) of the keys of texts: for each text and item that it contains, the
    figures of the best occurrence."""
    spark = docs.sparkSession
    items = benchmark.select(text_key(F.col(item_text)).alias("key"), F.col(item_text).alias("text"))
    ours = template_windows(items).dropDuplicates(["key", "at", "hash"]).withColumnsRenamed({"key": "item", "at": "item_at", "slots": "item_slots"})
    ours = written(ours, "templates")
    size = ours.groupBy("item").agg(F.countDistinct("hash").alias("n_windows"), F.ceil((F.max("item_at") + WINDOW) / 4).alias("quarter"))
    distinct = ours.select("hash").distinct()
    many, longest = distinct.count(), ours.agg(F.max("whole")).first()[0] or 0
    blocks = -(-many // BLOCK)
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    hits = spark.createDataFrame([], WINDOWS)
    for b in range(blocks):
        mine = distinct.where(F.pmod("hash", F.lit(blocks)) == b).toPandas()["hash"].to_numpy()
        wanted = spark.sparkContext.broadcast(np.sort(mine.view(np.uint64)))
        found = template_windows(texts, wanted, longest)
        hits = found if blocks == 1 else hits.unionByName(found)
    hits = written(hits.drop("whole").withColumnRenamed("key", "doc"), "hits").dropDuplicates(["doc", "at", "hash"])
    share = hits.select("doc", "hash").distinct().join(ours.select("item", "hash").distinct(), "hash").groupBy("doc", "item").agg(F.count("*").alias("n_held"))
    held = F.col("n_held") / F.col("n_windows")
    likely = share.join(size, "item").where((held >= coverage) | (F.col("n_held") >= VERBATIM // WINDOW)).select("doc", "item", "n_windows", "quarter")
    likely = written(likely, "likely")
    met = hits.join(likely, "doc").join(ours, ["hash", "item"])
    met = met.select("doc", "item", "n_windows", "quarter", "hash", "item_at", (F.col("at") - F.col("item_at")).alias("offset"), "slots", "item_slots")
    met = written(met.withColumn("equal", F.col("slots") == F.col("item_slots")), "met")
    out = _occurrences(met, coverage, consistent).unionByName(_in_a_row(met))
    best = out.groupBy("doc", "item").agg(F.max(F.struct("found", "coverage", "consistency", "same")).alias("best"), F.max("found").alias("found"))
    return best.where("found").select("doc", "item", "best.coverage", "best.consistency", (~F.col("best.same")).alias("reparameterised"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, consistent: float = CONSISTENT
) -> DataFrame:
    """Rows (doc_id, item_id, coverage, consistency, reparameterised), one for each row of docs and different item it contains.

    The figures are those of the best occurrence. Each row is judged by its own text, so null and repeated ids, of documents or items,
    change nothing: a repeated row has its rows again, an item that is repeated whole counts once, and equal items with different ids
    are reported each. Null and empty texts contain nothing and are contained nowhere. reparameterised: some slot has another value
    than in the item. Empty tables give an empty table.
    """
    found = written(matches(docs, benchmark, text_col, item_text, coverage, consistent), "matches")
    items = benchmark.select(text_key(F.col(item_text)).alias("item"), F.col(item_col).alias("item_id")).distinct()
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("doc"))
    return keyed.join(found, "doc").join(items, "item").select("doc_id", "item_id", "coverage", "consistency", "reparameterised")


def _occurrences(met: DataFrame, coverage: float, consistent: float) -> DataFrame:
    """(doc, item, found, coverage, consistency, same) of each cell of offsets, and of the whole document."""
    width = F.col("quarter") * 2
    cells = F.array(*(F.struct(F.lit(grid).alias("grid"), F.floor((F.col("offset") + shift) / width).alias("cell")) for grid, shift in ((1, F.lit(0)), (2, F.col("quarter")))))
    cell = ["doc", "item", "place"]
    placed = met.withColumn("place", F.explode(cells)).withColumn("many", F.count("*").over(Window.partitionBy(*cell, "offset")))
    nth = F.row_number().over(Window.partitionBy(*cell, "item_at", "hash").orderBy(F.desc("many"), "offset"))
    placed = placed.withColumn("nth", nth).where("nth = 1").drop("many", "nth")
    whole = met.withColumn("place", F.struct(F.lit(0).alias("grid"), F.lit(0).cast("long").alias("cell")))
    placed = written(placed.unionByName(whole), "placed")
    share = placed.groupBy(*cell).agg((F.countDistinct("hash") / F.max("n_windows")).alias("coverage"))
    pairs = placed.select(*cell, "equal", F.explode(F.arrays_zip(F.col("slots").alias("d"), F.col("item_slots").alias("i"))).alias("p")).where("p.d.kind = p.i.kind")
    pairs = pairs.groupBy(*cell, "equal", "p.i.kind", F.col("p.i.value").alias("ours"), F.col("p.d.value").alias("theirs")).agg(F.count("*").alias("n"))
    # slots of literally equal windows agree; the others must have one value
    slots = pairs.groupBy(*cell, "equal", "kind", "ours").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.max(F.col("ours") != F.col("theirs")).alias("other"))
    slots = slots.groupBy(*cell).agg((F.sum("most") / F.sum("n")).alias("consistency"), F.max("other").alias("other"))
    out = share.join(slots, cell, "left").select("doc", "item", "coverage", F.coalesce("consistency", F.lit(1.0)).alias("consistency"), F.coalesce(~F.col("other"), F.lit(True)).alias("same"))
    return out.withColumn("found", (F.col("coverage") >= coverage) & (F.col("consistency") >= consistent))


def _in_a_row(met: DataFrame) -> DataFrame:
    """The same of stretches of VERBATIM literally equal words or more: windows of one offset, with no word between them left out."""
    line = Window.partitionBy("doc", "item", "offset").orderBy("item_at")
    equal = met.where("equal").select("doc", "item", "n_windows", "offset", "item_at", "hash").distinct()
    equal = equal.withColumn("cut", F.coalesce((F.col("item_at") - F.lag("item_at").over(line) > WINDOW).cast("int"), F.lit(0)))
    runs = equal.withColumn("run", F.sum("cut").over(line)).groupBy("doc", "item", "offset", "run")
    runs = runs.agg((F.max("item_at") - F.min("item_at") + WINDOW).alias("words"), F.countDistinct("hash").alias("n"), F.max("n_windows").alias("n_windows"))
    runs = runs.where((F.col("words") >= VERBATIM) & (F.col("n") >= VERBATIM // WINDOW))
    return runs.select("doc", "item", (F.col("n") / F.col("n_windows")).alias("coverage"), F.lit(1.0).alias("consistency"), F.lit(True).alias("same"), F.lit(True).alias("found"))
