"""Secrets in texts, told apart by who holds them.

Candidates are the base patterns (assign, access, hex) and, as the method's own kind, long tokens of mixed letters and digits
(token). Each candidate's hash is counted over the corpus by distinct repositories and distinct owners. One that at most
MOST_OWNERS owners hold, in at most MOST_REPOSITORIES repositories, is live-looking; one that more owners hold, or that an owner
repeats in more repositories, as a footer or a template does, is a copied example. Base spans always stay; a token span is added
only where it looks live.

All in Spark SQL functions. Positions come without markers: the pattern is run anchored at the end of the last match, behind a lazy
gap, so the lengths of gaps and matches add up to the offsets, BLOCK matches at a time, so that the work follows the number of matches. Distinct owners are counted by two grouped steps, combined before
each shuffle, so that a secret in every document makes no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.session import written

#: The base patterns, in the order in which kinds are listed, and the least length of what they must hold.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=\-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24, "token": 32}
KINDS = ("assign", "access", "hex", "token")
#: The method's own kind: this many characters in a row, with a letter and a digit.
TOKEN = r"[A-Za-z0-9+/_\-]{32,}"
#: More owners or more repositories than this make a candidate a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 20
#: Matches whose offsets are added up in one array.
BLOCK = 256


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _spans(kind: str, text: Column, head: str, value: str, seen: Column) -> Column:
    """Array of (start, end, kind, value) of all matches whose value is long enough; empty unless `seen`, a cheap test."""
    pattern = F.lit(rf"(?s)\G(.*?)({head})({value})")
    gaps, heads, values = (F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2, 3))
    matches = F.transform(
        F.arrays_zip(gaps.alias("gap"), heads.alias("head"), values.alias("value")),
        lambda m: F.struct(F.length(m["gap"]).alias("gap"), (F.length(m["head"]) + F.length(m["value"])).alias("size"), m["value"].alias("value")),
    )
    zero = F.lit(0)

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        one = F.struct(start.alias("start"), (start + m["size"]).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), m["value"].alias("value"))
        return F.struct((start + m["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def within(begin: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(begin.alias("at"), empty.alias("out")), add)["out"]

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda n, m: n + m["gap"] + m["size"]))
        begins = F.aggregate(sizes, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        return F.flatten(F.zip_with(begins["out"], blocks, within))

    empty = F.array().cast("array<struct<start: int, end: int, kind: int, value: string>>")
    cut = _let(matches, lambda ms: F.transform(F.sequence(zero, F.floor((F.size(ms) - 1) / BLOCK).cast("int")), lambda b: F.slice(ms, b * BLOCK + 1, BLOCK)))
    return F.when(seen, F.filter(_let(cut, placed), lambda x: F.length(x["value"]) >= LEAST[kind])).otherwise(empty)


def candidates(text: Column) -> Column:
    """All candidate spans of a text by start, then kind; code points, end exclusive."""
    low = F.lower(text)
    word = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")
    both = F.concat(
        _spans("assign", text, ASSIGN, VALUE, word & text.rlike(ASSIGN + VALUE)),
        _spans("access", text, "", ACCESS, text.contains("AKIA")),
        _spans("hex", text, "", r"(?<![0-9a-f])[0-9a-f]{24,}", text.rlike("[0-9a-f]{24}")),
        F.filter(
            _spans("token", text, "", TOKEN, text.rlike(r"[A-Za-z0-9+/_\-]{32}")),
            lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"),
        ),
    )
    return F.array_sort(both)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column `candidates`; a null text has none."""
    return docs.withColumn("candidates", candidates(F.coalesce(F.col(text_col), F.lit(""))))


def ownership(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """(secret, repositories, owners, live): for each candidate hash how many distinct repositories and owners hold it.

    A null repository or owner is one of its own. Repeated rows of one repository count once. Empty in, empty out.
    """
    none = F.lit("\0")
    each = found.select(
        F.explode("candidates").alias("c"), F.coalesce(repository.cast("string"), none).alias("repository"), F.coalesce(owner.cast("string"), none).alias("owner")
    ).select(F.sha2(F.col("c.value"), 256).alias("secret"), "repository", "owner")
    pairs = each.groupBy("secret", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("secret", "owner").agg(F.lit(1).alias("one")).groupBy("secret").agg(F.count("*").alias("owners"))
    repositories = pairs.groupBy("secret", "repository").agg(F.lit(1).alias("one")).groupBy("secret").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "secret").withColumn("live", (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES))


def label(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", label(x["kind"]), x["start"], x["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, counts of base spans, base_sha256, spans, how many spans look live, and the most owners and
    repositories that hold one of its candidates.

    A null text is empty and has no spans. Null ids and owners are a repository and an owner like others; rows of one id are one
    repository, and repeated rows come back repeated. Spans that begin together are listed by kind. Empty in, empty out.
    """
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(owner_col).alias("owner")))
    slim = written(found.select("doc_id", "owner", "candidates"), "candidates")
    known = ownership(slim, F.col("doc_id"), F.col("owner"))
    most = ("most_owners", "most_repositories")
    hashed = F.transform("candidates", lambda x: F.sha2(x["value"], 256))
    none = slim.where(F.size("candidates") == 0).select("doc_id", F.col("candidates").alias("found"), F.lit(0).cast("long").alias("n_live"), *(F.lit(0).cast("long").alias(c) for c in most))
    some = slim.where(F.size("candidates") > 0).withColumn("row", F.monotonically_increasing_id())
    each = some.select("row", "doc_id", F.posexplode("candidates").alias("i", "c"), hashed.alias("h")).select("row", "doc_id", "c", F.element_at("h", F.col("i") + 1).alias("secret"))
    judged = each.join(known, "secret")
    kept = judged.withColumn("c", F.when((F.col("c.kind") < KINDS.index("token")) | F.col("live"), F.col("c")))
    some = kept.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list("c")).alias("found"), F.count_if("live").alias("n_live"), F.max("owners").alias(most[0]), F.max("repositories").alias(most[1])).drop("row")
    base = F.filter("found", lambda x: x["kind"] < KINDS.index("token"))

    def many(kind: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [many(kind) for kind in range(3)]
    return none.unionByName(some).select("doc_id", *counts, F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("found")).alias("spans"), "n_live", *most)


def _unused(name: str, columns: list[str]) -> str:
    """The name, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """docs with every base span, and every span that looks live, replaced by the mask; overlapping spans make one mask.

    Rows without a span come back as they are, null texts too. Whether a span is masked rests on the whole table. Columns of docs
    may have any names.
    """
    c, row, spans = (_unused(n, docs.columns) for n in ("candidates", "row", "spans"))
    found = docs.withColumn(c, candidates(F.coalesce(F.col(text_col), F.lit(""))))
    none = found.where(F.size(c) == 0).drop(c)
    some = written(found.where(F.size(c) > 0).withColumn(row, F.monotonically_increasing_id()), "candidates")
    slim = some.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(c).alias("candidates"))
    known = ownership(slim, F.col("id"), F.col("owner")).where("live").select("secret", F.lit(True).alias("live"))
    each = slim.select("row", F.explode("candidates").alias("c")).withColumn("secret", F.sha2(F.col("c.value"), 256))
    judged = each.join(known, "secret", "left").where((F.col("c.kind") < KINDS.index("token")) | F.col("live"))
    by_row = judged.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("c.start", "c.end"))).alias(spans))
    text = F.col(text_col)

    def add(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    masked = F.when(F.col(spans).isNull(), text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    changed = some.drop(c).join(by_row, row, "left").withColumn(text_col, masked).select(*docs.columns)
    return none.unionByName(changed)
