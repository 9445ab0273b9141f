"""Sparse, dense and fused retrieval, and the grounding of answers."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import written

K1, B, RRF = 1.2, 0.75, 60

_word = re.compile("[a-z]+")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


#: Weights of a term that begins with the word asked for, and of one a few letters off: a fifth of the word's length.
PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZY = 0.375, 0.45, 0.2


def _deletions(word: Column) -> Column:
    """The word with up to two letters left out, in every way: two words at most two edits apart share one."""

    def less(w: Column) -> Column:
        return F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))

    once = F.array_distinct(less(word))
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, less))))


def fuzzy_terms(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, word, weight): the words of vocabulary (word) that a query (query_id, word) reaches: itself at 1, longer ones that begin with
    it, and those at most round(length / 5) edits away, two at most; each at its best weight.

    Joins are equi-joins on prefixes and on deletions; vocabulary rows that no query can reach leave before the shuffle where Spark
    finds the queries small.
    """
    a = written(asked.select("query_id", F.col("word").alias("w")).distinct(), "asked")
    words = a.select("w").distinct()
    prefixes = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("w")).join(words, "w")
    longer = F.length("word") - F.length("w")
    begun = prefixes.select("w", "word", F.when(longer == 0, 1.0).otherwise(PREFIX_WEIGHT * F.length("w") / (F.length("w") + 0.3 * longer)).alias("weight"))
    keys = words.select("w", F.explode(_deletions(F.col("w"))).alias("key"))
    met = vocabulary.select("word", F.explode(_deletions(F.col("word"))).alias("key")).join(keys, "key").select("w", "word").distinct()
    most = F.least(F.lit(2), F.round(F.length("w") * FUZZY))
    off = F.levenshtein("w", "word")
    near = met.where((off > 0) & (off <= most)).select("w", "word", (FUZZY_WEIGHT * F.length("w") / (F.length("w") + off)).alias("weight"))
    return a.join(begun.unionByName(near), "w").groupBy("query_id", "word").agg(F.max("weight").alias("weight"))


#: Terms of queries sent to all tasks, at most: those in most documents. Each other is in fewer than this share of what is scored.
OFTEN = 1 << 17
#: Rows of a task where it joins or sums, about; and scores that a task of the documents holds at a time.
A_TASK, AT_HAND = 1 << 20, 1 << 20


def bm25(docs: DataFrame, queries: DataFrame, k: int = 6, fuzzy: bool = False, often: int = OFTEN, a_task: int = A_TASK) -> DataFrame:
    """(query_id, id, score, rank): the best k documents (id, text) for each query (query_id, text); ties by id.

    With fuzzy, words that begin with one asked for or are a few letters off count as well, by fuzzy_terms().
    """
    return _ranked(docs.select("id", F.lit("text").alias("field"), F.lit(1.0).alias("boost"), "text"), queries, k, fuzzy, often, a_task)


#: How much more a word counts in a title and among tags.
BOOSTS = {"title": 3.0, "text": 1.0, "tags": 2.0}


def bm25_fields(docs: DataFrame, queries: DataFrame, k: int = 6, boosts: dict[str, float] | None = None, fuzzy: bool = False, often: int = OFTEN, a_task: int = A_TASK) -> DataFrame:
    """bm25() over documents (id, and a column for each field of boosts): each field has document frequencies and a mean length of its own, and its
    score counts as often as its boost. A null field is empty. Ties go to the smaller id."""
    boosts = BOOSTS if boosts is None else boosts
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(float(x)).alias("boost"), F.coalesce(f, F.lit("")).alias("text")) for f, x in boosts.items()))
    return _ranked(docs.select("id", F.explode(fields).alias("f")).select("id", "f.*"), queries, k, fuzzy, often, a_task)


def _ranked(each: DataFrame, queries: DataFrame, k: int, fuzzy: bool, often: int, a_task: int) -> DataFrame:
    """bm25() of (id, field, boost, text).

    A task scores its documents by the terms that are in most of them, sent to all (at most `often`). All other words go to the task of their
    term, a_task rows each, and sums are added up a_task rows each, so what a task holds does not grow with the documents.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    each = _joined_up(each)
    own = each.withColumn("w", words(F.col("text")))
    length = F.coalesce("len", F.size("w"))
    found = own.groupBy("field", "boost").agg(F.sum("rows").alias("n"), (F.sum(length * F.col("rows")) / F.sum(F.when(length.isNotNull(), F.col("rows")))).alias("avg_len"), F.sum(F.size(F.array_distinct("w"))).alias("posts"))
    totals = found.collect()  # a row for each field
    spark = each.sparkSession
    found = spark.createDataFrame(totals, found.schema)
    vocabulary = own.select("field", F.explode(F.array_distinct("w")).alias("word"))
    if not fuzzy:
        vocabulary = vocabulary.join(asked.select("word").distinct(), "word", "left_semi")
    vocabulary = written(vocabulary.groupBy("field", "word").agg(F.count("*").alias("df")), "vocabulary")
    if fuzzy:  # a word has several terms, each found in several ways
        tasks = _tasks(spark, 16 * vocabulary.count(), a_task)
        asked = written(fuzzy_terms(asked, vocabulary.select("word").repartition(tasks, "word").distinct()), "asked")
    else:
        asked = asked.withColumn("weight", F.lit(1.0))
    tasks = _tasks(spark, vocabulary.count() + asked.count(), a_task)
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = vocabulary.repartition(tasks, "word").join(asked.repartition(tasks, "word").hint("merge"), "word").join(F.broadcast(found), "field").select("query_id", "field", "word", "df", (F.col("boost") * F.col("weight") * idf).alias("gain"))
    terms = written(terms, "terms")

    to_score = terms.agg(F.sum("df")).first()[0] or 0
    held = terms.where(F.col("df") > to_score / often).toPandas()
    rest = terms.where(F.col("df") <= to_score / often)
    left = rest.agg(F.sum("df")).first()[0] or 0  # scores of a document for one term of a query
    mean = {r.field: r.avg_len for r in totals}
    place, first, count = {f: {} for f in mean}, [], []
    held = held.sort_values(["field", "word"], kind="stable").reset_index(drop=True)
    for (field, word), rows in held.groupby(["field", "word"], sort=True).indices.items():
        place[field][word] = len(first)
        first.append(rows[0])
        count.append(len(rows))
    codes, ids = pd.factorize(held.query_id)
    sent = spark.sparkContext.broadcast((place, np.array(first, int), np.array(count, int), codes, held.gain.to_numpy(float), ids.to_numpy(), mean))
    kinds = dict(terms.dtypes) | dict(each.dtypes)
    texts = each.select("id", "field", "len", F.lower("text").alias("text")).where(F.col("text").isNotNull())
    sums = texts.mapInPandas(lambda batches: _summed(batches, sent.value), f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    if left:
        posts = sum(r.posts or 0 for r in totals) - sum(held.drop_duplicates(["field", "word"]).df)
        tasks = _tasks(spark, posts, a_task)
        post = texts.mapInPandas(lambda batches: _others(batches, sent.value), f"id {kinds['id']}, field string, word string, part double")
        met = post.repartition(tasks, "field", "word").join(rest.repartition(tasks, "field", "word").hint("merge"), ["field", "word"])
        sums = sums.unionByName(met.select("query_id", "id", (F.col("gain") * F.col("part")).alias("score")))
    tasks = _tasks(spark, sum(r.n for r in totals) * len(ids) + left, a_task)
    return _best(sums.repartition(tasks, "query_id", "id").groupBy("query_id", "id").agg(F.round(F.sum("score"), 6).alias("score")), k)


def _tasks(spark, rows: int, a_task: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // a_task))


def _joined_up(each: DataFrame) -> DataFrame:
    """(id, field, boost, text, len, rows): rows of one id, field and length count as one text of that length; len is null for others."""
    alone = each.withColumns({"len": F.lit(None).cast("int"), "rows": F.lit(1).cast("long")})
    again = written(each.groupBy("id", "field").agg(F.count("*").alias("n")).where("n > 1").select("id", "field"), "again")
    if again.isEmpty():
        return alone
    same = each.join(again, ["id", "field"], "left_semi").withColumn("len", F.size(words(F.col("text"))))
    same = same.groupBy("id", "field", "boost", "len").agg(F.count("*").alias("rows"), F.when(F.col("len").isNotNull(), F.concat_ws(" ", F.collect_list("text"))).alias("text"))
    return written(alone.join(again, ["id", "field"], "left_anti").unionByName(same), "texts")


def _counted(text: str, length: float, mean: float | None) -> tuple[Counter, float]:
    """How often each word is in a lower-cased text, and what the length of the text adds to each."""
    found = _word.findall(text)
    if not found:
        return Counter(), 0.0
    return Counter(found), K1 * (1 - B + B * (len(found) if np.isnan(length) else length) / mean)


def _summed(batches, sent):
    """(query_id, id, score): what the terms sent to all tasks give a text."""
    place, first, count, query, gain, ids, mean = sent
    slab = max(1, min(SLAB, AT_HAND // max(1, len(ids))))
    for x in batches:
        for at in range(0, len(x), slab):
            some = x.iloc[at : at + slab]
            row, term, tf, more = [], [], [], []
            for i, (field, length, text) in enumerate(zip(some.field, some.len.astype(float), some.text, strict=True)):
                own, held = place[field], len(term)
                counts, of_length = _counted(text, length, mean[field])
                for w, n in counts.items():
                    t = own.get(w)
                    if t is not None:
                        term.append(t)
                        tf.append(n)
                row += [i] * (len(term) - held)
                more += [of_length] * (len(term) - held)
            if not term:
                continue
            term, tf = np.array(term), np.array(tf, float)
            part = tf * (K1 + 1) / (tf + np.array(more))
            each = count[term]
            ends = np.cumsum(each)
            entry = np.arange(ends[-1]) + np.repeat(first[term] - ends + each, each)
            key = np.repeat(np.array(row) * len(ids), each) + query[entry]
            score = np.bincount(key, gain[entry] * np.repeat(part, each), len(some) * len(ids))
            key = np.flatnonzero(np.bincount(key, minlength=len(score)))
            yield pd.DataFrame({"query_id": ids[key % len(ids)], "id": some.id.to_numpy()[key // len(ids)], "score": score[key]})


def _others(batches, sent):
    """(id, field, word, part): the words of a text that were not sent to all tasks."""
    place, mean = sent[0], sent[-1]
    for x in batches:
        for at in range(0, len(x), SLAB):
            out = []
            for key, field, length, text in zip(x.id[at : at + SLAB], x.field[at : at + SLAB], x.len[at : at + SLAB].astype(float), x.text[at : at + SLAB], strict=True):
                own = place[field]
                counts, of_length = _counted(text, length, mean[field])
                out += [(key, field, w, n * (K1 + 1) / (n + of_length)) for w, n in counts.items() if w not in own]
            if out:
                yield pd.DataFrame(out, columns=["id", "field", "word", "part"])


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when(norm > 0, total(a, b) / norm).otherwise(0.0)


#: Queries that a pass over the vectors holds, about.
AT_ONCE = 4096
#: Queries and vectors whose cosines a task holds at a time: tables of half a megabyte.
SLAB = 256


def _compared(vectors: DataFrame, queries: DataFrame, pick, at_once: int) -> DataFrame:
    """(query_id, id, score) of what pick(scores, query ids, ids, kept before) keeps of a task's vectors: the cosines with each query of a block.

    Queries are a stated set, sent a block at a time whatever their number. A task compares SLAB by SLAB and holds what is picked so far,
    as (score, id, row of the slab of queries), which alone leaves it.
    """
    blocks = max(1, -(-queries.count() // at_once))
    out = []
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        if not len(block):
            continue
        held = vectors.sparkSession.sparkContext.broadcast((block.query_id.to_numpy(), _unit(np.stack(block.q.to_numpy()).astype(float))))

        def run(batches, held=held):
            ids, q = held.value
            best = None
            for x in batches:
                vec, own = _unit(np.stack(x.v.to_numpy()).astype(float)) if len(x) else None, x.id.to_numpy()
                for at in range(0, len(x), SLAB):
                    some, theirs = vec[at : at + SLAB].T, own[at : at + SLAB]
                    if best is None:
                        best = [None] * -(-len(q) // SLAB)
                    for i in range(len(best)):
                        mine = slice(i * SLAB, (i + 1) * SLAB)
                        best[i] = pick(np.round(q[mine] @ some, 6) + 0.0, ids[mine], theirs, best[i])
            for i, kept in enumerate(best or ()):
                score, at, row = kept
                real = ~np.isinf(score)
                yield pd.DataFrame({"query_id": ids[i * SLAB + row][real], "id": at[real], "score": score[real]})

        out.append(vectors.mapInPandas(run, "query_id long, id long, score double"))
    return reduce(DataFrame.unionByName, out) if out else vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 6, at_once: int = AT_ONCE) -> DataFrame:
    """(query_id, id, score, rank) by cosine between vectors (id, v) and a stated set of queries (query_id, q), with all rows compared."""

    def best(score, _, ids, kept):
        n = len(score)
        ids = np.broadcast_to(ids, score.shape)
        if kept is not None:
            score, ids = np.hstack([kept[0].reshape(n, -1), score]), np.hstack([kept[1].reshape(n, -1), ids])
        order = np.lexsort((ids, -score), axis=1)[:, :k]
        return np.take_along_axis(score, order, 1).ravel(), np.take_along_axis(ids, order, 1).ravel(), np.repeat(np.arange(n), order.shape[1])

    return _best(_compared(vectors, queries, best, at_once), k)


def extremes(vectors: DataFrame, queries: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(query_id, best, worst) cosine with any other vector."""

    def ends(score, mine, ids, kept):
        low, high = (np.where(mine[:, None] == ids, x, score) for x in (np.inf, -np.inf))
        low, high = np.fmin.reduce(low, axis=1), high.max(axis=1)
        if kept is not None:
            low, high = np.fmin(low, kept[0][: len(mine)]), np.maximum(high, kept[0][len(mine) :])
        row = np.arange(len(mine))
        return np.concatenate([low, high]), np.concatenate([mine, mine]), np.concatenate([row, row])

    return _compared(vectors, queries, ends, at_once).groupBy("query_id").agg(F.max("score").alias("best"), F.min("score").alias("worst"))


def fused(*ranked: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank), rank from 1."""
    both = ranked[0].select("query_id", "id", "rank")
    for r in ranked[1:]:
        both = both.unionByName(r.select("query_id", "id", "rank"))
    return both.groupBy("query_id", "id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 9).alias("score"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)


def grounded(answers: DataFrame, least: float = 0.42) -> DataFrame:
    """(answer_id, answer, context) to (answer_id, kept, dropped): sentences whose numbers and words the context bears out."""
    known = words(F.col("context"))
    numbers = F.regexp_extract_all("context", F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    each = answers.select("answer_id", F.array_distinct(known).alias("known"), numbers.alias("numbers"), F.explode(sentences(F.col("answer"))).alias("s"))
    own = F.filter(words(F.col("s")), lambda w: F.length(w) >= 3)
    each = each.withColumn("own", own).withColumn("bad", F.exists(F.regexp_extract_all("s", F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: ~F.array_contains("numbers", n)))
    held = F.size(F.filter("own", lambda w: F.array_contains("known", w)))
    keep = ~F.col("bad") & ((F.size("own") == 0) | (held >= least * F.size("own")))
    return each.groupBy("answer_id").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))
