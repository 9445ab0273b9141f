"""Hierarchical packing of tokenised documents into windows of several lengths.

The tiers are the powers of two from LEAST to the window length. A document gives whole windows of the longest tier, and its rest
is routed to the smallest tier that holds it. Each tier is packed in turn, longest first: a rest opens a window of its tier, the
gap is filled with the longest rests of shorter tiers that still fit, and what is left of the gap is filled by cutting the
shortest rest at hand. So a window ends exactly full, at a power of two, and needs no padding. The last tokens of a task, too few
for a window of the smallest tier, are cut into powers of two as well.

Packing runs inside each task over the documents that it reads, FILL_FROM at a time, so no token is shuffled, and a lost task is
repeated alone. Windows are then dealt to step groups over all tasks: there are as many groups as GROUP_TOKENS goes into all tokens,
and the windows of each tier, numbered through all tasks by adding up each task's counts, go to the groups in turn. So groups have
the same number of windows of each tier, give or take one, and their tokens differ by less than two of the longest windows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.words import in_parts, mapped, texts
from kerbline.session import written

WINDOW = 4096
#: Words whose ids a worker remembers: tokenizing is dear, so more than other operators do.
REMEMBERED = 400_000
LEAST = 256
END_ID = 2
#: Bytes of texts whose new words are encoded together, unless one text has more.
LEARNED = 1 << 20
#: Documents whose rests are at hand at a time.
FILL_FROM = 2000
#: Tokens of a step group, about.
GROUP_TOKENS = 64 * WINDOW

#: A letter of ASCII or Latin-1 in UTF-8, which is one after any normalization.
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_unplain = re.compile(rb"['<|>]|[\x80-\xc2\xc4-\xff](?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])|\xc3[\x97\xb7]")
#: Letters in a row, or other characters, of plain words in lower case, where a byte past ASCII is of a letter.
_cut = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff ]+")
_KIND = np.array([0 if b == 32 else 1 if b >= 0x80 or 97 <= b <= 122 else 2 for b in range(256)], np.uint8)


class WordIds(dict):
    """word -> its token ids as little-endian 32-bit integers, remembered.

    The tokenizer drops white space and no token crosses it, so the ids of a text are those of its words in a row. Words of ASCII, of letters
    of Latin-1 and of marks other than ' < | > are cut further, all at once, where a token always ends: between a letter and any other
    character. Letters in a row are one word to the tokenizer, and end with a token that ends no other part: so many of them are encoded
    in one text.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Whether a token ends a word, by id.
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.pieces: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        self.learn([word])
        return self[word]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode_runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs of letters, encoded as one text and parted behind the tokens that end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(runs).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(runs):  # the tokenizer has no such tokens
            return self._encode(runs)
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, words: list[bytes]) -> None:
        """Remembers the ids of new words, encoded together."""
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        text = b" ".join(words)
        if _unplain.search(text):
            blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            odd = {words[i] for i in np.searchsorted(blanks, [m.start() for m in _unplain.finditer(text)]).tolist()}
            plain = [w for w in words if w not in odd]
            odd = list(odd)
            self.update(zip(odd, self._encode(odd), strict=True))
        else:
            plain = words
        if plain:
            self.update(zip(plain, self._learn_plain(plain), strict=True))

    def _learn_plain(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of plain words: all are cut at once, and the ids of their parts lie in one row that is parted again by the number of parts."""
        text = b" ".join(words).lower()
        parts = _cut.findall(text)
        needed = set(parts)
        if len(self.pieces) + len(needed) > REMEMBERED:
            self.pieces.clear()
        fresh = needed.difference(self.pieces)
        runs = [p for p in fresh if _KIND[p[0]] == 1]
        for some, encode in ((runs, self._encode_runs), (list(fresh.difference(runs)), self._encode)):
            if some:
                self.pieces.update(zip(some, encode(some), strict=True))
        found = list(map(self.pieces.__getitem__, parts))
        kind = _KIND[np.frombuffer(text, np.uint8)]
        starts = np.flatnonzero((kind != 0) & np.append(True, kind[1:] != kind[:-1]))
        last = np.append(np.searchsorted(starts, np.flatnonzero(kind == 0)), len(starts)) - 1
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))[last].tolist()
        data = b"".join(found)
        return (data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True))

    def documents(self, texts: list[bytes], end_id: int) -> Iterator[bytes]:
        """The ids of each text, then end_id; new words of LEARNED bytes of texts are encoded together."""
        end, at = np.array([end_id], "<u4").tobytes(), 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= LEARNED:
                size += len(texts[to])
                to += 1
            words, ends = [], [0]
            for x in texts[at:to]:
                words += x.split()
                ends.append(len(words))
            ids = list(map(self.get, words))
            unknown = [i for i, x in enumerate(ids) if x is None]
            fresh = list({words[i] for i in unknown})
            if len(fresh) > REMEMBERED // 2:
                yield from (b"".join(self._encode([x])) + end for x in texts[at:to])
            else:
                if fresh:
                    self.learn(fresh)
                for i in unknown:
                    ids[i] = self[words[i]]
                for i, j in zip(ends[:-1], ends[1:], strict=True):
                    yield b"".join(ids[i:j]) + end
            at = to

    def document(self, text: bytes, end_id: int) -> bytes:
        return next(self.documents([text], end_id))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def tier_of(length: int, least: int = LEAST) -> int:
    return max(least, 1 << (length - 1).bit_length())


class Packer:
    """Packs rests of documents, given as (length, document, start), into windows; place() is called for each piece."""

    def __init__(self, window: int, least: int, place):
        self.window, self.least, self.place = window, least, place
        self.rests: list[tuple[int, int, int]] = []
        self.n_windows = 0

    def whole(self, doc: int, length: int) -> None:
        """Whole windows of the longest tier; the rest waits."""
        at = 0
        while length - at >= self.window:
            self.put(doc, at, self.window, 0)
            self.n_windows += 1
            at += self.window
        if at < length:
            insort(self.rests, (length - at, doc, at))

    def put(self, doc: int, start: int, length: int, offset: int) -> None:
        self.place(doc, start, length, self.n_windows, offset)

    def fill(self, tier: int) -> None:
        """One window of this tier: the longest rests that fit, then a cut of the shortest."""
        offset = 0
        while offset < tier:
            at = bisect_right(self.rests, (tier - offset, 1 << 62, 0)) - 1
            if at >= 0:
                length, doc, start = self.rests.pop(at)
                self.put(doc, start, length, offset)
                offset += length
            else:
                length, doc, start = self.rests.pop(0)
                take = tier - offset
                self.put(doc, start, take, offset)
                insort(self.rests, (length - take, doc, start + take))
                offset = tier
        self.n_windows += 1

    def pack(self, close: bool) -> None:
        """Windows for all rests, longest tier first. Unless closed, too few tokens for a window of the longest tier may stay."""
        left = sum(x[0] for x in self.rests)
        while self.rests:
            tier = min(tier_of(self.rests[-1][0], self.least), self.window)
            while tier > left:
                if not close and tier > self.window // 2:
                    return
                tier //= 2
            self.fill(tier)
            left -= tier


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least: int = LEAST, end_id: int = END_ID, keep_ids: bool = True, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids), one for each piece.

    Each token id of each document (its text's ids, then end_id) is in exactly one piece; a null text gives end_id alone. The
    pieces of a sequence lie gapless from offset 0 and fill it to `tier`, a power of two of at most `window`; there is no padding.
    Repeated rows are packed each by itself; empty texts, null ids and very long texts are packed like others. ids (little-endian
    32 bits each) is null unless kept. Empty in, empty out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        encode = word_ids(tokenizer_path)
        stock: list[tuple[object, bytes, int] | None] = []
        tokens_left: list[int] = []
        rows: list[tuple] = []

        def place(doc: int, start: int, length: int, sequence: int, offset: int) -> None:
            doc_id, ids, total = stock[doc]
            piece = ids[4 * start : 4 * (start + length)]
            rows.append((doc_id, start, length, zlib.crc32(piece), total, base + sequence, offset, piece if keep_ids else None))
            tokens_left[doc] -= length
            if not tokens_left[doc]:
                stock[doc] = None

        packer = Packer(window, least, place)
        tier_at: dict[int, int] = {}
        number: dict[int, int] = {}

        def give() -> pa.RecordBatch:
            for r in rows:
                tier_at[r[5]] = tier_at.get(r[5], 0) + r[2]
            nth = {}
            for s in sorted(tier_at):
                nth[s] = number.get(tier_at[s], 0)
                number[tier_at[s]] = nth[s] + 1
            columns = list(zip(*rows, strict=True))
            rows_out = [
                pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7]),
                pa.array([tier_at[s] for s in columns[5]], pa.int32()), pa.array([nth[s] for s in columns[5]], pa.int64()), pa.array(columns[7], pa.binary()),
            ]
            rows.clear()
            tier_at.clear()
            return pa.RecordBatch.from_arrays(rows_out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "nth", "ids"])

        id_type = None
        for part in in_parts(batches, FILL_FROM):
            id_type = part.column(0).type
            for doc_id, ids in zip(part.column(0).to_pylist(), encode.documents(texts(part.column(1)), end_id), strict=True):
                stock.append((doc_id, ids, len(ids) // 4))
                tokens_left.append(len(ids) // 4)
                packer.whole(len(stock) - 1, len(ids) // 4)
            packer.pack(close=False)
            if rows:
                yield give()
            if not packer.rests:
                stock.clear()
                tokens_left.clear()
        packer.pack(close=True)
        if rows:
            yield give()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, nth long, ids binary"
    pieces = written(mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema), "pieces")
    groups = step_groups(pieces, group_tokens)
    task = F.shiftright("sequence_id", 33).alias("task")
    return pieces.select("*", task).join(groups, ["task", "tier"]).withColumn("step_group", F.pmod(F.col("nth") + F.col("begin"), F.col("n_groups"))).select(*RETURNED)


RETURNED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids")


def step_groups(pieces: DataFrame, group_tokens: int) -> DataFrame:
    """(task, tier, begin, n_groups), a row for each tier of each task: the group of its first window, if groups are given in turn."""
    made = pieces.where("offset = 0").groupBy(F.shiftright("sequence_id", 33).alias("task"), "tier").agg(F.count("*").alias("n"))
    made = written(made, "windows")
    total = made.agg(F.sum(F.col("n") * F.col("tier"))).first()[0] or 0
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return written(made.select("task", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"), F.lit(max(1, round(total / group_tokens))).cast("long").alias("n_groups")), "groups")
