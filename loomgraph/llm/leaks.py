"""Evaluation items in training text: an FM-index of every shard, searched backwards for the items' phrases.

Texts are sequences of normalised words, numbered by shard. The index is a Burrows-Wheeler transform in full
suffix order with ranks from a wavelet tree and the text positions of every SAMPLE-th word; it can be stored
beside its shard and searched for other items later. A stretch with at most one changed or inserted word in any
ten has nine words in sequence, so phrases of nine words find all; each place found is then followed word by
word in both directions.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASE = 9
SPACING = 10  # at most one change in so many words
SHARD_WORDS = 1_000_000
SAMPLE = 16  # one in so many text positions is kept
ITEM_BLOCK = 20_000  # items that go to the tasks together

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = str.maketrans(
    "абвгдеёзіїјкмнорсстухѕԁһԛԝАВЕІЈКМНОРСТУХЅαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ",
    "a6brdeё3iijkmhopcctyxsdhqwABEIJKMHOPCTYXSaBeikvoptuxABEZHIKMNOPTYXiag",
)
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%([2-7][0-9A-F])|\\([nrt])")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _plain(text: str) -> str:
    if "\\" in text or "%" in text:
        text = _ESCAPE.sub(lambda m: " " if m[4] else chr(int(m[1] or m[2] or m[3], 16)), text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text).translate(_LOOK_ALIKES))
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return text.casefold().replace("’", "'")


def normal_words(text: str | None) -> tuple[list[str], list[bool]]:
    """The words without case, marks, escapes and look-alikes; whether each begins a written word."""
    words, first, end = [], [], -2
    plain = _plain(text or "")
    for m in _WORD.finditer(plain):
        words.append(m.group().replace("'", ""))
        first.append(not (end >= 0 and m.start() == end + 1 and plain[end] in "-‐/"))
        end = m.end()
    return words, first


def plain_words(text: str) -> list[str]:
    plain = _plain(text)
    words = _WORD.findall(plain)
    return [w.replace("'", "") for w in words] if "'" in plain else words


class Items:
    """What is searched for: passages and questions, and the phrases that every stretch of them has one of.

    A question of ten to eighteen words is searched for by half its words, as one of them may be changed.
    """

    def __init__(self, rows: list[tuple[int, str | None, str | None]]) -> None:
        self.texts: list[tuple[int, bool, np.ndarray]] = []
        self.coded: list[np.ndarray] = []
        numbers: dict[str, int] = {}
        places: dict[int, list[tuple[int, int]]] = {}
        for item, passage, question in rows:
            for whole, text in ((False, passage), (True, question)):
                words, first = normal_words(text)
                if not words:
                    continue
                size = min(PHRASE, len(words) // 2) if whole and len(words) >= SPACING else min(PHRASE, len(words))
                places.setdefault(size, []).extend((len(self.texts), at) for at in range(len(words) - size + 1))
                self.texts.append((item, whole, np.concatenate([[0], np.cumsum(first)])))
                self.coded.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
        self.words = list(numbers)
        flat = np.concatenate(self.coded) if self.coded else np.zeros(0, np.int64)
        start = np.concatenate([[0], np.cumsum([len(c) for c in self.coded])])
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, own in sorted(places.items()):
            place = np.array(own, np.int64)
            rows_of = flat[(start[place[:, 0]] + place[:, 1])[:, None] + np.arange(size)]
            phrases, inverse = np.unique(rows_of, axis=0, return_inverse=True)
            order = np.argsort(inverse.ravel(), kind="stable")
            self.by_size[size] = (phrases, place[order], np.searchsorted(inverse.ravel()[order], np.arange(len(phrases) + 1)))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in their order; ranks are refined by doubled depths where they still tie."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], text[order][1:] != text[order][:-1]]))
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    tied, step = order[np.repeat(sizes, sizes) > 1], 1
    while len(tied):
        key = rank[tied]
        after = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        by = np.lexsort((after, key))
        tied, key, after = tied[by], key[by], after[by]
        group = np.concatenate([[True], key[1:] != key[:-1]])
        part = group | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(tied))
        slot = key + at - np.repeat(np.flatnonzero(group), np.diff(np.append(np.flatnonzero(group), len(tied))))
        sizes = np.diff(np.append(np.flatnonzero(part), len(tied)))
        rank[tied] = np.repeat(slot[part], sizes)
        tied, step = tied[np.repeat(sizes, sizes) > 1], step * 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Index:
    """FM-index of a sequence of word numbers from 1 on; its end is number 0 and stands nowhere else."""

    def __init__(self, text: np.ndarray) -> None:
        text = np.append(text, 0)
        order = suffix_order(text)
        rows = text[order - 1]
        self.n, self.levels = len(text), max(1, int(text.max(initial=0)).bit_length())
        self.counts = np.bincount(text, minlength=1 << self.levels)
        bits = []
        for level in reversed(range(self.levels)):
            bit = ((rows >> level) & 1).astype(bool)
            bits.append(bit)
            rows = np.concatenate([rows[~bit], rows[bit]])
        marked = order % SAMPLE == 0
        self._ready(bits, marked, order[marked])

    def _ready(self, bits: list[np.ndarray], marked: np.ndarray, samples: np.ndarray) -> None:
        self.before = np.concatenate([[0], np.cumsum(self.counts)])
        self.bits, self.marked, self.samples = bits, marked, samples.astype(np.int32)
        self.ones = [np.concatenate([[0], np.cumsum(b)]).astype(np.int32) for b in bits]
        self.zeros = [self.n - int(o[-1]) for o in self.ones]
        self.sampled = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)

    def pack(self) -> dict[str, bytes]:
        """Bits and samples alone; ranks are counted again by unpack."""
        return {
            "bits": np.packbits(np.concatenate([*self.bits, self.marked])).tobytes(), "counts": self.counts.astype(np.int32).tobytes(), "samples": self.samples.tobytes()
        }

    @classmethod
    def unpack(cls, bits: bytes, counts: bytes, samples: bytes) -> Index:
        index = cls.__new__(cls)
        index.counts = np.frombuffer(counts, np.int32).astype(np.int64)
        index.n, index.levels = int(index.counts.sum()), len(index.counts).bit_length() - 1
        rows = np.unpackbits(np.frombuffer(bits, np.uint8), count=index.n * (index.levels + 1)).astype(bool).reshape(-1, index.n)
        index._ready(list(rows[:-1]), rows[-1], np.frombuffer(samples, np.int32))
        return index

    def rank(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each word stands before row at of the transform."""
        at, start = at.copy(), np.zeros_like(at)
        for k, level in enumerate(reversed(range(self.levels))):
            bit = ((word >> level) & 1).astype(bool)
            ones_at, ones_start = self.ones[k][at], self.ones[k][start]
            at = np.where(bit, self.zeros[k] + ones_at, at - ones_at)
            start = np.where(bit, self.zeros[k] + ones_start, start - ones_start)
        return at - start

    def word(self, rows: np.ndarray) -> np.ndarray:
        """The words of the transform at rows: those before the suffixes."""
        at, out = rows.copy(), np.zeros_like(rows)
        for k in range(self.levels):
            bit = self.bits[k][at]
            out = out * 2 + bit
            at = np.where(bit, self.zeros[k] + self.ones[k][at], at - self.ones[k][at])
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows from low to high of the suffixes that begin with each phrase; all words must be of the text."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            word = phrases[live, k]
            low[live] = self.before[word] + self.rank(word, low[live])
            high[live] = self.before[word] + self.rank(word, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions: back from word to word to the next that is kept."""
        at, out = rows.astype(np.int64).copy(), np.full(len(rows), -1, np.int64)
        open_rows, steps = np.arange(len(rows)), 0
        while len(open_rows):
            kept = self.marked[at[open_rows]]
            here = open_rows[kept]
            out[here] = self.samples[self.sampled[at[here]]] + steps
            open_rows, steps = open_rows[~kept], steps + 1
            word = self.word(at[open_rows])
            at[open_rows] = self.before[word] + self.rank(word, at[open_rows])
        return out


def _follow(item: np.ndarray, text: np.ndarray, i: int, j: int, step: int, room: int) -> tuple[int, int, int]:
    """From matched words i and j on in one direction: (last item word, last text word, changes).

    room is the number of words matched since the last change. A change is passed if at least SPACING - 1
    words were matched since the last one and more follow; of a changed or an inserted word the way that
    matches farthest is taken. A missing word ends the stretch.
    """
    changes = 0

    def run(a: int, b: int) -> int:
        n = 0
        while 0 <= a < len(item) and 0 <= b < len(text) and item[a] == text[b]:
            a, b, n = a + step, b + step, n + 1
        return n

    while True:
        n = run(i + step, j + step)
        i, j, room = i + n * step, j + n * step, room + n
        if room < SPACING - 1:
            return i, j, changes
        ways = [(run(i + 2 * step, j + 2 * step), 2, 2), (run(i + step, j + 2 * step), 1, 2)]
        best = max(ways, key=lambda w: w[0])
        if best[0] < 1:
            return i, j, changes
        i, j, room, changes = i + best[1] * step, j + best[2] * step, 1, changes + 1


def _stretch(item: np.ndarray, text: np.ndarray, i: int, j: int, size: int) -> list[tuple[int, int, int, int]]:
    """Longest stretches through item[i:i + size] == text[j:j + size], as (item from, to, text from, to)."""
    a, b, n = i, j, size
    while a and b and item[a - 1] == text[b - 1]:
        a, b, n = a - 1, b - 1, n + 1
    while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n]:
        n += 1
    out = []
    for left, right in ((n, n),) if n >= SPACING - 1 else ((SPACING, 0), (0, SPACING)):
        i0, j0, _ = _follow(item, text, a, b, -1, left) if left >= SPACING - 1 else (a, b, 0)
        i1, j1, _ = _follow(item, text, a + n - 1, b + n - 1, 1, right) if right >= SPACING - 1 else (a + n - 1, b + n - 1, 0)
        out.append((i0, i1 + 1, j0, j1 + 1))
    return out


class Shard:
    """Documents with the index of their words. Words are numbered from 2 on, 1 ends a document."""

    def __init__(self, ids: list[int], texts: list[list[str]]) -> None:
        numbers: dict[str, int] = {}
        coded = [[numbers.setdefault(w, len(numbers) + 2) for w in words] + [1] for words in texts]
        self.ids, self.words = np.array(ids, np.int64), list(numbers)
        self.starts = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
        self.text = np.array([w for c in coded for w in c], np.int32)
        self.index = Index(self.text.astype(np.int64))

    def pack(self) -> dict[str, bytes | str]:
        return {"doc_ids": self.ids.tobytes(), "starts": self.starts.astype(np.int64).tobytes(), "words": " ".join(self.words), "text": self.text.tobytes(), **self.index.pack()}

    @classmethod
    def unpack(cls, row) -> Shard:
        shard = cls.__new__(cls)
        shard.ids, shard.starts = np.frombuffer(row.doc_ids, np.int64), np.frombuffer(row.starts, np.int64)
        shard.words, shard.text = row.words.split(" "), np.frombuffer(row.text, np.int32)
        shard.index = Index.unpack(row.bits, row.counts, row.samples)
        return shard


INDEX = "doc_ids binary, starts binary, words string, text binary, bits binary, counts binary, samples binary"


def find_leaks(items: Items, shard: Shard, least_words: int = 20) -> list[tuple[int, int, str, int, int]]:
    """(item, document, part, first word, word after the last) of all stretches in one shard."""
    numbers = {w: i + 2 for i, w in enumerate(shard.words)}
    to = np.array([numbers.get(w, -1) for w in items.words], np.int64)
    index, starts, coded, out = shard.index, shard.starts, {}, set()
    for phrases, places, bounds in items.by_size.values():
        own = to[phrases]
        known = np.flatnonzero((own >= 0).all(1))
        low, high = index.search(own[known])
        hits = np.repeat(known, high - low)
        if not len(hits):
            continue
        at = index.locate(np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if b > a]))
        docs = np.searchsorted(starts, at, side="right") - 1
        done: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for hit, doc, j in sorted(zip(hits.tolist(), docs.tolist(), (at - starts[docs]).tolist(), strict=True)):
            for number, i in places[bounds[hit] : bounds[hit + 1]].tolist():
                followed = done.setdefault((doc, number), [])
                # A place within a stretch that was followed on the same diagonal gives that stretch again.
                if any(j0 <= j < j1 and abs((j - i) - shift) <= 3 for j0, j1, shift in followed):
                    continue
                item, whole, written = items.texts[number]
                if number not in coded:
                    coded[number] = to[items.coded[number]]
                words = coded[number]
                for i0, i1, j0, j1 in _stretch(words, shard.text[starts[doc] : starts[doc + 1] - 1], i, j, phrases.shape[1]):
                    followed.append((j0, j1, j0 - i0))
                    if whole:
                        edge = (i0 > 0) + (i1 < len(words))
                        good = i0 <= 1 and i1 >= len(words) - 1 and edge <= 1 + (len(words) > SPACING)
                    else:
                        good = written[i1] - written[i0] >= least_words
                    if good:
                        out.add((item, int(shard.ids[doc]), "question" if whole else "passage", j0, j1))
    return sorted(out)


def index_shards(documents: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each shard of about shard_words words: its documents and their index, to be written or searched.

    Shards do not cross partitions. Null doc_ids, null texts and texts without words are in none.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        texts: list[list[str]] = []
        size = 0
        for pdf in batches:
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                if words := plain_words(text):
                    ids.append(doc)
                    texts.append(words)
                    size += len(words)
                    if size >= shard_words:
                        yield pd.DataFrame([Shard(ids, texts).pack()])
                        ids, texts, size = [], [], 0
        if ids:
            yield pd.DataFrame([Shard(ids, texts).pack()])

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(build, INDEX)


def without_openings(items: DataFrame, least: int = 3) -> DataFrame:
    """(item_id, passage, question) without first sentences that at least so many questions begin with."""
    first = F.regexp_extract("question", r"(?s)\A(.+?[.:!\n])\s*\S", 1)
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", "passage", "question", F.when(first != "", first).alias("opening"))
    shared = rows.where("opening IS NOT NULL").groupBy("opening").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    own = F.when(F.col("n").isNotNull(), F.expr("substring(question, length(opening) + 1)")).otherwise(F.col("question"))
    return rows.join(shared, "opening", "left").select("item_id", "passage", own.alias("question"))


def search_index(index: DataFrame, items: DataFrame, least_words: int = 20, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, doc_id, part, first_word, end_word): stretches of items in indexed documents, in words of the text.

    A passage counts from least_words written words in sequence, a question when whole apart from its
    shared opening; at most one changed or inserted word in any ten is passed over. Items go to the tasks in
    blocks of about item_block, and every shard is read once for all of them.
    """
    rows = without_openings(items)
    blocks = max(1, -(-rows.count() // item_block))
    sent = []
    for b in range(blocks):
        own = sorted((tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()), key=lambda r: r[0])
        sent.append(index.sparkSession.sparkContext.broadcast(Items(own)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                shard = Shard.unpack(row)
                for items_block in sent:
                    yield pd.DataFrame(find_leaks(items_block.value, shard, least_words), columns=["item_id", "doc_id", "part", "first_word", "end_word"])

    return index.mapInPandas(search, "item_id bigint, doc_id bigint, part string, first_word int, end_word int")


def leaked_spans(documents: DataFrame, items: DataFrame, least_words: int = 20) -> DataFrame:
    """search_index over the documents, whose shards are indexed on the way. Null and empty texts hold nothing."""
    return search_index(index_shards(documents), items, least_words)


def leaked_items(documents: DataFrame, items: DataFrame, least_words: int = 20) -> DataFrame:
    """(item_id, doc_id), once each."""
    return leaked_spans(documents, items, least_words).select("item_id", "doc_id").distinct()


def removal_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, items): overlapping or touching stretches of a document as one."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("first_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("_new", F.coalesce(F.col("first_word") > before, F.lit(True)).cast("int"))
    numbered = numbered.withColumn("_span", F.sum("_new").over(order))
    return numbered.groupBy("doc_id", "_span").agg(
        F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.sort_array(F.collect_set("item_id")).alias("items")
    ).drop("_span")
