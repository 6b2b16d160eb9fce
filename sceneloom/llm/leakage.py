"""Evaluation texts leaking into training text (problem 7).

A document leaks an item if it holds ``window`` consecutive words of it. The search is
a size-partitioned MinHash containment search. A short item inside a long document
has a tiny resemblance to it, so neither is sketched whole: every window of
``window`` words is one domain, the set of its five-word shingles, and its sketch is
the MinHash of that set. Two equal windows have equal sketches, so the search loses
no leak; windows that follow each other mostly share their minimum, so a text yields
few different sketches. Documents are partitioned by size: the larger the document,
the more five-word phrases it shares by chance with some item, so the more rows (hash
functions) the sketch of a larger partition has. Items are sketched once per number
of rows. Candidates are verified by exact containment of the shingles of ``window``
words, as text.

Items whose texts take at most ``broadcast_bytes`` are sent to the tasks, which then
search and verify in one pass over the documents, with no shuffle; a larger set of
items is joined with the sketches of the documents instead.

Defined results: words are runs of letters and digits after look-alikes, case and
accents are folded; a null or empty text, or one of fewer than ``window`` words,
leaks nothing; rows without id are ignored; repeated rows count once; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, join_salted
from ..runtime import checkpoint
from .words import mix, rolling, shingles, slices, word_text, words

WINDOW, SHINGLE = 10, 5
#: Documents of up to so many words have sketches of so many rows.
PARTITIONS = ((4096, 1), (1 << 62, 2))
#: Parts that the items found in one document are verified in.
ITEM_PARTS = 16
_SALT = np.uint64(0xD6E8FEB86659FD93)


def sketches(hashes: np.ndarray, text: np.ndarray, rows: int, window: int = WINDOW, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, sketch) of every window of words, without repeats."""
    at = shingles(hashes, text, window)
    if not at.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base, key = rolling(hashes, k), np.zeros(at.size, np.uint64)
    for r in range(rows):
        h = base if r == 0 else mix(base ^ (_SALT * np.uint64(r)))
        least = h[: len(h) - (window - k)].copy()
        for j in range(1, window - k + 1):
            np.minimum(least, h[j : j + len(least)], out=least)
        key = mix(key * _SALT + least[at])
    owner = text[at]
    new = np.ones(at.size, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[new], key[new]


def partitioned_sketches(hashes: np.ndarray, text: np.ndarray, count: int, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, text, sketch) for each partition by size."""
    size, low = np.bincount(text, minlength=count), 0
    for high, rows in PARTITIONS:
        mine = (size > low) & (size <= high)
        low = high
        if mine.any():
            pick = mine[text]
            yield rows, *sketches(hashes[pick], text[pick], rows, window)


class Items:
    """Items with their sketches for every number of rows, sorted for search."""

    def __init__(self, ids: list[int], texts: list[str], window: int = WINDOW) -> None:
        self.window, self.ids = window, np.array(ids, np.int64)
        hashes, owner, chars, starts = words(texts)
        self.texts = [word_text(chars[a:b]).split() for a, b in zip(starts, starts[1:])]
        self.keys = {}
        for rows in {r for _, r in PARTITIONS}:
            item, key = sketches(hashes, owner, rows, window)
            order = np.argsort(key, kind="stable")
            self.keys[rows] = key[order], item[order]

    def grams(self, item: int) -> list[str]:
        w = self.texts[item]
        return [" " + " ".join(w[i : i + self.window]) + " " for i in range(len(w) - self.window + 1)]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(number of the text, id of the item) for every leak."""
        hashes, owner, chars, starts = words(texts)
        found = set()
        for rows, text, key in partitioned_sketches(hashes, owner, len(texts), self.window):
            keys, item = self.keys[rows]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for i in np.flatnonzero(high > low):
                found.update((int(text[i]), int(x)) for x in item[low[i] : high[i]])
        at, whole = -1, ""
        for doc, item in sorted(found):
            if doc != at:
                at, whole = doc, word_text(chars[starts[doc] : starts[doc + 1]])
            if any(g in whole for g in self.grams(item)):
                yield doc, int(self.ids[item])


def _batches(batch: pa.RecordBatch, window: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch in slices of bounded size, without texts too short to matter."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    use = [i for i, (k, t) in enumerate(zip(ids, texts)) if k is not None and t is not None and len(t) >= 2 * window - 1]
    ids, texts = [ids[i] for i in use], [texts[i] for i in use]
    for a, b in slices([len(t) for t in texts]):
        yield ids[a:b], texts[a:b]


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id): the documents with the items that they leak."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    weight = held.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if weight > broadcast_bytes:
        return _joined(docs, held, window)
    # the size has just been checked
    known = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in held.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Items(*map(list, zip(*known.value)), window) if known.value else None
        for batch in batches:
            pairs = [(ids[d], i) for ids, texts in _batches(batch, window) for d, i in wanted.search(texts)] if wanted else []
            d, i = zip(*pairs) if pairs else ([], [])
            yield pa.record_batch([pa.array(d, pa.int64()), pa.array(i, pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


def _joined(docs: DataFrame, items: DataFrame, window: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same by a join of sketches, in which phrases that very many documents hold are split; pairs that share one are verified by their texts."""

    def sketched(every: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, texts in _batches(batch, window):
                    hashes, owner, _, _ = words(texts)
                    parts = [(r, *sketches(hashes, owner, r, window)) for r in sorted({r for _, r in PARTITIONS})] if every else partitioned_sketches(hashes, owner, len(texts), window)
                    for rows, who, key in parts:
                        yield pa.record_batch([pa.array(np.array(ids, np.int64)[who]), pa.array(np.full(len(who), rows, np.int32)), pa.array(key.view(np.int64))], names=["id", "rows", "sketch"])

        return run

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, asked in zip(*(batch.column(c).to_pylist() for c in range(3))):
                wanted = Items([x["item_id"] for x in asked], [x["item"] for x in asked], window)
                whole = word_text(words([text])[2])
                out += [(d, int(i)) for n, i in enumerate(wanted.ids) if any(g in whole for g in wanted.grams(n))]
            d, i = zip(*out) if out else ([], [])
            yield pa.record_batch([pa.array(d, pa.int64()), pa.array(i, pa.int64())], names=["doc_id", "item_id"])

    a = checkpoint(docs.mapInArrow(sketched(False), "id bigint, rows int, sketch bigint").withColumnRenamed("id", "doc_id"))
    b = items.mapInArrow(sketched(True), "id bigint, rows int, sketch bigint").withColumnRenamed("id", "item_id").distinct()
    pairs = join_salted(a, b, ["rows", "sketch"], hot_rows=hot_rows).select("doc_id", "item_id").distinct()
    # items are short: they travel to the documents, whose texts are moved once for all items of a part
    asked = (
        pairs.join(items.withColumnRenamed("text", "item"), "item_id")
        .groupBy("doc_id", F.pmod(F.xxhash64("item_id"), F.lit(ITEM_PARTS)).alias("part"))
        .agg(F.collect_list(F.struct("item_id", "item")).alias("asked"))
    )
    full = asked.join(docs.where("doc_id is not null and text is not null"), "doc_id").select("doc_id", "text", "asked")
    return full.mapInArrow(verify, "doc_id bigint, item_id bigint").distinct()
