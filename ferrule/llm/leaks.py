"""Evaluation texts that leaked into documents (problem 9): a prefix-filtered set join.

A document holds 12 consecutive words of an item only if it holds all eight five-word shingles of that
window in a row, and so in particular the window's rarest one. The documents are read once: of each text
only the runs of at least eight consecutive shingles of items leave the task, with their words. Of each
item only the rarest shingles of its windows, its necessary prefixes, are joined with these runs; bounds
on length and position drop matches without room for the window; the rest is verified word by word.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import cut

WINDOW = 12
SHINGLE = 5
#: Bytes of item texts that are searched for in one pass over the documents; what a task holds of them is bounded by it.
BLOCK = 8 << 20
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|[abefnrtv0\"'\\/])")
_TAG = re.compile(r"<!--|-->|</?[A-Za-z][\w:.-]*(?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))?)*\s*/?>|<![A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after compatibility normalisation and lower-casing; the rest is layout."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "-->" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


class _Codes(dict):
    """Hashes of words, kept as long as there is room; with ``among``, 0 for all words that aren't there."""

    def __init__(self, among: np.ndarray | None = None) -> None:
        self.among = among

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        c = xxhash.xxh64_intdigest(word)
        if self.among is not None:
            k = int(np.searchsorted(self.among, np.uint64(c)))
            c = c if k < len(self.among) and int(self.among[k]) == c else 0
        self[word] = c
        return c

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def shingles(codes: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles by position, from the words' hashes."""
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h ^ codes[k : n + k]) * _PRIME
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for b in batches:
        ids, said, hashes = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ws = words(t)
            if len(ws) >= WINDOW:
                ids.append(i)
                said.append(" ".join(ws))
                hashes.append(shingles(codes.of(ws)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=["item_id", "item_words", "hashes"])


def _runs(known: np.ndarray, vocabulary: np.ndarray):
    """Runs of at least a window's shingles that are all ``known``, and, at the end, how often each known shingle was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen, least = _Codes(vocabulary), np.zeros(len(known), np.int64), WINDOW - SHINGLE + 1
        names = ["doc_id", "at", "n_words", "words", "hashes", "counts"]
        longs, texts = pa.list_(pa.int64()), pa.string()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                n = len(ws) - SHINGLE + 1
                if len(ws) < WINDOW:
                    continue
                c = codes.of(ws)
                no = np.concatenate([[0], np.cumsum(c == 0)])
                at = np.flatnonzero(no[SHINGLE:] == no[:n])  # all of its words are words of items
                if not len(at):
                    continue
                h = shingles(c)
                k = np.searchsorted(known, h[at]).clip(max=len(known) - 1)
                hit = known[k] == h[at]
                at, k = at[hit], k[hit]
                if not len(at):
                    continue
                np.add.at(seen, k, 1)
                ends = np.flatnonzero(np.append(np.diff(at) > 1, True))
                for a, z in zip(np.append(0, ends[:-1] + 1).tolist(), ends.tolist()):
                    if z - a + 1 >= least:
                        lo, hi = int(at[a]), int(at[z])
                        for x, y in zip(out, (i, lo, len(ws), " ".join(ws[lo : hi + SHINGLE]), h[lo : hi + 1])):
                            x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], texts), pa.array(out[4], longs), pa.nulls(len(out[0]), longs)], names=names
                )
        some = np.flatnonzero(seen)
        for lo in range(0, len(some), 10_000):
            k = some[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, texts), pa.array([known[k]], longs), pa.array([seen[k]], longs)], names=names
            )

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            ws, us = x.split(" "), y.split(" ")
            grams = {tuple(us[j : j + WINDOW]) for j in range(len(us) - WINDOW + 1)}
            if any(tuple(ws[j : j + WINDOW]) in grams for j in range(len(ws) - WINDOW + 1)):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["doc_id", "item_id"])


def _blocks(items: DataFrame) -> list[DataFrame]:
    """``items`` in parts of at most ``BLOCK`` bytes of text, or of a single longer text."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    n = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // BLOCK))
    while n > 1:
        of = F.pmod(F.xxhash64("item_id"), F.lit(n))
        worst = items.groupBy(of.alias("of")).agg(F.sum(size).alias("b"), F.count("*").alias("n")).where((F.col("b") > BLOCK) & (F.col("n") > 1))
        if worst.isEmpty():
            return [items.where(of == k) for k in range(n)]
        n *= 2
    return [items]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of documents that hold ``WINDOW`` consecutive words of an item.

    ``documents``: ``doc_id, text``; ``items``: ``item_id, text``; ids are unique bigints. Texts that
    are null, empty or shorter than the window match nothing. Whole texts are read. Rarity is counted
    over all documents. Documents with equal text are each reported; rows without id are left out.

    The documents are read once for every ``BLOCK`` bytes of item texts. What the tasks and the driver hold of
    a block is bounded by these bytes: its shingles and words as 64-bit numbers, and its texts in one
    broadcast. All other joins are told to sort and merge, since sizes behind Python can't be estimated.
    """
    documents = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = [_leaks_of_block(documents, block) for block in _blocks(items)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _leaks_of_block(documents: DataFrame, items: DataFrame) -> DataFrame:
    said = items.mapInArrow(_item_words, "item_id long, item_words string, hashes array<long>")
    held = said.toArrow()
    known = np.unique(np.concatenate([np.empty(0, np.int64), *(x.values.to_numpy() for x in held.column("hashes").chunks)]))
    if not len(known):
        return documents.select("doc_id", F.lit(0).cast("long").alias("item_id")).where(F.lit(False))
    vocabulary = np.unique(_Codes().of(list({w for x in held.column("item_words").to_pylist() for w in x.split(" ")})))
    passed = cut(documents.mapInArrow(_runs(known, vocabulary), "doc_id long, at int, n_words int, words string, hashes array<long>, counts array<long>"))
    counts = passed.where(F.col("doc_id").isNull()).select(F.explode(F.arrays_zip("hashes", "counts")).alias("x")).groupBy(F.col("x.hashes").alias("h")).agg(F.sum("x.counts").alias("n"))
    of_items = said.select("item_id", F.size("hashes").alias("n_hashes"), F.posexplode("hashes").alias("at", "h"))
    ranked = of_items.join(counts.hint("merge"), "h")
    # window j of an item has the shingles at j .. j + 7; the rarest (by n, then hash) is its prefix
    per_item = Window.partitionBy("item_id").orderBy("at").rangeBetween(0, WINDOW - SHINGLE)
    windows = ranked.select("item_id", "at", "n_hashes", F.min(F.struct("n", "h", "at")).over(per_item).alias("best"), F.count("*").over(per_item).alias("n_seen"))
    whole = windows.where(F.col("n_seen") == WINDOW - SHINGLE + 1)  # a shingle that no document has rules its windows out
    prefixes = whole.groupBy("item_id", F.col("best.h").alias("h"), F.col("best.at").alias("item_at")).agg(F.min("at").alias("first_window"), F.max("at").alias("last_window"))
    runs = passed.where(F.col("doc_id").isNotNull())
    places = runs.select("doc_id", "at", F.size("hashes").alias("n_hashes"), F.posexplode("hashes").alias("place", "h"))
    # the run must have room for the first or last window that this prefix stands for
    hits = places.join(prefixes.hint("merge"), "h").where(
        (F.col("place") >= F.col("item_at") - F.col("last_window")) & (F.col("n_hashes") - F.col("place") >= F.col("first_window") + WINDOW - SHINGLE + 1 - F.col("item_at"))
    )
    pairs = hits.select("doc_id", "at", "item_id").distinct()
    texts = pairs.join(runs.select("doc_id", "at", "words").hint("merge"), ["doc_id", "at"]).join(F.broadcast(said.select("item_id", "item_words")), "item_id")
    return texts.select("doc_id", "item_id", "words", "item_words").mapInArrow(_verified, "doc_id long, item_id long").distinct()
