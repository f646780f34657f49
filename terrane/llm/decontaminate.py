"""Benchmark decontamination with suffix arrays of the training text.

Texts are sequences of words: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, each known by a 64-bit code. Each
task cuts its training documents into shards of bounded size and builds the suffix array of each: all its places, in the order of
the words that follow (the first ``width`` words at least; by prefix doubling, places that are still tied only). All test suffixes are
then looked up at once by binary search, which gives every place where a window of ``width`` words of an item (the
whole item, if shorter) stands verbatim. Windows that follow each other on one diagonal make the longest match.

The test side is read in blocks of bounded size (``block_bytes``; in memory some five times that, as windows are places and not
words), each broadcast to the tasks for one pass
over the training text. Between two passes what was found so far is written to the checkpoint folder, so there is one
block in memory at a time. No training text is shuffled, and every training word is looked up.

Codes decide, not letters: two words of one code would be taken as equal, which for a given window of ten words needs ten
such chances of 2**-64 at once, for an item of a single word one.

Null texts have no words; a null item id counts as the string ``null``; repeated items count once by id; items
without words have no window.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import WORD_BYTES, cut, documents, flat_text, slices, word_codes

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
U = np.uint64


#: Windows that are looked up at once.
AT_ONCE = 1 << 16


@dataclass
class TestSuffixes:
    """The windows of a block of test items, each distinct one once, and where they stand in the items.

    A window is the place of its first word, so the block takes some 20 bytes a word, whatever the width.
    """

    codes: np.ndarray  # of all words, 0 after each item
    width: int
    lengths: np.ndarray  # words of each window
    spots: np.ndarray  # places among the codes, by window
    cuts: np.ndarray  # where each window's spots begin, and the end
    owner: np.ndarray  # the item of each spot
    ids: pa.Array  # of the items

    def windows(self, first: int, last: int) -> np.ndarray:
        """The words of the windows from first to before last: ``width`` columns, 0 after the end of a short one."""
        return np.stack(_columns(self.codes, self.spots[self.cuts[first:last]].astype(np.int64), self.width), axis=1)

    def items(self, windows: np.ndarray) -> set[str]:
        """Ids of the items that hold any of these windows."""
        count = np.diff(self.cuts)[windows]
        spots = np.repeat(self.cuts[windows] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return set(self.ids.take(pa.array(np.unique(self.owner[spots]))).to_pylist())


def test_suffixes(ids: list[str], texts: pa.Array, width: int) -> TestSuffixes:
    codes, owner = word_codes(*flat_text(texts))
    n = np.bincount(owner, minlength=len(ids)) - 1
    firsts = np.cumsum(n + 1) - n - 1
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    spots = np.repeat(firsts - np.cumsum(count) + count, count) + np.arange(count.sum())
    # the suffixes that are windows, in order; those alike in all their words are one window
    begins = np.zeros(len(codes), bool)
    begins[spots] = True
    order = suffix_array(codes, width)
    order = order[begins[order]]
    new, alive = np.zeros(len(order), bool), np.ones(len(order), bool)
    for i in range(width):
        word = np.where(alive, codes[np.minimum(order + i, len(codes) - 1)], U(0)) if len(order) else codes[:0]
        alive &= word != 0
        new[1:] |= word[1:] != word[:-1]
    new[:1] = True
    first = np.flatnonzero(new)
    items = owner[order]
    lengths = np.minimum(n[items[first]], width).astype(np.int32)
    return TestSuffixes(codes, width, lengths, order.astype(np.int32), np.append(first, len(order)).astype(np.int32), items.astype(np.int32), pa.array(ids, pa.string()))


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """All places in the order of the ``width`` words (or more) that follow them, up to the end of the text (0)."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.append(True, codes[order][1:] != codes[order][:-1])[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while step < width:
        # places whose group has others; the ends of texts are all alike and need no order
        again = ~new
        again[:-1] |= ~new[1:]
        open_ = np.flatnonzero(again & (codes[order] != 0))
        if not len(open_):
            break
        who = order[open_]
        after = np.where(who + step < n, rank[np.minimum(who + step, n - 1)], 0)
        by = np.lexsort((after, rank[who]))
        who, after, group = who[by], after[by], rank[who[by]]
        order[open_] = who
        split = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        new[open_] = split
        rank[who] = np.maximum.accumulate(np.where(split, open_, 0))
        step *= 2
    return order


def _columns(codes: np.ndarray, places: np.ndarray, width: int) -> list[np.ndarray]:
    """The words at 0, 1, ... after each place; 0 from the end of the text on."""
    out, alive = [], np.ones(len(places), bool)
    for i in range(width):
        word = np.where(alive & (places + i < len(codes)), codes[np.minimum(places + i, len(codes) - 1)], U(0))
        alive &= word != 0
        out.append(word)
    return out


def _bound(codes: np.ndarray, order: np.ndarray, queries: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all queries at once in a suffix array; only a query's own words count."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    while (busy := np.flatnonzero(lo < hi)).size:
        mid = (lo[busy] + hi[busy]) // 2
        at = order[mid]
        less, equal = np.zeros(len(busy), bool), np.ones(len(busy), bool)
        for i in range(queries.shape[1]):
            counts = np.flatnonzero(equal & (i < lengths[busy]))
            if not len(counts):
                break
            a, b = codes[np.minimum(at[counts] + i, len(codes) - 1)], queries[busy[counts], i]
            less[counts] = a < b
            equal[counts] = a == b
        right = less | (equal & after)
        lo[busy] = np.where(right, mid + 1, lo[busy])
        hi[busy] = np.where(right, hi[busy], mid)
    return lo


def hits(test: TestSuffixes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the shard, in order, and the windows that stand there. ``codes`` ends each text with 0."""
    places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = suffix_array(codes, test.width) if len(test.lengths) and len(codes) else codes[:0]
    for first in range(0, len(test.lengths) if len(order) else 0, AT_ONCE):
        lengths = test.lengths[first : first + AT_ONCE]
        windows = test.windows(first, first + len(lengths))
        lo = _bound(codes, order, windows, lengths, False)
        count = _bound(codes, order, windows, lengths, True) - lo
        which.append(first + np.repeat(np.arange(len(count)), count))
        places.append(order[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())])
    places, which = np.concatenate(places), np.concatenate(which)
    by = np.argsort(places, kind="stable")
    return places[by], which[by]


def longest_match(test: TestSuffixes, places: np.ndarray, which: np.ndarray) -> int:
    """Words of the longest verbatim match with any item among these hits."""
    count = np.diff(test.cuts)[which]
    spots = test.spots[np.repeat(test.cuts[which] - np.cumsum(count) + count, count) + np.arange(count.sum())].astype(np.int64)
    at = np.repeat(places, count)
    size = np.repeat(test.lengths[which], count)
    by = np.lexsort((at, at - spots))
    at, spots, size = at[by], spots[by], size[by]
    # a run: hits one word after the other on a diagonal
    new = np.append(True, (at[1:] != at[:-1] + 1) | (spots[1:] != spots[:-1] + 1))
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return int((at - at[first] + size).max())


_STATE = "doc_id long, text string, n_words long, starts array<long>, ends array<long>, items array<string>, longest long"


def _pass(shared, carried: bool):
    def of(batches):
        test = shared.value
        for batch in slices(batches, "text", SHARD_BYTES):
            codes, owner = word_codes(*flat_text(batch.column(1)))
            places, which = hits(test, codes)
            n = np.bincount(owner, minlength=batch.num_rows) - 1
            first = np.cumsum(n + 1) - n - 1
            edge = np.zeros(len(codes) + 1, np.int64)
            np.add.at(edge, places, 1)
            np.add.at(edge, places + test.lengths[which], -1)
            hit = np.cumsum(edge[:-1]) > 0
            cuts = np.searchsorted(places, np.append(first, len(codes)))
            old = {c: batch.column(c).to_pylist() for c in ("starts", "ends", "items", "longest")} if carried else None
            starts, ends, items, longest = [], [], [], []
            for d in range(batch.num_rows):
                lo, hi = cuts[d], cuts[d + 1]
                found, best, marks, spans = set(), 0, None, (np.zeros(0, np.int64), np.zeros(0, np.int64))
                if lo < hi:
                    found = test.items(np.unique(which[lo:hi]))
                    marks = hit[first[d] : first[d] + n[d]]
                    best = longest_match(test, places[lo:hi], which[lo:hi])
                if old:
                    found |= set(old["items"][d])
                    best = max(best, old["longest"][d])
                    if old["starts"][d]:
                        marks = np.zeros(n[d], bool) if marks is None else marks.copy()
                        for a, b in zip(old["starts"][d], old["ends"][d], strict=True):
                            marks[a:b] = True
                if marks is not None:
                    turn = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
                    spans = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                starts.append(spans[0])
                ends.append(spans[1])
                items.append(sorted(found))
                longest.append(best)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n), pa.array(starts, pa.list_(pa.int64())),
                    pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()),
                ],
                names=["doc_id", "text", "n_words", "starts", "ends", "items", "longest"],
            )

    return of


def test_blocks(benchmark: DataFrame, width: int, block_bytes: int, item_col: str = "item_id", text_col: str = "text"):
    """The test side, block by block; at least one."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
    volume = items.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-volume // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        yield test_suffixes(rows.column("item").to_pylist(), texts, width)


def find_matches(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Where test windows stand in each document, for every row.

    Columns: doc_id, n_words, starts and ends (runs of hit words, [start, end) in words), items (ids of the items with
    windows here, in string order), longest (words of the longest verbatim match of a window or more).
    """
    out, before = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), None
    for test in test_blocks(benchmark, width, block_bytes):
        out, before = _after(out, before)
        carried, before = before is not None, docs.sparkSession.sparkContext.broadcast(test)
        out = out.mapInArrow(_pass(before, carried), _STATE)
    return out.drop("text")


def _after(out: DataFrame, before):
    """The pass that needs the broadcast ``before``, carried out, so that its block leaves the memory."""
    if before is None:
        return out, None
    out = cut(out)
    before.unpersist()
    return out, before


def _clean(shared, text_col: str):
    def of(batches):
        for batch in slices(batches, text_col, SHARD_BYTES):
            codes, owner = word_codes(*flat_text(batch.column(batch.schema.get_field_index(text_col))))
            keep = np.ones(batch.num_rows, bool)
            keep[owner[hits(shared.value, codes)[0]]] = False
            yield batch.filter(pa.array(keep))

    return of


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no test window stands."""
    before = None
    for test in test_blocks(benchmark, width, block_bytes):
        docs, before = _after(docs, before)
        before = docs.sparkSession.sparkContext.broadcast(test)
        docs = docs.mapInArrow(_clean(before, text_col), docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda total, x: total + x)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def brute_force(docs: list[tuple], items: list[tuple], width: int = WINDOW) -> list[tuple]:
    """The same by a dictionary of windows, for tests: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def words(text):
        return (text or "").encode().translate(WORD_BYTES).split()

    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - width + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + width]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= x
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return out
