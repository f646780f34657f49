"""Near-duplicate groups by 64-bit SimHash and deletion-variant signatures.

Two fingerprints that differ in at most two bits agree, but for one bit at most, in one of two halves. So each distinct
fingerprint is indexed under 64 signatures: each half with each of its bits wiped out. Fingerprints that share a
signature meet by an equality on it and are verified by counting the bits of their difference.

A signature that exactly two fingerprints share gives one pair. Fingerprints under busier signatures (dense groups of
near copies) are not paired with each other, which would grow with the square of the group: they are indexed
again by each value within one bit of them. Two of them differ by two bits or fewer exactly if they have such a value
in common, a value has 65 fingerprints around it at most, and linking these to their least one keeps all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import SPACED_BYTES, cut, documents, flat_text, id_and_text, in_few, mix64, slices, text_bytes, word_codes
from terrane.operators.graph import connected_components

SEED = 42
PIECE = 1 << 20


def word_pieces(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Words between ASCII white space, lower-cased (A-Z), in lists of bounded size."""
    at = 0
    while at < len(data):
        part = data[at : at + piece]
        if at + len(part) < len(data):
            cut_at = max(part.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut_at <= 0:
                nexts = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := data.find(c, at + 1)) >= 0]
                part = data[at : min(nexts, default=len(data))]
            else:
                part = part[:cut_at]
        at += len(part)
        yield part.lower().split()


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included: a bit is 1 if set in over half of the hashes."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def count(strings) -> int:
        hashes = np.fromiter((digest(s, SEED) for s in strings), np.uint64)
        np.add(ones, np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64), out=ones)
        return len(hashes)

    for words in word_pieces(data):
        words = tail + words
        if len(words) >= shingle:
            total += count(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and tail:
        total = count([b" ".join(tail)])
    bits = ones * 2 > total
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _whole(data: bytes) -> bytes:
    """Hash of the text's words one after the other, 128 bits."""
    digest = xxhash.xxh3_128(seed=SEED)
    for words in word_pieces(data):
        digest.update(b"".join(w + b" " for w in words))
    return digest.digest()


def _fingerprints(shingle: int):
    def of(batches):
        for batch in batches:
            values = [fingerprint(x, shingle) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return of


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long; 0 for null and empty texts)."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _signatures(fp: Column) -> Column:
    out = []
    for i in range(64):
        half = F.shiftrightunsigned(fp, 32 * (i // 32)).bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << i % 32)))
        out.append(half.bitwiseOR(F.lit(i << 32)))
    return F.array(*out)


def _within_one_bit(fp: Column) -> Column:
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(f)) for f in flips])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints at two or fewer differing bits; ``fps`` has them once each."""
    signed = fps.select("fp", F.explode(_signatures(F.col("fp"))).alias("signature"))
    met = signed.groupBy("signature").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    met = cut(met)
    pairs = met.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    busy = met.where("n > 2").select("signature")
    dense = signed.join(busy, "signature", "left_semi").select("fp").distinct()
    balls = (
        dense.select("fp", F.explode(_within_one_bit(F.col("fp"))).alias("value"))
        .groupBy("value").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    )
    stars = balls.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b")
    return pairs.union(stars)


def near_groups(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links of two or fewer bits reach) for every row.

    Rows with a null id take part and have a null id in the result; they name no group. Repeated ids are kept.
    """
    marked = cut(fingerprints(docs, shingle, id_col, text_col))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(fps.select("fp")))
    joined = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = joined.join(named, "root").select("fp", "component_id")
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id")


#: Words' bytes: A-Z lower-cased, white space as blanks.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b for b in SPACED_BYTES)
#: A shingle is hot if it is among the least ones of more texts than this. It says which of two exact ways finds a pair.
HOT = 16
#: So many ids at most (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of each text, and where each text's begin; every text has one at least."""
    codes, owner = word_codes(data, offsets, _WORDS)
    n = len(offsets) - 1
    size = np.bincount(owner, minlength=n) - 1  # words
    count = np.maximum(size - shingle + 1, 1)
    first = np.cumsum(size + 1) - size - 1
    begin = np.cumsum(count) - count
    at = np.repeat(first - begin, count) + np.arange(count.sum())
    out, alive = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    for i in range(shingle):  # a short text's only shingle ends where the text does
        word = np.where(alive, codes[np.minimum(at + i, len(codes) - 1)], np.uint64(0))
        alive &= word != 0
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out, begin


def _prefix(size, least: float):
    """So many of a set's tokens, in any order of all tokens: two sets as alike as ``least`` share one of these."""
    return np.floor(size * (1 - least) + 1e-6).astype(np.int64) + 1


def _sent(size, least: float):
    """Tokens that a set sends: its prefix, and a quarter more to stand in for hot ones."""
    prefix = _prefix(size, least)
    return np.minimum(size, prefix + prefix // 4 + 2)


def _spare(size, least: float):
    """Hot tokens that may be among the sent ones of a text: with as many or fewer, none of its pairs needs a hot token.

    Of the sent tokens of a text of this size and of an alike text (of at least ``least`` of its size), more than its
    prefix are cold then, so all of them cannot be missing in the other.
    """
    smallest = np.ceil(size * least - 1e-6).astype(np.int64)
    return _sent(smallest, least) - _prefix(smallest, least)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, from the highest to the lowest."""
    return np.unpackbits(hashes.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _marks(shingle: int, least: float):
    def of(batches):
        for batch in slices(batches, "text", 1 << 20):
            hashes, begin = shingle_hashes(*flat_text(batch.column(2)), shingle)
            sets = [np.unique(x) for x in np.split(hashes.view(np.int64), begin[1:])]
            sizes = np.array([len(x) for x in sets], np.int64)
            fps = np.packbits([_ones(x) * 2 > len(x) for x in sets], axis=1).view(">i8").ravel().astype(np.int64)
            sent = _sent(sizes, least)
            offsets = np.append(0, np.cumsum(sent)).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[:n] for x, n in zip(sets, sent, strict=True)])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([_whole(x) for x in text_bytes(batch.column(2))], pa.binary()),
                    pa.array(fps), pa.array(sizes), pa.array(sent),
                    pa.array(_spare(sizes, least)), tokens,
                ],
                names=["doc_id", "h", "whole", "fp", "size", "sent", "spare", "tokens"],
            )

    return of


_MARKS = "doc_id long, h long, whole binary, fp long, size long, sent long, spare long, tokens array<long>"


def jaccard(a: bytes, b: bytes, shingle: int) -> float:
    """Likeness of two texts: shared distinct word shingles of all; texts of fewer words are one shingle each."""

    def shingles(data: bytes) -> set[bytes]:
        words = data.lower().split()
        if len(words) < shingle:
            return {b" ".join(words)}
        return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))

    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _alike(shingle: int, least: float):
    def of(batches):
        for batch in batches:
            texts = zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([jaccard(a, b, shingle) >= least for a, b in texts], pa.bool_())],
                names=["a", "b", "alike"],
            )

    return of


def _sizes_allow(x: Column, y: Column, least: float) -> Column:
    """Whether sets of these sizes can be as alike as ``least``: at most the smaller is shared, at least the larger is the union."""
    return F.least(x, y) >= least * F.greatest(x, y) - 1e-6


def _checked(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if they are few enough."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts are alike; ``texts``: doc_id, text, one for each node."""
    pairs = cut(pairs)
    n = pairs.count()
    texted = in_few(pairs, n).join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("one")), "a")
    texted = in_few(texted, n, 1000).join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b")
    texted = in_few(texted.select("a", "b", "one", "other"), n, 1000)
    return cut(texted.mapInArrow(_alike(shingle, least), "a long, b long, alike boolean").where("alike").select("a", "b"))


def signature_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are at most two bits apart, or that a third one links: see :func:`links`."""
    first = cut(classes.groupBy("fp").agg(F.min("node").alias("least")))
    same = classes.join(first, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    of = lambda name: first.select(F.col("fp").alias(name), F.col("least").alias(f"{name}_node"))
    near = links(first.select("fp")).join(of("a"), "a").join(of("b"), "b")
    return same.union(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def cold_pairs(state: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that share a cold token and can be alike. ``state``: token, node, size, sent, top, n, hot.

    Up to the smaller of the greatest tokens sent, all tokens of both are sent; they share the cold ones counted and at
    most as many hot ones as either has there. Beyond, the one of the smaller greatest token has ``size - sent`` left.
    """
    cold = state.where(F.col("n") <= HOT)
    row = ["node", "size", "sent", "top", "hot"]
    other = cold.select("token", *[F.col(c).alias(f"{c}_2") for c in row])
    met = cold.select("token", *row).join(other, "token").where("node < node_2").where(_sizes_allow(F.col("size"), F.col("size_2"), least))
    counted = met.groupBy(*row, *[f"{c}_2" for c in row]).agg(F.count("*").alias("c"))
    rest = F.when(F.col("top") <= F.col("top_2"), F.col("size") - F.col("sent")).otherwise(F.col("size_2") - F.col("sent_2"))
    shared = F.col("c") + F.least("hot", "hot_2") + rest
    able = shared >= least / (1 + least) * (F.col("size") + F.col("size_2")) - 1e-6
    return counted.where(able).select(F.col("node").alias("a"), F.col("node_2").alias("b"))


def head_pairs(state: DataFrame, least: float) -> DataFrame:
    """A pair for each node with too many hot tokens: itself and the head of most of these.

    A token's head is the node whose tokens are shared most: the original of a group of copies, as a rule.
    """
    score = state.groupBy("node").agg(F.sum("n").alias("score"))
    hot = state.where((F.col("n") > HOT) & (F.col("hot") > F.col("spare"))).join(score, "node")
    heads = hot.groupBy("token").agg(F.max(F.struct("score", -F.col("node"), "node", "size")).alias("h"))
    votes = hot.join(heads.select("token", F.col("h.node").alias("head"), F.col("h.size").alias("head_size")), "token")
    votes = votes.where("node <> head").where(_sizes_allow(F.col("size"), F.col("head_size"), least))
    best = votes.groupBy("node", "head").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", -F.col("head"), "head")).alias("h"))
    return best.select(F.col("node").alias("a"), F.col("h.head").alias("b"))


#: Least hashes of a band, and the chance that a pair as alike as ``least`` shares no band at all.
BAND_ROWS, MISS = 12, 1e-9
_HASHES_AT_ONCE = 1 << 20


def band_count(least: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands so that two sets of likeness ``least`` share none with a chance of ``miss`` at most."""
    return int(np.ceil(np.log(miss) / np.log1p(-(least**rows)))) if least < 1 else 1


def band_keys(tokens: np.ndarray, bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for each band of a set of hashes: its ``rows`` least hashes by as many functions of the band's own, put together."""
    seeds = mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).reshape(2, -1)
    add, times = seeds[0], seeds[1] | np.uint64(1)
    least = np.full(bands * rows, ~np.uint64(0))
    step = max(1, _HASHES_AT_ONCE // len(least))
    for at in range(0, len(tokens), step):
        np.minimum(least, ((tokens[at : at + step, None] ^ add) * times).min(axis=0), out=least)
    keys = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(rows, bands):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys


#: 64-bit words of a set's parities.
PARITY_LONGS = 8


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """For each of 512 classes of hashes whether the set has an odd number of them. Two sets differ in as many tokens as bits at least."""
    odd = np.bincount((tokens >> np.uint64(55)).astype(np.int64), minlength=64 * PARITY_LONGS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _banded(shingle: int, least: float):
    def of(batches):
        bands = band_count(least)
        for batch in batches:
            for part in slices(iter([batch]), "text", 1 << 20):
                hashes, begin = shingle_hashes(*flat_text(part.column(1)), shingle)
                sets = [np.unique(x) for x in np.split(hashes, begin[1:])]
                keys = np.concatenate([band_keys(x, bands) for x in sets]).view(np.int64)
                lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n), pa.array(values))
                bits = np.concatenate([parity_bits(x) for x in sets])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), lists(keys, bands), lists(bits, PARITY_LONGS)], names=["node", "size", "keys", "bits"])

    return of


def _distinct_shingles(shingle: int):
    def of(batches):
        for batch in batches:
            for part in slices(iter([batch]), "text", 1 << 20):
                hashes, begin = shingle_hashes(*flat_text(part.column(1)), shingle)
                sets = [np.unique(x) for x in np.split(hashes, begin[1:])]
                nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "token"])

    return of


def band_pairs(texts: DataFrame, roots: DataFrame, shingle: int, least: float) -> DataFrame:
    """Pairs (a, b) of ``texts`` (doc_id, text) that share a band and that ``roots`` (node, root) does not connect yet.

    A band is a key of twelve least hashes. Texts of one pool of sentences, which share each of their shingles with most others, share
    hardly any band (at a likeness of 0.4, one pair in 200 does), so what is compared does not grow with the square of
    a crowd. Copies of one text that are all somewhat less alike than ``least`` share bands, but each has shingles of its own: what
    a text shares with another is at most what it shares with any, and sets differ in as many tokens at least as parities of theirs
    do; both rule such pairs out before they are made, and no others. A pair of likeness ``least`` shares no band with a chance of :data:`MISS`, one that is more alike with a lesser one.
    """
    marked = cut(texts.mapInArrow(_banded(shingle, least), "node long, size long, keys array<long>, bits array<long>").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    banded = marked.select("node", "size", "root", F.explode("keys").alias("key"))
    # the members of a key's commonest component are met by the others only, not by each other
    per = banded.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    mixed = cut(banded.join(per.where("roots > 1").select("key", "main"), "key"))
    # what a text has in common with any other of these: its shingles that one of them has, too
    some = _checked(mixed.select(F.col("node").alias("doc_id")).distinct())
    tokens = texts.join(some, "doc_id", "left_semi").mapInArrow(_distinct_shingles(shingle), "node long, token long")
    met_again = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    common = tokens.join(met_again, "token").groupBy("node").agg(F.count("*").alias("common"))
    about = cut(common.join(marked.select("node", "size", "bits"), "node").where(F.col("common") >= least * F.col("size") - 1e-6).select("node", "common", "bits"))
    able = mixed.join(F.broadcast(about) if about.count() <= MOST_BROADCAST // 10 else about, "node")
    x, y = able.where("root <> main").alias("x"), able.alias("y")
    shared = F.least(F.col("x.common"), F.col("y.common"))
    enough = shared >= least / (1 + least) * F.expr("x.size + y.size") - 1e-6
    differ = sum((F.bit_count(F.get("x.bits", F.lit(i)).bitwiseXOR(F.get("y.bits", F.lit(i)))) for i in range(PARITY_LONGS)), F.lit(0))
    near = differ <= (1 - least) / (1 + least) * F.expr("x.size + y.size") + 1e-6
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & F.expr("x.root <> y.root") & _sizes_allow(F.col("x.size"), F.col("y.size"), least) & enough & near)
    pairs = met.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("bands"))


def alike_links(classes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges (a, b) whose components are those of all alike pairs.

    ``classes``: node, h, fp, size, sent, spare, tokens, once for each text. ``texts``: doc_id, h, text.

    1. Fingerprints within two bits, by their deletion variants.
    2. Pairs that share a cold token among those sent. A text all but a few of whose sent tokens are cold has its pairs here.
    3. For the others, which have a hot token in common: each is compared with one head, which connects most of a large
       group of copies at a comparison each; what is not connected meets by :func:`band_pairs`, each text with its nearest first.
    """
    sent = classes.select("node", F.explode("tokens").alias("token"))
    shared = sent.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    state = cut(sent.join(shared, "token"))
    hot = state.groupBy("node").agg(F.count_if(F.col("n") > HOT).alias("hot"))
    about = classes.select("node", "size", "sent", "spare", F.element_at("tokens", -1).alias("top"))
    state = cut(state.join(hot.join(about, "node"), "node"))
    pairs = signature_pairs(classes).union(cold_pairs(state, least)).union(head_pairs(state, least))
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    dense = cut(state.where("hot > spare").select("node").distinct())
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(dense).distinct()
    used = _checked(classes.select(F.col("node").alias("doc_id"), "h").join(used.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"))
    texts = cut(texts.join(used, ["doc_id", "h"]).groupBy("doc_id").agg(F.first("text").alias("text")))
    found = _compared(pairs, texts, shingle, least)
    if not dense.count():
        return found
    roots = connected_components(found)
    stars = cut(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    dense_texts = texts.join(dense.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    across = cut(band_pairs(dense_texts, roots, shingle, least))
    # each text with the one that it shares most bands with first: what that connects need not be compared pair by pair
    both = across.union(across.select("b", "a", "bands"))
    nearest = both.groupBy("a").agg(F.max_by("b", F.struct("bands", "b")).alias("b"))
    first = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = cut(stars.union(_compared(first, texts, shingle, least)))
    roots = connected_components(stars)
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    apart = across.join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = apart.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).join(first, ["a", "b"], "left_anti")
    return stars.union(_compared(apart.select("a", "b"), texts, shingle, least))


def without_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one document of each group of near copies: the one with the least id.

    Groups are connected by likeness of ``least`` or more (Jaccard of word shingles, checked on the whole texts); texts of
    the same words are copies at once. First candidates are those whose SimHashes (of distinct shingles) are within two
    bits, by deletion variants. Most texts that are 0.8 alike are further apart, and SimHashes rule none out, so an exact
    join on the least hashed shingles of each text gives the rest, but for pairs that share nothing but what
    crowds of texts share too: those meet by bands of least hashes, which miss a pair with a chance of :data:`MISS`.

    Rows that share an id are one document and stay or go together; of several texts, the one with the least
    ``xxhash64`` is its text. Rows without an id stay and take no part. Null texts are empty and copies of each other.
    """
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    marks = cut(texts.mapInArrow(_marks(shingle, least), _MARKS).withColumn("row", F.monotonically_increasing_id()))
    of_id = marks.groupBy("doc_id").agg(F.min(F.struct("h", "row", "whole")).alias("m")).select("doc_id", "m.h", "m.row", "m.whole")
    of_id = cut(of_id)
    per = cut(of_id.groupBy("whole").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("whole", F.col("m.doc_id").alias("node"), "m.row"))
    others = _checked(marks.select("row").join(per, "row", "left_anti"))
    classes = marks.join(others, "row", "left_anti").withColumnRenamed("doc_id", "node").drop("whole", "row")
    roots = connected_components(alike_links(classes, texts, shingle, least))
    stays = per.select("whole", "node").join(roots, "node", "left").select("whole", F.coalesce("root", "node").alias("stays"))
    gone = _checked(of_id.join(stays, "whole").where("doc_id <> stays").select(F.col("doc_id").alias(id_col)))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
