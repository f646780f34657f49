"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a document with a smaller id, or
earlier in the same one. Strings never cross documents and are judged on the input.

How it is spread out. Shipping every suffix with its context would multiply the corpus a hundredfold, so

* every window of ``width`` bytes picks an *anchor*, the place of its least hashed 32-gram. Equal windows pick equal
  anchors. A maximal run of windows with one anchor is a *phrase*: about one for 35 bytes.
* documents are dealt to blocks of bounded size by a hash of their id. In each block the suffixes that start phrases
  are put in order by deep-shallow sorting (:func:`deep_shallow`): multikey quicksort by 8-byte characters down to
  a shallow depth, then a blind trie for each group that still shares its prefix. Equal phrases are neighbours then
  and count once in their block: the first in place leads.
* blocks meet in two rounds, dealt by gram. Round one sends each distinct anchor gram of a block once and answers
  with a code for each: other blocks have it or not, and if so, with the same phrase around it (PURE) or others.
  Round two sends, with the smallest document id in the block: PURE grams; the distinct phrases of a MIXED gram, as
  bytes, whose windows the receiver compares; and where a gram has over ``hot`` distinct phrases (HOT: the edges of
  a very common passage), digests of their distinct windows, each dealt for itself. The answer says for each what an
  earlier document of another block has too.

A gram or window that a third of all documents hold is thus one entry for each block, and a receiver sees at most
``hot`` phrases of one gram. Answers are in the order of what was sent, so they take a byte or a bit each. Blocks find
their phrases anew in each round, from one shuffle of the texts: this costs less than storing them.

Bytes decide within a block and for MIXED phrases that are equal; elsewhere digests do. Phrases of a PURE gram are taken as
equal if 63 bits of digest are, besides the gram's 64; windows if 96 bits are. A wrong match has a chance of 2**-63 for
each pair of phrases that share a gram, and of n * n / 2**97 among n windows that meet (for 1e9 windows: 6e-12).

Rows without an id are documents of their own, the last in order, by a hash of their texts. Rows that share an id are
one document, in order of their texts. Null texts are empty. Texts under ``width`` bytes keep every byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import documents, flat_text, id_and_text, mix64, text_volume

GRAM = 32
SHALLOW = 48
BLOCK_BYTES = 16 << 20
CHUNK = 1 << 16
HOT_PHRASES = 2000
U = np.uint64
_B1, _B2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_rng = np.random.RandomState(7)
_TABLE = (_rng.randint(0, 2**32, 256).astype(U) << U(32)) | _rng.randint(0, 2**32, 256).astype(U)
#: Where the order of rows without an id begins; ids are taken to be less.
LATE = 1 << 62
#: Codes of round one; 0: no other block has the gram.
PURE, MIXED, HOT = 1, 2, 3


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 2**64))


_POW1, _POW2 = _powers(_B1, 4096), _powers(_B2, 4096)
_INV1, _INV2 = _powers(_inverse(_B1), 4096), _powers(_inverse(_B2), 4096)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Top 32 bits of a hash of the k bytes at every place: sums over k terms by doubling."""
    h = _TABLE[data]
    done, step = 1, 1
    parts: list[tuple[np.ndarray, int]] = []
    while step <= k:
        if k & step:
            parts.append((h, step))
        if step * 2 <= k:
            h = h[: len(h) - step] * _POW1[step] + h[step:]
        step *= 2
    n = len(data) - k + 1
    out, done = None, 0
    for part, width in reversed(parts):
        piece = part[done : done + n]
        out = piece.copy() if out is None else out * _POW1[width] + piece
        done += width
    out ^= out >> U(29)
    out *= U(0xBF58476D1CE4E5B9)
    return out >> U(32)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    step, m = 1, v
    while step * 2 <= w:
        m = np.minimum(m[: len(m) - step], m[step:])
        step *= 2
    n = len(v) - w + 1
    return np.minimum(m[:n], m[w - step : w - step + n])


def phrases(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and the anchor of every phrase, in order of place."""
    none = np.zeros(0, np.int64)
    n = len(data) - width + 1
    if n < 1:
        return none, none, none
    anchor = np.empty(n, np.int32)
    for c in range(0, n, CHUNK):
        e = min(c + CHUNK, n)
        h = _gram_hashes(data[c : e + width - 1], gram)
        v = (h << U(32)) | np.arange(len(h), dtype=U)  # the leftmost of equals wins
        anchor[c:e] = (_sliding_min(v, width - gram + 1) & U(0xFFFFFFFF)).astype(np.int64) + c
    edge = np.zeros(len(data) + 1, np.int8)
    ends = offsets[1:]
    np.add.at(edge, np.maximum(offsets[:-1], ends - width + 1), 1)
    np.add.at(edge, ends, -1)
    valid = np.cumsum(edge[:n], dtype=np.int8) == 0
    if not valid.any():
        return none, none, none
    other = np.empty(n + 1, bool)  # other[i]: windows i - 1 and i have no phrase in common
    other[0] = other[n] = True
    other[1:n] = anchor[1:] != anchor[:-1]
    other[1:n] |= ~valid[:-1]
    other[1:n] |= ~valid[1:]
    first = np.flatnonzero(valid & other[:n])
    last = np.flatnonzero(valid & other[1:])
    return first, last, anchor[first].astype(np.int64)


def _rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray | None, most: int, size: int = 0) -> np.ndarray:
    """The bytes of each string, padded with zeros to ``most``; without lengths, each has ``size`` bytes."""
    at = starts[:, None] + np.arange(most)
    np.minimum(at, len(data) - 1, out=at)
    out = data[at]
    if lengths is None:
        out[:, size:] = 0
    else:
        out[np.arange(most) >= lengths[:, None]] = 0
    return out


class BlindTrie:
    """A trie that holds branching depths and branching bytes only; strings are compared once, at a leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None
        self.same: dict[int, list[int]] = {}

    def add(self, i: int) -> None:
        strings, x = self.strings, self.strings[i]
        if self.root is None:
            self.root, self.same[i] = i, [i]
            return
        node = self.root
        while type(node) is list:  # blind: no byte between branches is looked at
            node = node[1].get(x[node[0]]) if x[node[0]] in node[1] else next(iter(node[1].values()))
        y = strings[node]
        if x == y:
            self.same[node].append(i)
            return
        self.same[i] = [i]
        bits = (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()
        depth = len(x) - (bits + 7) // 8
        parent, key, node = None, -1, self.root
        while type(node) is list and node[0] < depth:
            parent, key, node = node, x[node[0]], node[1][x[node[0]]]
        if type(node) is list and node[0] == depth:
            node[1][x[depth]] = i
            return
        branch = [depth, {y[depth]: node, x[depth]: i}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def ordered(self) -> Iterator[list[int]]:
        """Groups of equal strings, in order."""
        stack = [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield self.same[node]


def _characters(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The 8-byte character at each start, padded with zeros, as a number."""
    out = np.empty(len(starts), U)
    for c in range(0, len(starts), 1 << 17):
        at = slice(c, c + (1 << 17))
        out[at] = _rows(data, starts[at], lengths[at], 8).view(">u8").ravel()
    return out


def _multikey_quicksort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by the first ``shallow`` bytes, and by place in order where the group of strings begins that share these.

    Every group picks a pivot, the middle of three of its characters, and parts into less, equal and greater. Less and greater
    go on with the same character, equal with the next, until it has one string or is ``shallow`` deep. All groups
    are parted at once, one round after the other.
    """
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)
    at = np.arange(n) if n > 1 else np.zeros(0, np.int64)  # places that are not settled; those of a group stand together
    depth = np.zeros(len(at), np.int64)
    char = _characters(data, starts, lengths) if len(at) else np.zeros(0, U)
    while len(at):
        new = np.append(True, group[at][1:] != group[at][:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        a, b, c = char[first], char[first + size // 2], char[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        part = np.where(char < pivot, 0, np.where(char == pivot, 1, 2))
        key = np.repeat(np.arange(len(first)) * 3, size) + part
        by = np.argsort(key, kind="stable")
        order[at], char, depth, key = order[at[by]], char[by], depth[by], key[by]
        head = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(head)
        sizes = np.diff(np.append(heads, len(at)))
        group[at] = np.repeat(at[heads], sizes)
        equal = key % 3 == 1
        depth[equal] += 8
        on = (np.repeat(sizes, sizes) > 1) & (depth < shallow)
        deeper = np.flatnonzero(on & equal)
        who = order[at[deeper]]
        char[deeper] = _characters(data, starts[who] + depth[deeper], lengths[who] - depth[deeper])
        at, depth, char = at[on], depth[on], char[on]
    return order, group


def deep_shallow(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tails: np.ndarray, shallow: int = SHALLOW
) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings that start at ``starts``, and a number for each that equal strings share.

    ``tails`` (two bytes for each string) decides between strings of equal bytes. Shallow: multikey quicksort. Deep: a
    blind trie for each group that is left.
    """
    n = len(starts)
    order, group = _multikey_quicksort(data, starts, lengths, shallow)
    again = np.zeros(n, bool)
    again[1:] = group[1:] == group[:-1]
    again[:-1] |= again[1:]
    open_ = np.flatnonzero(again)
    if len(open_):
        heads = np.flatnonzero(np.append(True, group[open_][1:] != group[open_][:-1]))
        most = int(lengths[order[open_]].max())
        for lo, hi in zip(heads, np.append(heads[1:], len(open_)), strict=True):
            who = order[open_[lo:hi]]
            rest = np.concatenate([_rows(data, starts[who] + shallow, lengths[who] - shallow, most - shallow), tails[who]], axis=1)
            size, flat = rest.shape[1], rest.tobytes()
            strings = [flat[i : i + size] for i in range(0, len(flat), size)]
            trie = BlindTrie(strings)
            for i in range(len(strings)):
                trie.add(i)
            at = int(open_[lo])
            for same in trie.ordered():
                order[at : at + len(same)] = who[same]
                group[at : at + len(same)] = at
                at += len(same)
    named = np.empty(n, np.int64)
    named[order] = group
    return order, named


class _Block:
    """The phrases of one block, and where equal ones stand."""

    def __init__(self, table: pa.Table, width: int, gram: int):
        self.table = table.take(pc.sort_indices(table, sort_keys=[("nth", "ascending"), ("text", "ascending")]))
        self.ids = self.table.column("nth").to_numpy()
        self.data, self.offsets = flat_text(self.table.column("text"))
        self.width, self.gram = width, gram
        self.first, self.last, anchor = phrases(self.data, self.offsets, width, gram)
        self.into = anchor - self.first
        self.lengths = self.last - self.first + width
        self.keys, self.of, count = np.unique(self._gram_keys(anchor), return_inverse=True, return_counts=True)
        # only phrases whose gram is repeated in the block can have an equal here
        again = np.flatnonzero(count[self.of] > 1)
        tails = np.stack([self.lengths[again] - width, self.into[again]], axis=1).astype(np.uint8)
        _, named = deep_shallow(self.data, self.first[again], self.lengths[again], tails)
        by = np.argsort(named, kind="stable")
        self.is_lead = np.ones(len(self.first), bool)  # the first of its equals; places are in order
        self.is_lead[again[by[np.flatnonzero(named[by][1:] == named[by][:-1]) + 1]]] = False
        self.classes = np.bincount(self.of[self.is_lead], minlength=len(self.keys))

    def _gram_keys(self, anchor: np.ndarray) -> np.ndarray:
        out = np.empty(len(anchor), U)
        for c in range(0, len(anchor), 1 << 14):
            at = anchor[c : c + (1 << 14)]
            words = _rows(self.data, at, None, 8 * -(-self.gram // 8), self.gram).view(U)
            h = np.zeros(len(at), U)
            for w in words.T:
                h = mix64(h * _B2 + w + U(0x632BE59BD9B4E019))
            out[c : c + len(at)] = h
        return out

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.offsets, places, "right") - 1]

    def leads(self, chosen: np.ndarray) -> np.ndarray:
        """Places in the list of phrases of the leads of the chosen grams, by gram."""
        at = np.flatnonzero(self.is_lead & chosen[self.of])
        return at[np.argsort(self.of[at], kind="stable")]

    def phrase_digest(self, which: np.ndarray) -> np.ndarray:
        """63 bits of each phrase's bytes and of where its anchor is, made odd."""
        out = np.empty(len(which), U)
        most = 8 * -(-(2 * self.width - self.gram) // 8)
        for c in range(0, len(which), 1 << 13):
            at = which[c : c + (1 << 13)]
            words = _rows(self.data, self.first[at], self.lengths[at], most).view(U)
            h = mix64((self.lengths[at] * 4096 + self.into[at]).astype(U))
            for w in words.T:
                h = mix64(h * _B1 + w)
            out[c : c + len(at)] = h
        return out | U(1)

    def texts(self, which: np.ndarray) -> np.ndarray:
        """The phrases' bytes, end to end."""
        size = self.lengths[which]
        at = np.repeat(self.first[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.data[at]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return window_digests(self.data, self.first[which], (self.last - self.first)[which], self.width, self.gram)


def window_digests(data: np.ndarray, first: np.ndarray, more: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit digests and places of the windows at first, ..., first + more, for each entry in turn."""
    digests, places = [np.zeros(0, _KEY)], [np.zeros(0, np.int64)]
    most = 2 * width - gram
    for c in range(0, len(first), 1 << 12):
        at, left = first[c : c + (1 << 12)], more[c : c + (1 << 12)]
        values = _TABLE[_rows(data, at, left + width, most)]
        has = np.arange(most - width + 1) <= left[:, None]
        two = []
        for powers, inverse in ((_POW1, _INV1), (_POW2, _INV2)):
            sums = np.zeros((len(at), most + 1), U)
            np.cumsum(values * powers[:most], axis=1, out=sums[:, 1:])
            two.append(((sums[:, width:] - sums[:, :-width]) * inverse[: most - width + 1])[has])
        out = np.empty(len(two[0]), _KEY)
        out["a"], out["b"] = mix64(two[0] + U(1)), (mix64(two[1] + U(1)) >> U(32)).astype(np.uint32)
        digests.append(out)
        places.append((at[:, None] + np.arange(most - width + 1))[has])
    return np.concatenate(digests), np.concatenate(places)


_KEY = np.dtype([("a", np.uint64), ("b", np.uint32)])
_SENT = "kind int, bucket int, block int, key binary, more binary, doc binary, bytes binary"
_SENT_TYPES = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("key", "more", "doc", "bytes"))]
)
_ANSWER = "kind int, bucket int, block int, code binary"
_ANSWER_TYPES = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("code", pa.binary())])


def _deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket (keys stay in their order), the buckets met, and where each begins and the last ends."""
    bucket = ((keys["a"] if keys.dtype.names else keys) >> U(20)) % U(buckets)
    by = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1])[: len(by)])
    return by, bucket[by][at].astype(np.int32), np.append(at, len(by))


def _sent(kind: int, block: int, buckets: int, keys: np.ndarray, more=None, doc=None, text=None, sizes=None) -> pa.Table:
    """One row for each bucket that gets any keys, with what goes there as bytes."""
    by, found, cuts = _deal(keys, buckets)
    n = len(found)
    out = {c: [b""] * n for c in ("key", "more", "doc", "bytes")}
    for name, values in (("key", keys), ("more", more), ("doc", doc)):
        if values is not None:
            values = values[by]
            out[name] = [values[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    if text is not None:
        starts, size = (np.cumsum(sizes) - sizes)[by], sizes[by]
        dealt = text[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())]
        ends = np.append(0, np.cumsum(size))[cuts]
        out["bytes"] = [dealt[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"kind": [kind] * n, "bucket": found, "block": [block] * n, **out}, schema=_SENT_TYPES)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _answer(table: pa.Table, kind: int, codes: np.ndarray, sizes: np.ndarray, pack=lambda x: x) -> pa.Table:
    """Codes in the order of what was sent, a row for each row received."""
    cuts = np.append(0, np.cumsum(sizes))
    code = [pack(codes[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"kind": [kind] * len(code), "bucket": table.column("bucket"), "block": table.column("block"), "code": code}, schema=_ANSWER_TYPES)


def _counts(table: pa.Table, itemsize: int) -> np.ndarray:
    return pc.binary_length(table.column("key")).to_numpy() // itemsize


def _send_grams(width: int, gram: int, buckets: int):
    def of(key, table):
        b = _Block(table, width, gram)
        digest = b.classes.astype(U) << U(1)
        one = b.leads(b.classes == 1)
        digest[b.of[one]] = b.phrase_digest(one)
        return _sent(0, key[0].as_py(), buckets, b.keys, more=digest)

    return of


def _match_grams(hot: int):
    def of(table):
        keys = _column(table, "key", U)
        digest = _column(table, "more", U)
        by = np.argsort(keys, kind="stable")
        k, d = keys[by], digest[by]
        new = np.append(True, k[1:] != k[:-1])[: len(k)]
        group = np.cumsum(new) - 1
        odd = (d & U(1)) == 0
        classes = np.bincount(group, np.where(odd, d >> U(1), 1))
        odd[1:] |= ~new[1:] & (d[1:] != d[:-1])
        code = np.where(np.bincount(group, odd) == 0, PURE, np.where(classes <= hot, MIXED, HOT))
        code[np.bincount(group) < 2] = 0
        codes = np.empty(len(keys), np.uint8)
        codes[by] = code[group]
        return _answer(table, 0, codes, _counts(table, 8))

    return of


def _codes(answers: pa.Table, kind: int, n: int, by: np.ndarray) -> np.ndarray:
    """The answers of one kind, in the order of the block's own list."""
    mine = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("bucket")
    out = np.zeros(n, np.uint8)
    out[by] = _column(mine, "code", np.uint8)
    return out


def _first_of_each(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their smallest places."""
    by = np.lexsort((places, keys["b"], keys["a"]))
    keys, places = keys[by], places[by]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    return keys[new], places[new]


def _shared(b: _Block, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leads of PURE grams and of MIXED ones; distinct windows of HOT ones and their places."""
    code = _codes(answers, 0, len(b.keys), _deal(b.keys, buckets)[0])
    return b.leads(code == PURE), b.leads(code == MIXED), *_first_of_each(*b.windows(b.leads(code == HOT)))


def _send_phrases(width: int, gram: int, buckets: int):
    def of(key, table, answers):
        b, block = _Block(table, width, gram), key[0].as_py()
        pure, mixed, windows, places = _shared(b, answers, buckets)
        shape = np.stack([(b.last - b.first)[mixed], b.into[mixed]], axis=1).astype(np.uint8)
        return pa.concat_tables(
            [
                _sent(PURE, block, buckets, b.keys[b.of[pure]], doc=b.doc_of(b.first[pure])),
                _sent(MIXED, block, buckets, b.keys[b.of[mixed]], shape, b.doc_of(b.first[mixed]), b.texts(mixed), b.lengths[mixed]),
                _sent(HOT, block, buckets, windows, doc=b.doc_of(places)),
            ]
        )

    return of


def _later(keys: tuple[np.ndarray, ...], docs: np.ndarray) -> np.ndarray:
    """Whether an entry of the same key has a smaller document id."""
    by = np.lexsort((docs, *keys))
    same = np.ones(max(len(by) - 1, 0), bool)
    for k in keys:
        same &= k[by][1:] == k[by][:-1]
    head = np.maximum.accumulate(np.where(np.append(True, ~same)[: len(by)], np.arange(len(by)), 0))
    out = np.empty(len(by), bool)
    out[by] = docs[by] > docs[by][head]
    return out


def _match_phrases(width: int, gram: int):
    def of(key, table):
        kind, docs = key[0].as_py(), _column(table, "doc", np.int64)
        if kind == HOT:
            keys = _column(table, "key", _KEY)
            return _answer(table, kind, _later((keys["a"], keys["b"]), docs).astype(np.uint8), _counts(table, 12))
        keys = _column(table, "key", U)
        if kind == PURE:
            return _answer(table, kind, _later((keys,), docs).astype(np.uint8), _counts(table, 8))
        shape = _column(table, "more", np.uint8).reshape(-1, 2).astype(np.int64)
        data = _column(table, "bytes", np.uint8)
        lengths = shape[:, 0] + width
        starts = np.cumsum(lengths) - lengths
        # equal phrases of other blocks first: all that follow the first of them are known, without a window
        order, named = deep_shallow(data, starts, lengths, shape.astype(np.uint8))
        again = _later((named,), docs)
        first = np.flatnonzero(~again)
        digests, places = window_digests(data, starts[first], shape[first, 0], width, gram)
        n = shape[:, 0] + 1
        ends = np.cumsum(n)
        out = np.repeat(again, n)
        at = np.repeat(ends[first] - n[first] - np.cumsum(n[first]) + n[first], n[first]) + np.arange(n[first].sum())
        out[at] = _later((digests["a"], digests["b"]), np.repeat(docs[first], n[first]))
        rows = np.append(0, ends)[np.append(0, np.cumsum(_counts(table, 8)))]
        return _answer(table, kind, out, np.diff(rows), np.packbits)

    return of


def _remove(width: int, gram: int, buckets: int, whole: bool):
    def of(key, table, answers):
        b = _Block(table, width, gram)
        pure, mixed, windows, places = _shared(b, answers, buckets)
        edge = np.zeros(len(b.data) + 1, np.int32)

        def remove(first: np.ndarray, last: np.ndarray) -> None:
            np.add.at(edge, first, 1)
            np.add.at(edge, last + width, -1)

        gone = ~b.is_lead
        gone[pure] = _codes(answers, PURE, len(pure), _deal(b.keys[b.of[pure]], buckets)[0]).astype(bool)
        remove(b.first[gone], b.last[gone])
        late = places[_codes(answers, HOT, len(places), _deal(windows, buckets)[0]).astype(bool)]
        remove(late, late)
        by, _, cuts = _deal(b.keys[b.of[mixed]], buckets)
        n = (b.last - b.first)[mixed][by] + 1
        bits = answers.filter(pc.equal(answers.column("kind"), MIXED)).sort_by("bucket").column("code").to_pylist()
        sums = np.append(0, np.cumsum(n))[cuts]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=j - i) for x, i, j in zip(bits, sums[:-1], sums[1:], strict=True)]
        late = (np.repeat(b.first[mixed][by] - np.cumsum(n) + n, n) + np.arange(n.sum()))[np.concatenate([np.zeros(0, np.uint8), *flags]) > 0]
        remove(late, late)
        # windows that phrases of this block share though they differ
        digests, at = b.windows(b.leads(b.classes > 1))
        order = np.lexsort((at, digests["b"], digests["a"]))
        late = at[order[np.flatnonzero(digests[order][1:] == digests[order][:-1]) + 1]]
        remove(late, late)
        np.cumsum(edge, out=edge)
        removed = edge[:-1] > 0
        del edge
        if whole:
            _to_whole_characters(b.data, removed)
        kept, starts, ends = [], [], []
        for lo, hi in zip(b.offsets[:-1], b.offsets[1:], strict=True):
            cut = removed[lo:hi]
            turn = np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))
            starts.append(np.flatnonzero(turn == 1))
            ends.append(np.flatnonzero(turn == -1))
            kept.append((b.data[lo:hi][~cut] if len(starts[-1]) else b.data[lo:hi]).tobytes())
        if whole:
            rest = b.table.column("rest").combine_chunks().flatten()
            text = pa.array([k.decode() for k in kept], pa.string())
            text = pc.if_else(pc.is_valid(b.table.column("text").combine_chunks()), text, None)
            return pa.table([text, *rest], names=[f"c{i}" for i in range(len(rest) + 1)])
        return pa.table(
            {
                "doc_id": b.table.column("doc_id").combine_chunks(),
                "n_bytes": pa.array(np.diff(b.offsets)),
                "starts": pa.array(starts, pa.list_(pa.int64())),
                "ends": pa.array(ends, pa.list_(pa.int64())),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return of


def _to_whole_characters(data: np.ndarray, removed: np.ndarray) -> None:
    """Widen the removed runs so that no character stays in part: back to its first byte, on to its last."""
    turn = np.diff(removed.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    for _ in range(3):  # a character has three bytes at most besides the first
        starts = starts[data[starts] & 0xC0 == 0x80] - 1
        ends = ends[ends < len(data)]
        ends = ends[data[ends] & 0xC0 == 0x80]
        removed[starts] = removed[ends] = True
        ends = ends + 1


def _removed(docs: DataFrame, width: int, block_bytes: int, gram: int, hot: int, schema) -> DataFrame:
    """``docs``: doc_id, text, and rest (a struct) if whole rows are to come back."""
    if not 8 <= gram <= width or width - gram > 255 or 2 * width - gram > len(_POW1):
        raise ValueError("need 8 <= gram <= width and width - gram < 256")
    spark = docs.sparkSession
    deals, volume = int(spark.conf.get("spark.sql.shuffle.partitions")), text_volume(docs)
    blocks, buckets = max(deals, -(-volume // block_bytes)), max(deals, -(-volume // (8 * block_bytes)))
    late = F.lit(LATE) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(LATE))
    dealt = docs.withColumn("nth", F.coalesce("doc_id", late)).withColumn("block", F.pmod(F.xxhash64("nth"), F.lit(blocks)).cast("int"))
    grams = dealt.groupBy("block").applyInArrow(_send_grams(width, gram, buckets), _SENT)
    one = grams.groupBy("bucket").applyInArrow(_match_grams(hot), _ANSWER)
    sent = dealt.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(_send_phrases(width, gram, buckets), _SENT)
    two = sent.groupBy("kind", "bucket").applyInArrow(_match_phrases(width, gram), _ANSWER)
    return dealt.groupBy("block").cogroup(one.union(two).groupBy("block")).applyInArrow(
        _remove(width, gram, buckets, "rest" in docs.columns), schema
    )


def dedup_spans(
    docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, gram: int = GRAM, hot: int = HOT_PHRASES,
) -> DataFrame:
    """Each document's removed runs [starts, ends) in bytes, and the bytes that stay.

    Returns doc_id, n_bytes, starts, ends, kept (binary; it may end within a character that was cut).
    """
    return _removed(
        id_and_text(docs, id_col, text_col), width, block_bytes, gram, hot,
        "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary",
    )


def without_repeats(
    docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, gram: int = GRAM, hot: int = HOT_PHRASES,
) -> DataFrame:
    """The rows of ``docs``, all columns, their texts without the repeated bytes.

    A character of which any byte goes, goes as a whole. Null texts stay null; a text may become empty.
    """
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i + 1}") for i, c in enumerate(others)])
    got = _removed(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest")),
        width, block_bytes, gram, hot,
        T.StructType([T.StructField("c0", T.StringType()), *(T.StructField(f"c{i + 1}", docs.schema[c].dataType) for i, c in enumerate(others))]),
    )
    names = {text_col: "c0", **{c: f"c{i + 1}" for i, c in enumerate(others)}}
    return got.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    spans = dedup_spans(documents(spark, sf_dir))
    removed = F.aggregate(
        F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda total, x: total + x
    )
    return spans.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(rows: list[tuple[int, str | None]], width: int = 100) -> list[tuple[int, int, int, int, str]]:
    """The same by a dictionary of all strings, for tests: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0], (r[1] or "").encode())):
        data = (text or "").encode()
        cut = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if (s := data[p : p + width]) in seen:
                cut[p : p + width] = b"\1" * width
            seen.add(s)
        spans = sum(1 for i, c in enumerate(cut) if c and not (i and cut[i - 1]))
        kept = bytes(b for b, c in zip(data, cut, strict=True) if not c)
        out.append((doc_id, len(data), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out
