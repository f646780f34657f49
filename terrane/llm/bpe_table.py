"""Encoding and decoding with a BPE tokenizer through a table of distinct words.

Texts are split at ASCII white space. That is safe for a tokenizer whose words never hold white space (checked on the
file: see :func:`checked`): a text's ids are then those of its words, one after the other.

A task gives the distinct words of each block of its texts, dealt to buckets by their hash. In a bucket all blocks' words
meet; each distinct one is encoded once, and its ids go back to every block that has it. There the ids are joined
with the vocabulary for their pieces, and both go to the words' places in the texts. So only the distinct words of blocks
are shuffled, packed, not the places of words; a word that every text holds is one entry a block. Blocks come from the
same scan twice (words, places); a digest of the words on both sides stops the job if the scan has not given the same
rows, as may be with an input that is neither a file nor cut.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import documents, id_and_text
from terrane.llm.word_blocks import BLOCK_BYTES, BUCKET_BYTES, blocks, bucket_count, by_bucket, hashes, packed, rows_of, spans, string_buffers, unpacked, with_task

VOCABULARY = "word_bpe_49k.json"


def public_path(name: str) -> str:
    """Where the installed vocabulary file of that name is, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a file, once a process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def checked(path: str) -> str:
    """``path``, if texts may be split at ASCII white space: the words of its splitting pattern hold none, and no added token does."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"] or {}])
    split = next((s for s in steps if s.get("type") == "Split"), None)
    inside = split and split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex", " ")
    bare = "" if not inside else inside.replace("[^\\s", "").replace("|", "")
    if not inside or any(x in bare for x in (" ", "\\s", "(?", ".", "[^")):
        raise ValueError(f"{path}: the words of this tokenizer may hold white space")
    if any(set(t["content"]) & set(" \t\n\r\x0b\x0c") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: an added token holds or takes white space, or looks at what is beside it")
    if spec["decoder"] is not None:
        raise ValueError(f"{path}: only tokenizers whose decoding joins pieces by blanks")
    return path


def id_to_piece(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: a row for each entry of the vocabulary and each added token; as large as the vocabulary file, whatever the corpus."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, piece) for piece, i in vocabulary.items()], "id int, piece string")


def decode(rows: DataFrame, pieces: DataFrame, keys: list[str], ids: str = "ids") -> DataFrame:
    """``keys`` and the text of ``ids`` (array<int>): pieces joined by blanks, in order, found by a join on the id.

    ``keys`` tell the rows apart; null ids and ids that the vocabulary lacks have no piece. Null and empty arrays give an
    empty text. A row's ids are put together in one task: a row is at most what a text is.
    """
    found = rows.select(*keys, F.posexplode_outer(ids).alias("at", "id")).join(F.broadcast(pieces), "id", "left")
    whole = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("found"))
    return whole.select(*keys, F.array_join(F.col("found.piece"), " ").alias("text"))


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, and how many each text has. White space at an end gives an empty word, which has no ids."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    return lists.flatten(), pc.list_value_length(lists).to_numpy()


_WORDS = "bucket long, block long, digest long, numbers binary, n long, letters binary"
_KNOWN = "block long, digest long, kind int, numbers binary, n long, ids binary, doc_ids array<long>"


def _blocks(buckets: int, most: int):
    """The words of each block by bucket (0 buckets: the texts' words as numbers). A block's digest tells its words apart from others."""

    def of(batches):
        for block, parts in blocks(batches, most):
            split = [(part.column(0), *_split(part.column(1))) for part in parts]
            coded = pa.chunked_array([words for _, words, _ in split]).dictionary_encode()
            words = coded.chunk(0).dictionary
            data, offsets = string_buffers(words)
            sizes = np.diff(offsets)
            digest = xxhash.xxh3_64(sizes.tobytes())
            digest.update(data)
            digest = digest.intdigest() >> 1
            if not buckets:
                for (doc_ids, _, counts), chunk in zip(split, coded.chunks, strict=True):
                    numbers = np.append(counts, chunk.indices.to_numpy())
                    yield rows_of(_KNOWN, dict(block=block, digest=digest, kind=1, numbers=packed(numbers), n=len(numbers), ids=None, doc_ids=doc_ids.to_pylist()))
                continue
            order, found = by_bucket(hashes(words), buckets)
            dealt = words.take(pa.array(order))
            data, offsets = string_buffers(dealt)
            for bucket, first, last in found:
                letters = pa.compress(data[offsets[first] : offsets[last]].tobytes(), "zstd", asbytes=True)
                numbers = packed(np.append(order[first:last], sizes[order[first:last]]))
                yield rows_of(_WORDS, dict(bucket=bucket, block=block, digest=digest, numbers=numbers, n=last - first, letters=letters))

    return of


def word_table(words: pa.Array, path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """For each word its number among the distinct ones; the number of ids of each distinct word, and all their ids."""
    coded = words.dictionary_encode()
    distinct, counts, ids = coded.dictionary, [], []
    for first in range(0, len(distinct), 10_000):
        for found in tokenizer(path).encode_batch(distinct.slice(first, 10_000).to_pylist(), add_special_tokens=False):
            got = found.ids
            counts.append(len(got))
            ids += got
    return coded.indices, np.array(counts, np.int64), np.array(ids, np.int64)


def _encode(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of a bucket are encoded, and their ids go back to each block that has them."""
        rows, places, sizes, letters = [], [], [], []
        for batch in batches:
            for row in batch.select(["block", "digest", "numbers", "n", "letters"]).to_pylist():
                at, size = np.split(unpacked(row["numbers"], 2 * row["n"]), 2)
                rows.append((row["block"], row["digest"], row["n"]))
                places.append(at)
                sizes.append(size)
                letters.append(pa.decompress(row["letters"], int(size.sum()), "zstd", asbytes=True) if size.sum() else b"")
        offsets = np.append(0, np.cumsum(np.concatenate(sizes)))
        words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"".join(letters)))
        of_word, counts, ids = word_table(words, path)
        of_word, starts, first = of_word.to_numpy(), np.cumsum(counts) - counts, 0
        for (block, digest, n), at in zip(rows, places, strict=True):
            mine = of_word[first : first + n]
            first += n
            found = ids[spans(starts[mine], counts[mine])]
            numbers = packed(np.concatenate([at, counts[mine], found]))
            yield rows_of(_KNOWN, dict(block=block, digest=digest, kind=0, numbers=numbers, n=n, ids=len(found).to_bytes(8, "little"), doc_ids=[]))

    return of


#: Words whose ids are joined with the vocabulary at once.
WORDS_AT_ONCE = 1 << 15


def with_pieces(counts: np.ndarray, ids: np.ndarray, path: str) -> list[str]:
    """For each word, given the number of its ids and all ids, a blank and a piece for each id: the ids' table is joined with the vocabulary's."""
    out, first = [], 0
    for at in range(0, len(counts), WORDS_AT_ONCE):
        count = counts[at : at + WORDS_AT_ONCE]
        mine = ids[first : first + int(count.sum())]
        first += len(mine)
        table = pa.table({"word": np.repeat(np.arange(len(count)), count), "at": np.arange(len(mine)), "id": mine.astype(np.int32)})
        joined = table.join(_pieces(path), "id", join_type="inner", use_threads=False).sort_by("at")
        ends = np.cumsum(np.bincount(joined["word"].to_numpy(), minlength=len(count)))
        pieces = joined["piece"].to_pylist()
        out += ["".join(pieces[e - c : e]) for e, c in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]
    return out


@functools.cache
def _pieces(path: str) -> pa.Table:
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    return pa.table({"id": pa.array(list(vocabulary.values()), pa.int32()), "piece": [f" {piece}" for piece in vocabulary]})


def _put_back(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of one block: ids and decoded texts, from those of its words by their numbers."""
        known, parts, digests = [], [], set()
        for batch in batches:
            for row in batch.to_pylist():
                digests.add(row["digest"])
                (parts if row["kind"] else known).append(row)
        if len(digests) != 1 or not known:
            raise RuntimeError("the texts were not the same when they were read again: cut the input first")
        at, counts, ids = [], [], []
        for row in known:
            n = row["n"]
            numbers = unpacked(row["numbers"], 2 * n + int.from_bytes(row["ids"], "little"))
            for to, x in zip((at, counts, ids), np.split(numbers, (n, 2 * n)), strict=True):
                to.append(x)
        at, counts, ids = map(np.concatenate, (at, counts, ids))
        order = np.argsort(at)
        ids = ids[spans((np.cumsum(counts) - counts)[order], counts[order])].astype(np.int32)
        counts = counts[order]
        del known, at
        decoded, starts = with_pieces(counts, ids, path), np.cumsum(counts) - counts
        for part in parts:
            words, numbers = np.split(unpacked(part["numbers"], part["n"]), [len(part["doc_ids"])])
            ends, size = np.cumsum(words), counts[numbers]
            tokens = np.append(0, np.cumsum(size))[np.append(0, ends)]
            texts = ["".join(map(decoded.__getitem__, numbers[e - c : e].tolist()))[1:] for e, c in zip(ends.tolist(), words.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(ids[spans(starts[numbers], size)], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_ids"], pa.int64()), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
            del lists, texts
        pa.default_memory_pool().release_unused()

    return of


def tokenized(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """doc_id, ids (array<int>), decoded (the text of these ids) for every row of ``docs``.

    Equal to the tokenizer's ``encode(text, add_special_tokens=False).ids`` and ``decode(ids, skip_special_tokens=False)``. Null
    texts are empty: no ids, an empty text. Repeated rows and rows without an id come back as they are; columns of any other
    names may stand beside. An empty table gives an empty one. A word without white space is one word, however long.
    """
    path, texts = checked(path), with_task(id_and_text(docs, id_col, text_col))
    words = texts.mapInArrow(_blocks(bucket_count(texts, bucket_bytes), block_bytes), _WORDS)
    known = words.groupBy("bucket").applyInArrow(_encode(path), _KNOWN)
    places = texts.mapInArrow(_blocks(0, block_bytes), _KNOWN)
    return known.union(places).groupBy("block").applyInArrow(_put_back(path), "doc_id long, ids array<int>, decoded string")


def op11_bpe_table(spark, sf_dir: str) -> DataFrame:
    found = tokenized(documents(spark, sf_dir), public_path(VOCABULARY))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
