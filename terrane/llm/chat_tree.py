"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: a turn with all turns before it is a node, known by a chained
hash, and each node's tokens are produced once. The nodes of a tree are laid out depth first in one sequence of
tokens. A node has its start in that sequence, the position id of its first token (the tokens of its ancestors;
positions then count up), and the intervals of the sequence that its tokens may attend to besides their own: its ancestors.

Depth-first order without gathering a tree or a conversation: a node is known by how many conversations pass through
it. Along a conversation that number never rises, and where it falls a branch begins; the nodes where branches begin are
the conversation's short path. Conversations are sorted by these, by a range shuffle. A node belongs to
the first conversation that passes through it, and stands in the order of (rank of that conversation, depth).
Starts are running sums in three levels: within a conversation, within a range partition, over the partitions of a
tree. So a first turn that a third of all conversations share is one node and one row of each sum.

Turns are rows throughout. Where those of a conversation must meet in order (chained hashes, positions, reading back),
they stream through a task one after the other, with a hash and a few sums kept between them: a conversation of any
length takes time, not memory.

Template: ``<|turn|>`` role newline text ``<|end|>`` newline. In roles and texts a backslash is doubled and every control
string gets one after its first character; in roles a newline becomes ``\\N``. :func:`unescape` is the exact inverse.
Texts of assistant turns are under the loss mask.

Turns stand in the order of (turn, role, text), repeated rows included; null roles and texts are empty, null turns come
first. A row without a conversation id is a conversation of its own, of one turn.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.llm.common import cut

TURN, END = "<|turn|>", "<|end|>"
CONTROL = [TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_TURNS = re.compile(rf"{re.escape(TURN)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longer texts go to the tokenizer in pieces of so many characters at most: its pattern recurses on long runs.
PIECE = 4096
#: Splits text before byte pairs are merged; the published pattern that goes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|N|)", lambda m: {"\\": "\\", "N": "\n", "": ""}[m[1]], text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role).replace(chr(10), chr(92) + 'N')}\n{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURNS.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Tokenizer:
    """Byte pair encoding by a public vocabulary, or single bytes without one; two more ids for the control strings."""

    def __init__(self, ranks: dict[bytes, int] | None):
        self.encoding = None
        base = 256
        if ranks is not None:
            import tiktoken

            self.encoding = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            base = max(ranks.values()) + 1
        self.control = {base: TURN, base + 1: END}
        self.turn, self.end = base, base + 1

    def encode(self, text: str) -> list[int]:
        """Tokens of the text; one of over ``PIECE`` characters is cut behind a blank where it has one, else anywhere."""
        if not self.encoding:
            return list(text.encode())
        out, at = [], 0
        while len(text) - at > PIECE:
            end = text.rfind(" ", at + 1, at + PIECE)
            end = end if end > at else at + PIECE
            out += self.encoding.encode_ordinary(text[at:end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def decode(self, tokens: list[int]) -> str:
        out, plain = b"", []
        for t in [*tokens, None]:
            if t is None or t in self.control:
                out += self.encoding.decode_bytes(plain) if self.encoding else bytes(plain)
                plain = []
                out += self.control[t].encode() if t is not None else b""
            else:
                plain.append(t)
        return out.decode()

    def node(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Tokens of a turn, and where those of its text begin and end."""
        head = [self.turn, *self.encode(escape(role).replace("\n", "\\N") + "\n")]
        body = self.encode(escape(text))
        return [*head, *body, self.end, *self.encode("\n")], len(head), len(head) + len(body)


def read_vocabulary(path: str | None) -> dict[bytes, int] | None:
    """Byte pairs and their ranks; without a path, or where there is no such file, None: tokens are single bytes then."""
    if path is None or not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_CHAINED = "key long, lone long, depth long, node binary, parent binary, tree binary, role string, text string"


def _chain(batches):
    """Node, parent and tree of each turn; the turns of a conversation come one after the other, in order."""
    now, depth, last, tree = None, 0, None, None
    for batch in batches:
        out = {x: [] for x in ("depth", "node", "parent", "tree")}
        ids = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
        for key, lone, role, text in ids:
            if (key, lone) != now:
                now, depth, last, tree = (key, lone), 0, None, None
            role = role.encode()
            digest = hashlib.blake2b(last or b"", digest_size=16)
            digest.update(len(role).to_bytes(8, "big") + role)
            digest.update(text.encode())
            node = digest.digest()
            tree = tree or node
            for name, value in (("depth", depth), ("node", node), ("parent", last), ("tree", tree)):
                out[name].append(value)
            depth, last = depth + 1, node
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(out["depth"], pa.int64()),
                *(pa.array(out[x], pa.binary()) for x in ("node", "parent", "tree")), batch.column(2), batch.column(3),
            ],
            names=["key", "lone", "depth", "node", "parent", "tree", "role", "text"],
        )


def chained_turns(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, depth, node, parent, tree, role, text, and the rank of its conversation.

    Ranks are in the order of short paths, so the conversations of a tree, and of each of its branches, follow each other.
    """
    whole = ["key", "lone"]  # of a conversation; lone tells the rows without an id apart
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    conv_id = F.col("conv_id").cast("long")
    turns = conversations.select(
        F.coalesce(conv_id, F.lit(0)).alias("key"), F.when(conv_id.isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).alias("lone"),
        F.col("turn").cast("long").alias("turn"), text("role"), text("text"),
    )
    deals = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartition(deals, *whole).sortWithinPartitions(*whole, "turn", "role", "text")
    turns = cut(dealt.select(*whole, "role", "text").mapInArrow(_chain, _CHAINED))
    passing = turns.groupBy("node").agg(F.count("*").alias("n"))
    branches = turns.select(*whole, "depth", "node").join(passing, "node").groupBy(*whole, "n").agg(F.min(F.struct("depth", "node")).alias("branch"))
    paths = branches.groupBy(*whole).agg(F.sort_array(F.collect_list("branch"))["node"].alias("path"))
    ordered = paths.repartitionByRange(deals, "path", *whole).sortWithinPartitions("path", *whole)
    ranks = cut(ordered.select(*whole, F.monotonically_increasing_id().alias("rank")))
    named = F.when(F.col("lone") == 0, F.col("key")).alias("conv_id")
    return cut(turns.join(ranks, whole).select(named, "rank", "depth", "node", "parent", "tree", "role", "text"))


def _tokens(shared):
    def of(batches):
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            done = [tokenizer.node(r, t) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([x[0] for x in done], pa.list_(pa.int32())),
                    *(pa.array([x[i] for x in done], pa.int32()) for i in (1, 2)),
                ],
                names=["node", "tokens", "loss_start", "loss_end"],
            )

    return of


def _attention(batches):
    """Position of each own node's first token, and the intervals of its ancestors, neighbours joined.

    The turns of a conversation come one after the other, in order.
    """
    now, position, intervals = None, 0, []
    for batch in batches:
        out = {x: [] for x in ("node", "position", "attention")}
        for rank, node, own, start, n_tokens in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if rank != now:
                now, position, intervals = rank, 0, []
            if own:
                out["node"].append(node)
                out["position"].append(position)
                out["attention"].append([dict(x) for x in intervals])
            position += n_tokens
            if intervals and intervals[-1]["end"] == start:
                intervals[-1]["end"] = start + n_tokens
            else:
                intervals.append({"start": start, "end": start + n_tokens})
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(out[x], kind) for x, kind in zip(out, kinds, strict=True)], names=list(out))


def _in_order(turns: DataFrame, *first: str) -> DataFrame:
    """All turns of a conversation in one task, one after the other."""
    deals = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(deals, "rank").sortWithinPartitions("rank", "depth").select("rank", *first)


def prefix_trees(turns: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """A row for each node: tree, node, parent, depth, role, tokens, loss_start, loss_end (the part of its tokens under
    the loss mask; null if none), start (in the tree's sequence), position, attention (start, end), conversations.

    ``turns`` is the result of :func:`chained_turns`.
    """
    shared = turns.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    nodes = turns.groupBy("node").agg(
        F.min("rank").alias("first"), F.count("*").alias("conversations"),
        *[F.first(c).alias(c) for c in ("depth", "parent", "tree", "role", "text")],
    )
    nodes = cut(nodes)
    tokens = cut(nodes.select("node", "role", "text").mapInArrow(_tokens(shared), "node binary, tokens array<int>, loss_start int, loss_end int"))
    sized = nodes.drop("text").join(tokens.select("node", F.size("tokens").cast("long").alias("n_tokens")), "node")
    before = lambda w: F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    runs = sized.groupBy("tree", "first").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("part", F.shiftright("first", 33))
    parts = runs.groupBy("tree", "part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("tree", "part", before(Window.partitionBy("tree").orderBy("part")).alias("ahead"))
    runs = runs.withColumn("inner", before(Window.partitionBy("tree", "part").orderBy("first")))
    runs = runs.join(parts, ["tree", "part"]).select("first", (F.col("ahead") + F.col("inner")).alias("run"))
    placed = sized.withColumn("inside", before(Window.partitionBy("first").orderBy("depth"))).join(runs, "first")
    placed = cut(placed.withColumn("start", F.col("run") + F.col("inside")).drop("run", "inside"))
    steps = turns.select("rank", "depth", "node").join(placed.select("node", "first", "start", "n_tokens"), "node")
    owners = placed.select(F.col("first").alias("rank")).distinct()  # the other conversations own no node
    steps = steps.withColumn("own", F.col("first") == F.col("rank")).join(owners, "rank", "left_semi")
    seen = _in_order(steps, "node", "own", "start", "n_tokens").mapInArrow(
        _attention, "node binary, position long, attention array<struct<start:long,end:long>>"
    )
    loss = F.col("role") == "assistant"
    return placed.join(tokens, "node").join(seen, "node").select(
        F.hex("tree").alias("tree"), "node", "parent", "depth", "role", "tokens",
        F.when(loss, F.col("loss_start")).alias("loss_start"), F.when(loss, F.col("loss_end")).alias("loss_end"),
        "start", "position", "attention", "conversations",
    )


class _Reader:
    """What is read of one conversation so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, tokenizer: Tokenizer, tokens: list[int], loss_start: int | None, loss_end: int | None) -> None:
        formatted = tokenizer.decode(tokens)
        for role, text in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        self.formatted_chars += len(formatted)
        if loss_start is not None:
            text = unescape(tokenizer.decode(tokens[loss_start:loss_end]))
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars,
        }


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_TYPES = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _read(shared):
    def of(batches):
        tokenizer, now, reader = Tokenizer(shared.value), None, None
        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 256):  # lists of tokens become Python objects a few at a time
                part = batch.slice(at, 256)
                for rank, conv_id, tokens, start, end in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    if rank != now:
                        if reader:
                            done.append(reader.row())
                        now, reader = rank, _Reader(conv_id)
                    reader.add(tokenizer, tokens, start, end)
            yield pa.RecordBatch.from_pylist(done, schema=_READ_TYPES)
        if reader:
            yield pa.RecordBatch.from_pylist([reader.row()], schema=_READ_TYPES)

    return of


def read_back(turns: DataFrame, trees: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Every conversation as it is read from the trees' tokens along its path."""
    shared = turns.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    steps = turns.select("conv_id", "rank", "depth", "node").join(trees.select("node", "tokens", "loss_start", "loss_end"), "node")
    return _in_order(steps, "conv_id", "tokens", "loss_start", "loss_end").mapInArrow(_read(shared), _READ)


#: A conversation whose texts look like the template's own marks.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_prefix_tree(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    turns = chained_turns(rows.unionByName(planted))
    return read_back(turns, prefix_trees(turns))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """All columns but the last, for tests."""
    out, by = [], {}
    for i, (conv_id, turn, role, text) in enumerate(rows):
        by.setdefault((conv_id, i if conv_id is None else None), []).append((turn, role or "", text or ""))
    for (conv_id, _), turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        out.append((conv_id, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out
