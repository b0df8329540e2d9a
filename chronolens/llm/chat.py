"""Chat formatting of reply trees.

Messages form trees by parent ids. Iterative self-joins with jumps of doubling
length find each message's root and depth, and each leaf's whole path to its
root: a path of n messages takes log2(n) joins, whatever the number of trees.
Branches are ranked by score and the chosen paths become one conversation each.

Format: ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn. In roles and texts a
backslash becomes two, ``<|`` becomes ``<\\|``, and in roles a line break becomes
``\\n``; so no control string can occur inside, and reading undoes it exactly.
The loss mask is the escaped text of assistant turns.

Null texts and roles are empty. Null scores count as 0. A message whose parent
is missing is a root; so is one with no parent. Repeated ids are an error
(``ValueError``); ``linear`` numbers rows itself, so there repeated turns follow
each other by role and text. Messages without an id, and those on a cycle, which have no root, are left out.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

START, STOP = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(STOP) + "\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string, and the spans of it that count in the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escaped(role).replace("\n", "\\n") + "\n", escaped(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, STOP, "\n"]
        at += len(head) + len(body) + len(STOP) + 1
    return "".join(parts), spans


def parsed(conversation: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(conversation):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        role = _ESCAPED.sub(lambda x: "\n" if x[1] == "n" else x[1], m[1])
        out.append((role, unescaped(m[2])))
    if at != len(conversation):
        raise ValueError("not a formatted conversation")
    return out


def _doubled(jumps: DataFrame, nodes: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (id, up): the ancestor 1, 2, 4, ... steps above; and those that still have one further up than there are messages, which is on a cycle."""
    out = [written(jumps, "jump")]
    while out[-1].limit(1).count():
        if 1 << (len(out) - 1) > nodes:
            return out[:-1], out[-1]
        a, b = out[-1], out[-1].select(F.col("id").alias("up"), F.col("up").alias("over"))
        out.append(written(a.join(b, "up").select("id", F.col("over").alias("up")), "jump"))
    return out[:-1], None


def reply_paths(messages: DataFrame, best: int | None = 1, unique: bool = False) -> DataFrame:
    """(path, id, depth): the messages of the ``best`` branches of each tree (None: of all), by path.

    ``messages`` has id, parent, score. A branch is a root-to-leaf path; its
    score is the mean over its messages, ties go to the smaller leaf id. ``path``
    is the leaf's id, ``depth`` counts from 0 at the root. ``unique`` says that
    ids are known not to repeat, which is looked up otherwise.
    """
    nodes = written(messages.where("id is not null").select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    if not unique and (twice := nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").head(3)):
        raise ValueError(f"repeated message ids: {[r['id'] for r in twice]}")
    edges = nodes.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.col("parent").alias("up"))
    leaves = nodes.join(edges.select(F.col("up").alias("id")).distinct(), "id", "left_anti").select("id")
    jumps, endless = _doubled(edges, nodes.count())
    if endless is not None:
        leaves = leaves.join(endless.select("id"), "id", "left_anti")
    # longest jumps first: each ancestor of a leaf is reached by one sum of powers of two
    pairs = leaves.select(F.col("id").alias("path"), "id", F.lit(0).cast("long").alias("dist"))
    for k in range(len(jumps) - 1, -1, -1):
        more = pairs.join(jumps[k], "id").select("path", F.col("up").alias("id"), (F.col("dist") + (1 << k)).alias("dist"))
        then = written(pairs.unionByName(more), "paths")
        dropped(pairs)
        pairs = then
    for j in jumps:
        dropped(j)
    scored = pairs.join(nodes, "id")
    ends = scored.groupBy("path").agg(F.avg("score").alias("score"), F.max("dist").alias("length"), F.max(F.struct("dist", "id"))["id"].alias("root"))
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "path"))
        ends = ends.withColumn("rank", rank).where(F.col("rank") <= best)
    return pairs.join(ends.select("path", "length"), "path").select("path", "id", (F.col("length") - F.col("dist")).alias("depth"))


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations of turns as reply trees with one branch each: id, parent, score, conv_id, role, text."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(w))
    key = lambda n: F.struct("conv_id", n.cast("long").alias("n"))
    return rows.select(key(F.col("n")).alias("id"), F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent"), F.lit(0.0).alias("score"), "conv_id", "role", "text")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str, int | None, list[tuple[str, str]]]]]:
    """(path, conversation, turns) of a sorted partition, whole, one after another."""
    key, name, turns, first = None, None, [], True
    for b in batches:
        out = []
        for path, conv, role, text in zip(b["path"], b["conv_id"], b["role"], b["text"]):
            if first or path != key:
                if not first:
                    out.append((key, name, turns))
                key, name, turns, first = path, None if pd.isna(conv) else int(conv), [], False
            turns.append((role, text))
        if out:
            yield out
    if not first:
        yield [(key, name, turns)]


def _joined(messages: DataFrame, best: int | None, unique: bool) -> DataFrame:
    """Messages along their chosen paths, a path in one task and in order."""
    paths = reply_paths(messages, best, unique)
    body = messages.select("id", F.col("conv_id").cast("long").alias("conv_id"), "role", "text")
    rows = paths.join(body, "id").select(F.col("path").cast("string").alias("path"), "depth", "conv_id", "role", "text")
    return rows.repartition("path").sortWithinPartitions("path", "depth").select("path", "conv_id", "role", "text")


def chats(messages: DataFrame, best: int | None = 1, unique: bool = False) -> DataFrame:
    """(path, conv_id, formatted, loss): a row per chosen path; ``path`` is the leaf's id as text, ``loss`` is spans [start, end) of ``formatted``."""
    schema = pa.schema([("path", pa.string()), ("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _conversations(b.to_pandas() for b in batches):
            rows = [(path, name, *formatted(turns)) for path, name, turns in some]
            yield pa.RecordBatch.from_pylist([{"path": p, "conv_id": c, "formatted": t, "loss": [{"start": a, "end": b} for a, b in spans]} for p, c, t, spans in rows], schema)

    return _joined(messages, best, unique).mapInArrow(run, "path string, conv_id long, formatted string, loss array<struct<start: long, end: long>>")


def chat_digests(messages: DataFrame, best: int | None = 1, unique: bool = False) -> DataFrame:
    """A row per chosen path with digests of what is read back from its formatted string and loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _conversations(batches):
            rows = []
            for _, name, turns in some:
                text, spans = formatted(turns)
                back = parsed(text)
                learned = "".join(unescaped(text[a:b]) for a, b in spans)
                whole = sha256("".join(f"{r}\n{t}\n" for r, t in back).encode())
                rows.append((name, len(back), whole.hexdigest(), len(learned), sha256(learned.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [[]] * 6
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            yield pd.DataFrame({n: pd.array(c, "Int64") if "long" in d else pd.array(c, object) for n, c, d in zip(names, cols, DIGESTS.split(", "))})

    return _joined(messages, best, unique).mapInPandas(run, DIGESTS)
