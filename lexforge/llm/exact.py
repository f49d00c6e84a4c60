"""Exact dedup with Patricia tries.

Equal texts are those identical without white space (bytes 9-13 and 32). Each scan task first reduces its rows to one row per different
text and step of bounded size (so one text in a third of all rows costs one row a step), and rows are dealt by length and content hash.
Each task inserts the full byte strings of all texts dealt to it into one compressed radix trie: whether two texts are equal is decided by
walking its labels, never by a hash. The rows come in order of their bytes, so only the path of the newest string can still grow: a subtree
off this path is final, and is spilled (its terminals are written out) and freed, so memory holds one path however many strings
there are; Spark's external sort holds the rest. A terminal node keeps the row that stays: most code points in the original text, then the smallest
doc_id (null ids last), and how many rows ended there. `groups` names each terminal by its task and number, and members find
their terminal's owner by that name.

Null text counts as empty; empty texts are equal to each other and to texts of white space only. Repeated rows (one doc_id
and text) are members of their group like any others: `groups` gives each of them the same answer, `deduplicate` returns one.
An empty table gives an empty result. Columns other than doc_id and text are carried through by `deduplicate` whatever their
names, unless they begin with `_xd_`.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, small_batches

#: The white space that equality ignores.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = 2**63 - 1


class Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes):
        self.label, self.children, self.value = label, {}, None


def common(a: memoryview | bytes, b: memoryview | bytes) -> int:
    """Length of the common prefix, by halving: each step compares whole slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings. `insert` finds or makes the terminal of a string; `close` empties it.

    With `ordered`, strings come in ascending order: a subtree off the path of the newest string is final, and its terminals
    are handed to `emit` at once. Without it they stay until `close`. `splits` counts labels cut in two, `spilled` subtrees closed early."""

    def __init__(self, emit, ordered: bool = True):
        self.root, self.emit, self.ordered = Node(b""), emit, ordered
        self.splits = self.spilled = 0

    def _spill(self, node: Node) -> None:
        stack = [node]
        while stack:
            x = stack.pop()
            if x.value is not None:
                self.emit(x.value)
            stack.extend(x.children[k] for k in sorted(x.children, reverse=True))
            x.children = {}
            x.value = None

    def _branch(self, node: Node, key: int, child: Node) -> None:
        if self.ordered:
            for old in node.children.values():
                self._spill(old)
                self.spilled += 1
            node.children.clear()
        node.children[key] = child

    def insert(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                self._branch(node, text[at], child)
                return child
            n = common(child.label, text[at : at + len(child.label)])
            if n < len(child.label):
                middle = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                node.children[middle.label[0]] = middle
                self.splits += 1
                child = middle
            node, at = child, at + n
        return node

    def close(self) -> None:
        self._spill(self.root)
        self.root = Node(b"")


def _normal(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANK)


def _id(x) -> int:
    return NO_ID if x is None else x


#: Bytes of different texts and number of rows that a scan task holds before it hands on what it has combined.
HELD_BYTES, HELD_ROWS = 8 << 20, 20_000

OWN = {"_xd_bytes": T.LongType(), "_xd_sha": T.BinaryType(), "_xd_norm": T.BinaryType(), "_xd_points": T.LongType(), "_xd_id": T.LongType(), "_xd_rows": T.LongType()}
MEMBERS = T.ArrayType(T.LongType())


def _combined(keep_row: bool):
    """One row for each different text of a step, with the step's best row and, for `groups`, the ids of all its rows."""

    def made(best: dict, batches: list):
        cols = [
            pa.array([len(k) for k in best], pa.int64()),
            pa.array([hashlib.sha256(k).digest() for k in best], pa.binary()),
            pa.array(list(best), pa.binary()),
            pa.array([-v[0][0] for v in best.values()], pa.int64()),
            pa.array([v[3] for v in best.values()], pa.int64()),
            pa.array([v[2] for v in best.values()], pa.int64()),
        ]
        if not keep_row:
            return pa.RecordBatch.from_arrays([*cols, pa.array([v[4] for v in best.values()], pa.list_(pa.int64()))], [*OWN, "_xd_members"])
        start = [0]
        for b in batches:
            start.append(start[-1] + b.num_rows)
        rows = pa.Table.from_batches(batches).take(pa.array([start[v[1][0]] + v[1][1] for v in best.values()], pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([*cols, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)], [*OWN, *batches[0].schema.names])

    def run(batches):
        best: dict[bytes, list] = {}
        held, size, rows = [], 0, 0
        for batch in batches:
            for i, (text, doc) in enumerate(zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                key = _normal(text)
                rank = (-len(text or ""), _id(doc))
                seen = best.get(key)
                if seen is None:
                    best[key] = [rank, (len(held), i), 1, doc, [doc]]
                    size += len(key)
                else:
                    seen[2] += 1
                    seen[4].append(doc)
                    if rank < seen[0]:
                        seen[0], seen[1], seen[3] = rank, (len(held), i), doc
            rows += batch.num_rows
            if keep_row:
                held.append(batch)
                size += batch.nbytes
            if best and (size >= HELD_BYTES or rows >= HELD_ROWS):
                yield made(best, held)
                best, held, size, rows = {}, [], 0, 0
        if best:
            yield made(best, held)

    return run


def _inserted(batches, trie: PatriciaTrie):
    """Inserts rows that come in order of their bytes: of each batch and row, the terminal's value, which is [rank, rows, place]."""
    for batch in batches:
        norms = batch.column("_xd_norm")
        points, ids, rows = (batch.column(c).to_pylist() for c in ("_xd_points", "_xd_id", "_xd_rows"))
        for i in range(batch.num_rows):
            node, rank = trie.insert(norms[i].as_py()), (-points[i], _id(ids[i]))
            new = node.value is None
            if new:
                node.value = [rank, 0, None]
            node.value[1] += rows[i]
            better = new or rank < node.value[0]
            if better:
                node.value[0] = rank
            yield batch, i, node.value, new, better


def _rows_that_stay(fields: list[str]):
    """For `deduplicate`: the owner's row of each terminal."""

    def run(batches):
        done: list = []
        trie = PatriciaTrie(lambda value: done.append(value[2]))
        for batch, i, value, _, better in _inserted(batches, trie):
            if better:
                value[2] = batch.slice(i, 1)
            if i == batch.num_rows - 1 and done:
                yield from pa.Table.from_batches(done).select(fields).combine_chunks().to_batches()
                done.clear()
        trie.close()
        if done:
            yield from pa.Table.from_batches(done).select(fields).combine_chunks().to_batches()

    return run


def _terminals(batches):
    """For `groups`: a row for each row inserted, with its terminal's name and members, and a row for each terminal, with its owner and size."""
    from pyspark import TaskContext

    context = TaskContext.get()
    task, made = (context.partitionId() if context else 0) << 40, 0
    named, members, shas, owners = [], [], [], []
    trie = PatriciaTrie(lambda value: owners.append((value[2], value[0][1], value[1])))

    def rows():
        n, m = len(named), len(owners)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(named + [o[0] for o in owners], pa.int64()),
                pa.array(members + [None] * m, pa.list_(pa.int64())),
                pa.array(shas + [None] * m, pa.binary()),
                pa.array([None] * n + [None if o[1] == NO_ID else o[1] for o in owners], pa.int64()),
                pa.array([None] * n + [o[2] for o in owners], pa.int64()),
            ],
            ["terminal", "members", "sha", "keep_id", "group_size"],
        )
        for x in (named, members, shas, owners):
            x.clear()
        return out

    for batch, i, value, new, _ in _inserted(batches, trie):
        if new:
            made += 1
            value[2] = task + made
        named.append(value[2])
        members.append(batch.column("_xd_members")[i].as_py())
        shas.append(batch.column("_xd_sha")[i].as_py())
        if i == batch.num_rows - 1:
            yield rows()
    trie.close()
    yield rows()


def _dealt(docs: DataFrame, keep_row: bool) -> DataFrame:
    """Combined rows, dealt by length and content hash and sorted by their bytes."""
    small_batches(docs.sparkSession)
    more = docs.schema.fields if keep_row else [T.StructField("_xd_members", MEMBERS)]
    schema = T.StructType([T.StructField(k, v) for k, v in OWN.items()] + list(more))
    return docs.mapInArrow(_combined(keep_row), schema).repartition("_xd_bytes", "_xd_sha").sortWithinPartitions("_xd_norm")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The join carries no text, and one row for each step of a hot text."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = Tables(docs.sparkSession).save(_dealt(src, False).mapInArrow(_terminals, "terminal long, members array<long>, sha binary, keep_id long, group_size long"), "terminals")
    owners = made.where(F.col("members").isNull()).select("terminal", "keep_id", "group_size")
    inserted = made.where(F.col("members").isNotNull()).select("terminal", "members", "sha")
    return inserted.join(owners, "terminal").select(F.explode("members").alias("doc_id"), "keep_id", "group_size", "sha").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The row of each group that stays, with all its columns: one shuffle, no join."""
    return _dealt(docs, True).mapInArrow(_rows_that_stay(docs.columns), docs.schema)
