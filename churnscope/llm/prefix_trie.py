"""Prefix trie of conversations, from adaptive radix trees over turn ids.

A turn's id has a fixed width of ``WIDTH`` bytes: a digest of its role and
text, then its code points, big-endian.  A conversation's key is the ids of its
turns one after the other, so a prefix of turns is a prefix of whole ids.

1. Turns become ids where they are read; from there on no text moves.  Equal
   keys become one: their conversations are sorted by (key, id) over all tasks
   and merged from one row a key and task.
2. Keys are dealt by ranges.  The cuts come from a bounded draw of keys and are
   shortened to the fewest turns that still tell them from the key before, so
   only the proper prefixes of cuts can have members in several ranges
   ("open" nodes).  A hot first turn is cut deeper, like any other range.
3. A task builds the adaptive radix tree of a range: nodes of 4, 16, 48 or 256
   children that grow as needed, and paths without a branch in one edge.  It
   walks the tree and emits a trie node wherever a depth in bytes is a multiple
   of ``WIDTH``, also inside an edge; other depths emit nothing.
4. Open nodes come out once a range, with what their closed children sum to.
   They are added up and finished on the driver: their number is bounded by the
   ranges and the length of the cuts, not by the conversations.

A conversation's key (20 bytes a turn) is held whole in a task, like a text.
The digest of a node's ends is sequential by its definition; it is updated over
one row a task, whatever the number of ends.

Edge cases: null roles and texts are empty; turns of equal number follow in the
order of their ids, repeated rows stay; a null turn comes first; rows without a
conversation id belong to no conversation; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.session import release, stash

DIGEST = 16
WIDTH = DIGEST + 4
#: Keys of a range, and keys drawn for each range to place the cuts.
RANGE_KEYS, DRAWN = 100_000, 16
#: Rows of open nodes that are broadcast to name their children's parents; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a batch that a walk gives out.
OUT_ROWS = 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- adaptive radix tree ------------------------------------------------------

class Few:
    """Up to 4 or 16 children beside their sorted bytes."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, [], []

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node):
        """The layout that now holds ``node`` under ``byte``: this one, or a larger one."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.nodes) < self.room:
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
            return self
        larger = Few(16) if self.room == 4 else Indexed()
        for b, n in zip(self.bytes, self.nodes):
            larger.put(b, n)
        return larger.put(byte, node)

    def children(self) -> list:
        return self.nodes


class Indexed:
    """Up to 48 children in order of arrival; 256 bytes say which one a byte has."""

    __slots__ = ("index", "nodes")
    room = 48

    def __init__(self):
        self.index, self.nodes = bytearray(b"\xff" * 256), []

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at] if at != 0xFF else None

    def put(self, byte: int, node):
        at = self.index[byte]
        if at != 0xFF:
            self.nodes[at] = node
            return self
        if len(self.nodes) < self.room:
            self.index[byte] = len(self.nodes)
            self.nodes.append(node)
            return self
        larger = Full()
        for b, i in enumerate(self.index):
            if i != 0xFF:
                larger.put(b, self.nodes[i])
        return larger.put(byte, node)

    def children(self) -> list:
        return [self.nodes[i] for i in self.index if i != 0xFF]


class Full:
    """A place for each of the 256 bytes."""

    __slots__ = ("slots",)
    room = 256

    def __init__(self):
        self.slots = [None] * 256

    def get(self, byte: int):
        return self.slots[byte]

    def put(self, byte: int, node):
        self.slots[byte] = node
        return self

    def children(self) -> list:
        return [n for n in self.slots if n is not None]


class Node:
    """The bytes from ``start`` to ``end`` of ``key`` lead from the parent to here; ``value`` is what ends here."""

    __slots__ = ("key", "start", "end", "value", "layout", "n", "low", "leaves", "saved", "tops")

    def __init__(self, key: bytes, start: int, end: int, value=None):
        self.key, self.start, self.end, self.value, self.layout = key, start, end, value, Few()


def _agree(one: bytes, two: bytes, start: int, end: int) -> int:
    """Where the keys first differ in start..end (``end`` if they don't)."""
    end = min(end, len(one), len(two))
    if one[start:end] == two[start:end]:
        return end
    while start < end:  # the first difference lies in start..end
        mid = (start + end) // 2
        if one[start:mid + 1] == two[start:mid + 1]:
            start = mid + 1
        else:
            end = mid
    return start


def insert(root: Node, key: bytes, value) -> None:
    node = root
    while node.end < len(key):
        at = node.end
        child = node.layout.get(key[at])
        if child is None:
            node.layout = node.layout.put(key[at], Node(key, at, len(key), value))
            return
        same = _agree(child.key, key, at, child.end)
        if same < child.end:  # the edge parts here
            fork = Node(key, at, same)
            fork.layout = fork.layout.put(child.key[same], child)
            child.start = same
            node.layout.put(key[at], fork)
            child = fork
        node = child
    node.value = value


def _points(key: bytes, depth: int) -> int:
    """Code points of the last turn of the first ``depth`` turns."""
    return int.from_bytes(key[depth * WIDTH - 4:depth * WIDTH], "big") if depth else 0


def _depths(node: Node) -> range:
    """Depths in turns that lie on the node's edge."""
    return range(node.start // WIDTH + 1, node.end // WIDTH + 1)


def summed(root: Node) -> list[Node]:
    """The nodes, parents first, with members (n, low), leaves, saved (of the depths on and under the
    edge) and tops (the trie nodes right above which a trie node at the edge's end would stand)."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.layout.children())
    for node in reversed(order):
        kids = node.layout.children()
        ends = [node.value] if node.value else []
        node.n = sum(k.n for k in kids) + sum(v[0] for v in ends)
        node.low = min([k.low for k in kids] + [v[1] for v in ends], default=None)
        node.leaves = sum(k.leaves for k in kids) if kids else 1
        node.tops = sum(1 if _depths(k) else k.tops for k in kids)
        node.saved = sum(k.saved for k in kids) + (node.n - 1) * sum(_points(node.key, d) for d in _depths(node))
    return order


def walk(root: Node, opens: dict[bytes, int]) -> tuple[list[tuple], list[tuple]]:
    """(rows of closed nodes, rows of open nodes) of the trie of whole turns.

    closed: conv_id, depth, parent_conv_id or None, the open parent's number or None, n_convs, n_children,
    n_leaves, saved_tokens, ends.  open: number, n_convs, conv_id, ends, and of its closed children their
    number, leaves and saved tokens.
    """
    closed, partial = [], {}
    summed(root)
    stack = [(root, None)]  # and the trie node right above the edge: a conversation, or the number of an open one
    while stack:
        node, above = stack.pop()
        saved = node.saved
        depths = _depths(node) if node is not root else range(0, 1)
        for depth in depths:
            last = depth == depths[-1]
            ends = node.value[2] if node.value and last and node.end == depth * WIDTH else None
            number = opens.get(node.key[:depth * WIDTH])
            children = node.tops if last else 1
            if number is not None:
                partial[number] = [node.n, node.low, ends, 0, 0, 0]
                above = ("open", number)
            else:
                kind, who = above
                if kind == "open":
                    sums = partial[who]
                    sums[3] += 1
                    sums[4] += node.leaves
                    sums[5] += saved
                closed.append((node.low, depth, None if kind == "open" else who, who if kind == "open" else None,
                               node.n, children, node.leaves, saved, ends or NO_ENDS))
                above = ("closed", node.low)
            saved -= (node.n - 1) * _points(node.key, depth)
        stack.extend((k, above) for k in node.layout.children())
    return closed, [(number, *sums) for number, sums in partial.items()]


# ---- from rows to keys ----------------------------------------------------------

def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv_id, ids): each conversation's turn ids, as hexadecimal text, in the order of its turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    points = F.lpad(F.lower(F.hex(F.length(text))), 8, "0")
    turns = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.concat(F.substring(digest, 1, 2 * DIGEST), points).alias("id")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.expr("transform(t, x -> x.id)").alias("ids"))


def rebuild(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % ``group``, where
    h = crc32(c as text) % ``most``; at most ``group`` conversations share a start of under ``most`` turns."""
    starts = conversations.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("start"), F.slice("ids", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = conversations.select("conv_id", "ids", h.alias("h"),
                               (F.col("conv_id") - F.col("conv_id") % group).alias("start"))
    head = F.expr("slice(coalesce(head, array()), 1, h)")
    rest = F.expr("slice(ids, h + 1, greatest(size(ids) - h, 0))")
    return own.join(starts, "start", "left").select("conv_id", F.concat(head, rest).alias("ids"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each run of equal first values, as they come."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted (key, conv_id): for each key its conversations as text."""
    names = ["key", "first", "n", "ids"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.binary(), pa.int64(), pa.int64(), pa.string()))], names)

    rows, key, ids = [], None, []
    for k, c in _grouped(batches):
        if k != key and ids:
            rows.append((key, ids[0], len(ids), ",".join(map(str, ids))))
            ids = []
        key = k
        ids.append(c)
        if len(rows) >= OUT_ROWS:
            yield batch(rows)
            rows = []
    if ids:
        rows.append((key, ids[0], len(ids), ",".join(map(str, ids))))
    if rows:
        yield batch(rows)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, first, n, ids): for each key its members, the least of them and the digest of all."""
    names = ["key", "n", "low", "ends"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.binary(), pa.int64(), pa.int64(), pa.string()))], names)

    rows, key, n, low, digest = [], None, 0, None, None
    for k, first, some, ids in _grouped(batches):
        if digest is not None and k == key:
            digest.update(b",")
        else:
            if digest is not None:
                rows.append((key, n, low, digest.hexdigest()))
            key, n, low, digest = k, 0, first, hashlib.sha256()
        n += some
        digest.update(ids.encode())
        if len(rows) >= OUT_ROWS:
            yield batch(rows)
            rows = []
    if digest is not None:
        rows.append((key, n, low, digest.hexdigest()))
    if rows:
        yield batch(rows)


def distinct_keys(conversations: DataFrame) -> DataFrame:
    """(key, n, low, ends) of the distinct keys of (conv_id, ids)."""
    keys = conversations.select(F.unhex(F.array_join("ids", "")).alias("key"), "conv_id")
    some = (keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
            .mapInArrow(_chunks, "key binary, first long, n long, ids string"))
    return (some.repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(_merged, "key binary, n long, low long, ends string"))


def cuts_of(keys: DataFrame, ranges: int) -> list[bytes]:
    """Up to ``ranges`` - 1 keys between which the ranges lie, each as short as tells it from the drawn key before."""
    if ranges < 2:
        return []
    drawn = sorted(bytes(r.key) for r in keys.select("key").orderBy(F.xxhash64("key"), "key")
                   .limit(DRAWN * ranges).collect())
    cuts = []
    for i in range(1, ranges):
        at = i * len(drawn) // ranges
        if 0 < at < len(drawn):
            same = _agree(drawn[at - 1], drawn[at], 0, len(drawn[at]))
            cuts.append(drawn[at][:(same // WIDTH + 1) * WIDTH])
    return sorted(set(cuts))


# ---- the operator -----------------------------------------------------------------

CLOSED = ("conv_id long, depth long, parent_conv_id long, parent long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per trie node of (conv_id, ids): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    keys = stash(distinct_keys(conversations), "trie-keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(4 * parts, -(-keys.count() // RANGE_KEYS))
    cuts = cuts_of(keys, ranges)
    prefixes = sorted({cut[:d] for cut in cuts for d in range(0, len(cut), WIDTH)} | {b""})
    numbers = {prefix: i for i, prefix in enumerate(prefixes)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(cuts, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns],
                                             ["range", "key", "n", "low", "ends"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, now = None, None
        for at, key, *value in _grouped(batches):
            if at != now and root is not None:
                yield from given(root, now)
                root = None
            if root is None:
                root, now = Node(b"", 0, 0), at
            insert(root, key, tuple(value))
        if root is not None:
            yield from given(root, now)

    def given(root: Node, at: int) -> Iterator[pa.RecordBatch]:
        beside = cuts[max(at - 1, 0):at + 1]  # the cuts under and over the range
        mine = {cut[:d]: numbers[cut[:d]] for cut in beside for d in range(0, len(cut), WIDTH)} | {b"": 0}
        closed, opened = walk(root, mine)
        for i in range(0, len(closed), OUT_ROWS):
            yield table([(False, *row, None) for row in closed[i:i + OUT_ROWS]])
        yield table([(True, low, None, None, number, n, children, leaves, saved, ends, at)
                     for number, n, low, ends, children, leaves, saved in opened])

    kinds = [pa.bool_(), *[pa.int64()] * 8, pa.string(), pa.int32()]
    names = ["open", "conv_id", "depth", "parent_conv_id", "parent", "n_convs", "n_children", "n_leaves",
             "saved_tokens", "ends_sha256", "at"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    nodes = stash(keys.mapInArrow(placed, "range int, key binary, n long, low long, ends string")
                  .repartition(parts, "range").sortWithinPartitions("range")
                  .mapInArrow(build, f"open boolean, {CLOSED}, at int"), "trie-nodes")
    release(keys)
    finished = _finish(nodes, prefixes)
    schema = CLOSED.replace("parent long, ", "number long, ")
    opened = spark.createDataFrame(finished, schema)
    named = opened.select(F.col("number").alias("parent"), F.col("conv_id").alias("_above"))
    named = F.broadcast(named) if len(finished) <= BROADCAST_ROWS else named
    closed = nodes.where("NOT open").join(named, "parent", "left").withColumn(
        "parent_conv_id", F.coalesce("_above", "parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return closed.select(*columns).unionByName(opened.select(*columns))


def _finish(nodes: DataFrame, prefixes: list[bytes]) -> list[tuple]:
    """Rows of the open nodes: what the ranges gave, added up, and then up the tree."""
    found = {r.parent: r for r in nodes.where("open").groupBy("parent").agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("low"), F.max("ends_sha256").alias("ends"),
        F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved")).collect()}
    at = {prefix: i for i, prefix in enumerate(prefixes)}
    sums = {i: [r.children, r.leaves, r.saved] for i, r in found.items()}
    out = []
    for i in sorted(found, key=lambda i: -len(prefixes[i])):  # the deepest first
        prefix, row, (children, leaves, saved) = prefixes[i], found[i], sums[i]
        depth = len(prefix) // WIDTH
        leaves = leaves if children else 1
        saved += (row.n - 1) * _points(prefix, depth)
        above = found[at[prefix[:-WIDTH]]] if depth else None
        if depth:
            up = sums[at[prefix[:-WIDTH]]]
            up[0] += 1
            up[1] += leaves
            up[2] += saved
        out.append((row.low, depth, above.low if depth else None, i, row.n, children, leaves, saved,
                    row.ends or NO_ENDS))
    return out
