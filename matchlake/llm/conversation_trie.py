"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id has 20 bytes: 128 bits of hash of role and text, then the code points of the text, both
big-endian. A conversation is the string of its turns' ids; equal conversations are one key.
The distinct keys are range partitioned and sorted by Spark. Each task cuts its range into blocks of
bounded size and builds one adaptive radix tree per block, with node layouts that grow from 4 to 16, 48
and 256 children and with compressed paths; a walk emits nodes only at depths that are whole turns.

Nodes that are no prefix of the first or last key of their block are complete. The others are open: a
neighbour may hold a part. Their parts are added up by Spark, block by block, and the sums of
a subtree go up along the two paths of a block, each open node counted in one block only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import staged

#: Bytes of a turn's id: hash, then length.
ID_BYTES = 20
_HASH_BYTES = 16
#: Keys of a radix tree, at most.
BLOCK_KEYS = 20_000
#: Bytes of keys after which a block ends.
BLOCK_BYTES = 16_000_000
#: Lists of ids hold those that agree but for so many low bits; further ones are fed to the hash row by row.
CHUNK_BITS = 12
#: Turns of the base conversation that a conversation can begin with.
MOST_SHARED = 5
#: Conversations that share one base.
FAMILY = 100

_NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- rebuilt conversations --------------------------------------------------


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn, in hexadecimal."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    name = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(name, F.lower(F.lpad(F.hex(F.char_length(text).cast("long")), 8, "0")))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the ids of its turns in order; turns of one number go by role, then by id."""
    there = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            turn_id(F.col("role"), F.col("text")).alias("id"),
        ).alias("it"),
    )
    in_order = F.sort_array(F.collect_list("it"))
    return there.groupBy("conv_id").agg(in_order.alias("it")).select("conv_id", F.col("it.id").alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key: the first h turns of the base conversation, then the own ones after the first h."""
    own = staged(conversation_turns(conversations))
    base = own.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("shared")
    )
    none = F.array().cast("array<string>")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    mine = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    both = mine.join(base, "base", "left").withColumn("h", h)
    turns = F.concat(
        F.when(F.col("h") > 0, F.slice(F.coalesce("shared", none), 1, F.greatest("h", F.lit(1)))).otherwise(none),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))),
    )
    return both.select("conv_id", F.unhex(F.array_join(turns, "")).alias("key"))


# ---- lists of ids -----------------------------------------------------------


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the joined texts of each key; rows come sorted by key and order."""
    key, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends"])

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != key:
                if key is not None:
                    yield done()
                key, digest = name, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if key is not None:
        yield done()


def distinct_keys(conversations: DataFrame) -> DataFrame:
    """key, conv_id (the smallest), n (conversations), ends (hash of their ids, joined in order).

    Ids go into lists by their value, so the lists of a key that very many share are made in
    many tasks and have a bounded length; only their hash, one pass by its nature, is fed in one
    place, from sorted rows that stream by.
    """
    ids = F.sort_array(F.collect_list("conv_id"))
    made = staged(rebuilt(conversations).withColumn("name", F.unhex(F.md5("key"))))
    parts = (
        made.groupBy("name", F.shiftright("conv_id", CHUNK_BITS).alias("part"))
        .agg(F.array_join(ids, ",").alias("text"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    )
    parts = staged(parts)
    keys = parts.groupBy("name").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
    )
    keys = staged(keys)
    one = parts.join(keys.filter("parts = 1").select("name"), "name").select("name", F.sha2("text", 256).alias("ends"))
    several = (
        parts.join(keys.filter("parts > 1").select("name"), "name").repartition("name")
        .sortWithinPartitions("name", "part").select("name", "text")
        .mapInArrow(_streamed, "name binary, ends string")
    )
    # the smallest conversation of a key brings the key itself
    return (
        keys.join(one.unionByName(several), "name").select("conv_id", "n", "ends")
        .join(made.select("conv_id", "key"), "conv_id").select("key", "conv_id", "n", "ends")
    )


# ---- adaptive radix tree ----------------------------------------------------


class Node:
    """Inner node: a compressed path and children by their first byte, in one of four layouts.

    Up to 4 and up to 16 children stand in sorted lists, up to 48 behind an index of 256 places,
    more in 256 places.
    """

    __slots__ = ("path", "layout", "bytes", "children", "value")

    def __init__(self, path: bytes):
        self.path = path
        self.layout = 4
        self.bytes: bytearray | None = bytearray()
        self.children: list = []
        self.value: tuple | None = None

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child, or take another in its place."""
        if self.layout <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.children[at] = node
                return
            if len(self.bytes) == self.layout:
                self._grow()
                return self.put(byte, node)
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.children.insert(at, node)
        elif self.layout == 48:
            at = self.bytes[byte]
            if at:
                self.children[at - 1] = node
            elif len(self.children) == 48:
                self._grow()
                self.put(byte, node)
            else:
                self.children.append(node)
                self.bytes[byte] = len(self.children)
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for i, byte in enumerate(self.bytes):
                index[byte] = i + 1
            self.layout, self.bytes = 48, index
        else:
            places = [None] * 256
            for byte, at in enumerate(self.bytes):
                if at:
                    places[byte] = self.children[at - 1]
            self.layout, self.bytes, self.children = 256, None, places

    def in_order(self) -> list[Node]:
        """Children by their bytes."""
        if self.layout <= 16:
            return self.children
        if self.layout == 48:
            return [self.children[at - 1] for at in self.bytes if at]
        return [c for c in self.children if c is not None]


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agree, a[:high] do not
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    """Adaptive radix tree with path compression; keys may begin one another."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: tuple) -> None:
        node, at, above = self.root, 0, None
        while True:
            path = node.path
            rest = key[at : at + len(path)]
            same = _shared(path, rest)
            if same < len(path):  # split the path
                upper = Node(path[:same])
                node.path = path[same:]
                upper.put(node.path[0], node)
                if above is None:
                    self.root = upper
                else:
                    above.put(upper.path[0], upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                leaf = Node(key[at:])
                leaf.value = value
                node.put(key[at], leaf)
                return
            above, node = node, below


class _Turn:
    """A node of the trie while the walk is below it."""

    __slots__ = ("name", "chars", "left", "right", "conv", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, name: bytes | None, chars: int, left: bool, right: bool):
        self.name, self.chars, self.left, self.right = name, chars, left, right
        self.n = self.children = self.leaves = self.saved = 0
        self.conv: int | None = None
        self.ends = _NO_ENDS
        self.waiting: list[tuple] = []  # finished children that lack the smallest member of this node

    @property
    def open(self) -> bool:
        return self.left or self.right

    @property
    def side(self) -> int:
        return -1 if not self.open else 0 if self.left and self.right else 1 if self.left else 2


#: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; of open nodes parts.
NODES = (
    "block long, side int, name binary, parent binary, chars long, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def walk(tree: RadixTree, first: bytes, last: bytes) -> Iterator[tuple]:
    """Rows of ``NODES`` without the block, from the nodes of one tree; only whole turns give nodes.

    A node that the first or the last key begins with is open: ``side`` is 0 if both do, 1 or 2 if only
    the first or the last one does, and -1 for all other nodes.
    """

    def enter(key: bytes, depth: int) -> _Turn:
        if not depth:
            return _Turn(hashlib.md5(b"").digest(), 0, True, True)
        at = (depth - 1) * ID_BYTES
        turn, above = key[at : at + ID_BYTES], stack[-1]
        left, right = above.left and first.startswith(turn, at), above.right and last.startswith(turn, at)
        # the name of a node is chained from its parent's
        name = hashlib.md5(above.name + turn).digest() if left or right else None
        return _Turn(name, int.from_bytes(turn[_HASH_BYTES:], "big"), left, right)

    def leave(stack: list[_Turn]) -> Iterator[tuple]:
        me, depth = stack.pop(), len(stack)
        if not me.open:
            me.leaves += not me.children
            me.saved += (me.n - 1) * me.chars
        for row in me.waiting:
            yield (*row[:6], None if me.open else me.conv, *row[7:])
        above = stack[-1] if stack else None
        row = (me.side, me.name, above.name if above else None, me.chars, me.conv, depth, None, me.n, me.children, me.leaves, me.saved, me.ends)
        if above is None:
            yield row
            return
        above.waiting.append(row)
        if above.open and len(above.waiting) >= 1000:  # they get their parent from the open node
            yield from above.waiting
            above.waiting = []
        above.conv = me.conv if above.conv is None else min(above.conv, me.conv)
        above.n += me.n
        above.children += not me.open
        above.leaves += me.leaves
        above.saved += me.saved

    # depth first without recursion: keys can be long
    stack: list[_Turn] = []
    todo: list[tuple] = [(tree.root, b"", True)]
    while todo:
        node, upper, entering = todo.pop()
        if not entering:
            for _ in range(upper):
                yield from leave(stack)
            continue
        key = upper + node.path
        low = len(upper) // ID_BYTES + (1 if upper or node is not tree.root else 0)
        entered = 0
        for depth in range(low, len(key) // ID_BYTES + 1):
            stack.append(enter(key, depth))
            entered += 1
        if node.value is not None:
            conv, n, ends = node.value
            me = stack[-1]
            me.n += n
            me.conv = conv if me.conv is None else min(me.conv, conv)
            me.ends = ends
        todo.append((None, entered, False))
        todo += [(c, key, True) for c in reversed(node.in_order())]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over blocks of sorted keys, as rows of ``NODES``."""
    task = TaskContext.get().partitionId()
    number = 0
    held: list[tuple] = []
    size = 0
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]
    names = [f.strip().split(" ")[0] for f in NODES.split(",")]

    def finish() -> Iterator[pa.RecordBatch]:
        tree = RadixTree()
        for key, *value in held:
            tree.insert(key, tuple(value))
        block, rows = (task << 32) | number, []
        for row in walk(tree, held[0][0], held[-1][0]):
            rows.append((block, *row))
            if len(rows) == 5000:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[0])
            if len(held) >= BLOCK_KEYS or size >= BLOCK_BYTES:
                yield from finish()
                number, held, size = number + 1, [], 0
    if held:
        yield from finish()


# ---- the trie ---------------------------------------------------------------


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation and are left out; null turns come first, null role
    or text is empty; turns of one number are in the order of role and then of id, repeated rows
    stay. Conversations that are rebuilt without a turn are members of the root. An empty table has no
    members and so no nodes. Texts of any length are hashed where they are read; a conversation is one
    row of 20 bytes a turn. Further columns of any name are not looked at.
    """
    keys = distinct_keys(conversations).select("key", "conv_id", "n", "ends")
    ranged = staged(keys).repartitionByRange("key").sortWithinPartitions("key")
    nodes = staged(ranged.mapInArrow(_blocks, NODES))
    parts = staged(nodes.filter("side >= 0"))
    # what all blocks say about an open node; it is counted in the first of them
    merged = parts.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"),
        F.min("block").alias("home"), F.max(F.when(F.col("ends_sha256") != _NO_ENDS, F.col("ends_sha256"))).alias("ends"),
    )
    here = parts.select("block", "side", "name", "parent", "depth", "chars", "n_leaves", "saved_tokens")
    homes = here.join(merged.select("name", "home"), "name").filter("block = home")
    opened = homes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("opened"))
    merged = staged(
        merged.join(opened.withColumnRenamed("parent", "name"), "name", "left")
        .withColumn("n_children", F.col("closed") + F.coalesce("opened", F.lit(0))).drop("closed", "opened")
    )
    known = staged(here.join(merged, "name"))
    counted = F.col("block") == F.col("home")
    known = known.withColumns({
        "own_saved": F.when(counted, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0),
        "own_leaf": F.when(counted & (F.col("n_children") == 0), 1).otherwise(0),
    })
    # along the paths of a block: a node of both paths stands above all of either
    block = Window.partitionBy("block")
    below = Window.partitionBy("block", "side").orderBy(F.desc("depth"))

    def under(column: str) -> Column:
        forks = F.sum(F.when(F.col("side") > 0, F.col(column)).otherwise(0)).over(block)
        return F.sum(column).over(below) + F.when(F.col("side") == 0, forks).otherwise(0)

    sums = (
        known.withColumns({"up_saved": under("own_saved"), "up_leaf": under("own_leaf")})
        .groupBy("name").agg(
            F.sum(F.col("n_leaves") + F.col("up_leaf")).alias("n_leaves"),
            F.sum(F.col("saved_tokens") + F.col("up_saved")).alias("saved_tokens"),
        )
    )
    # the smallest member of a parent is looked up in the block where the child is counted
    parents = known.select("block", F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    open_nodes = (
        known.filter(counted).select("block", "name", "parent", "conv_id", "depth", "n_convs", "n_children", "ends")
        .join(parents, ["block", "parent"], "left").join(sums, "name")
        .withColumn("ends_sha256", F.coalesce("ends", F.lit(_NO_ENDS)))
    )
    closed = nodes.filter("side < 0").drop("name", "chars", "side")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = closed.filter("parent is null").select(*columns)
    outer = closed.filter("parent is not null").drop("parent_conv_id").join(parents, ["block", "parent"]).select(*columns)
    return open_nodes.select(*columns).unionByName(inner).unionByName(outer)
