"""Conversation prefix trie (operator 13): whole-sequence collapse.

Conversations are rebuilt from the first turns of a base conversation and their own rest. Identical ones
collapse to one weighted sequence with the list of conversations that end there; sequences that no other one
extends (an anti-join with all proper prefixes) are the leaves; then the prefixes of the distinct sequences
are summed by weight. A prefix is known by its depth and the exclusive or of the 128-bit hashes of its turns,
each tagged with its position, so a running value gives all prefixes of a sequence in linear work.

Nothing is summed level by level. In the subtree of a node the words of all members behind it are their
totals less the words before the node, and the words of distinct nodes are those that each sequence owns:
a sequence owns the nodes whose smallest member it stands for, which are the end of its path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import WORD, small_batches, table
from callweave.session import materialize, release

#: Bytes of an end list's piece: longer lists are joined from several.
PIECE = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "x", "y"]


def running(df: DataFrame, key: str, *order: str, xors: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``nth`` (from 1, by ``order`` inside of ``key``) and the running values of ``xors`` and ``sums``.

    Rows are dealt by ranges of (key, order), so that one key's rows lie in as many tasks as they fill. A task
    numbers its own rows; what its first key has in tasks before it is added from one row a task. The files are
    those of the result (``release``).
    """
    small_batches(df.sparkSession)
    names, folded = df.columns, [*xors, *sums]
    at, plain = names.index(key), [c for c in names if c not in folded]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, have, carry = None, 0, dict.fromkeys(folded, 0)
        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            n = len(keys)
            if not n:
                continue
            new = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            first = ~new[start]  # rows of the key that began in an earlier batch
            nth = np.arange(n) - start + 1 + np.where(first, have, 0)
            out = [pa.array(nth, pa.int64())]
            for c in folded:
                v = batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.bitwise_xor.accumulate(v) if c in xors else v.cumsum()
                before, ahead = np.where(start > 0, total[start - 1], 0), np.where(first, carry[c], 0)
                total = total ^ before ^ ahead if c in xors else total - before + ahead
                carry[c] = int(total[-1])
                out.append(pa.array(total, pa.int64()))
            last, have = keys[-1], int(nth[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in plain), *out], names=[*plain, "nth", *folded])

    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in dealt.dtypes if c in plain), "nth long", *(f"`{c}` long" for c in folded)])
    placed = materialize(dealt.mapInArrow(number, schema).withColumn("task", F.spark_partition_id()))
    # A row a task: what its last key has up to its end; the next task goes on from there if it begins with that key.
    ends = placed.groupBy("task").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(F.struct("nth", *folded), F.struct(key, "nth")).alias("end"))
    so_far = Window.partitionBy("last").orderBy("task")
    total = F.struct(F.sum("end.nth").over(so_far).alias("nth"), *((F.bit_xor if c in xors else F.sum)(F.col("end")[c]).over(so_far).alias(c) for c in folded))
    row = Window.orderBy("task")
    carried = ends.select("task", "first", "last", total.alias("total")).select("task", F.col("first").alias(key), F.lag("last").over(row).alias("before"), F.lag("total").over(row).alias("total"))
    joined = placed.join(F.broadcast(carried.where(F.col("before") == F.col(key)).select("task", key, "total")), ["task", key], "left")
    ahead = {c: F.coalesce(F.col("total")[c], F.lit(0).cast("long")) for c in ("nth", *folded)}
    out = joined.select(*plain, *((F.col(c).bitwiseXOR(ahead[c]) if c in xors else F.col(c) + ahead[c]).alias(c) for c in ("nth", *folded)))
    out._written_to = placed._written_to
    return out


def rebuilt(conversations: DataFrame, *, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """A row a rebuilt turn, ``(c, depth, x, y, up_x, up_y, w, spent)``, with the running hash up to it and before it, its words and those up to it; a row a conversation ``(c)``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    own = running(turns, "c", "turn", "role", "text")
    hashed = lambda seed: F.xxhash64(F.lit(seed), "role", "text")
    written = materialize(own.select("c", "nth", hashed(1).alias("x"), hashed(2).alias("y"), F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("w")))
    release(own)
    sizes = written.groupBy("c").agg(F.count("*").alias("size"))
    head = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    asked = sizes.select("c", head.alias("h"), (F.col("c") - F.pmod("c", F.lit(block))).alias("base"))
    taken = asked.join(sizes.select(F.col("c").alias("base"), F.col("size").alias("base_size")), "base", "left")
    taken = materialize(taken.select("c", "h", "base", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken")))
    # A base has at most ``block`` conversations that take its first ``heads - 1`` turns at most.
    first = written.where(F.col("nth") < heads).select(F.col("c").alias("base"), "nth", "x", "y", "w")
    lead = taken.join(first, "base").where(F.col("nth") <= F.col("h")).select("c", F.col("nth").alias("depth"), "x", "y", "w")
    rest = written.join(taken, "c").where(F.col("nth") > F.col("h")).select("c", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), "x", "y", "w")
    tag = lambda seed: F.xxhash64("depth", "x", "y", F.lit(seed))
    tagged = lead.unionAll(rest).select("c", "depth", tag(3).alias("x"), tag(4).alias("y"), tag(3).alias("own_x"), tag(4).alias("own_y"), "w", F.col("w").alias("spent"))
    turns = running(tagged, "c", "depth", xors=("x", "y"), sums=("spent",))
    path = turns.select("c", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("own_x")).alias("up_x"), F.col("y").bitwiseXOR(F.col("own_y")).alias("up_y"), "w", "spent")
    path._written_to = turns._written_to
    release(written)
    return path, taken.select("c")


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, x, y, ends_sha256)`` of ``ends(depth, x, y, c)``: ids of a sequence in ascending order, comma-joined, hashed.

    Ids are dealt by ranges and joined to pieces where they lie, so one sequence's ids fill many tasks; a
    digest then reads its pieces one after the other, as SHA-256 must.
    """
    small_batches(ends.sparkSession)
    dealt = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, low, ids, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for *at, c in zip(*(x.to_pylist() for x in batch.columns)):
                if ids and (at != node or size >= PIECE):
                    out.append((*node, low, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, low = at, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(out) >= 1000 or sum(len(x[-1]) for x in out) > 8 * PIECE:
                yield batch_of(out)
                out = []
        if ids:
            out.append((*node, low, ",".join(ids)))
        yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=[*NODE, "low", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for *at, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if at == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = at, hashlib.sha256(ids.encode())
            yield said(out)
        if node is not None:
            yield said([(*node, state.hexdigest())])

    def said(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names=[*NODE, "ends_sha256"])

    pieces = dealt.mapInArrow(join, "depth long, x long, y long, low long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "low").mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, block: int = 20, heads: int = 4) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns stand in ascending order, null first; equal ones by role, then text. Conversation c takes the first
    crc32(c) % ``heads`` turns of the first conversation of its ``block`` of ids. Null roles and texts are
    empty; rows of a null id belong to no conversation. Repeated rows are turns of their own. A conversation
    without turns ends at the root. Extra columns of any name are ignored. An empty table gives no rows.
    """
    path, convs = rebuilt(conversations, block=block, heads=heads)
    zero = F.lit(0).cast("long")
    last = path.groupBy("c").agg(F.max_by(F.struct(*NODE), "depth").alias("end"), F.max("spent").alias("total"))
    last = convs.join(last, "c", "left").select("c", *(F.coalesce(F.col("end")[k], zero).alias(k) for k in NODE), F.coalesce("total", zero).alias("total"))
    last = materialize(last)
    # Whole-sequence collapse: one weighted sequence stands for all conversations that equal it.
    sequences = materialize(last.groupBy(*NODE).agg(F.min("c").alias("c"), F.count("*").alias("weight"), F.max("total").alias("total")))
    stand = sequences.select("c", "weight", "total", F.col("depth").alias("until"))
    fields = ["c", "weight", "total", "until", *NODE, "up_x", "up_y", "w", "spent"]
    root = stand.select("*", *(zero.alias(k) for k in fields[4:]))
    prefixes = materialize(path.join(stand, "c").select(*fields).unionAll(root.select(*fields)))
    # Leaves are the sequences that are no proper prefix of another one.
    inner = prefixes.where(F.col("depth") < F.col("until")).select(*NODE).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("c", F.lit(1).cast("long").alias("leaf"))
    prefixes_of = prefixes.join(leaves, "c", "left")
    counts = [F.min("c").alias("conv_id"), F.sum("weight").alias("n_convs"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves"), F.max("w").alias("w"), F.max("spent").alias("spent"), F.max(F.struct("up_x", "up_y")).alias("up"), F.sum(F.col("weight") * F.col("total")).alias("all")]
    nodes = materialize(prefixes_of.groupBy(*NODE).agg(*counts))
    # A sequence owns its path from the first node whose smallest member it is.
    owned = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("depth").alias("from"), F.min_by(F.col("spent") - F.col("w"), "depth").alias("ahead"))
    owned = prefixes.join(owned, "c", "left")
    inside = F.col("total") - (F.col("spent") - F.col("w"))
    distinct = F.when(F.col("from").isNull(), 0).when(F.col("depth") >= F.col("from"), inside).otherwise(F.col("total") - F.col("ahead"))
    words = owned.groupBy(*NODE).agg(F.sum(distinct).alias("distinct"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up.up_x").alias("x"), F.col("up.up_y").alias("y")).agg(F.count("*").alias("n_children"))
    ends = end_digests(last)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    flat = nodes.select(*NODE, "conv_id", "n_convs", "n_leaves", "w", "spent", "all", F.col("up.up_x").alias("up_x"), F.col("up.up_y").alias("up_y"))
    flat = flat.join(words, NODE).join(children, NODE, "left").join(ends, NODE, "left").join(parents, ["depth", "up_x", "up_y"], "left")
    saved = F.col("all") - F.col("n_convs") * (F.col("spent") - F.col("w")) - F.col("distinct")
    found = flat.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    found = materialize(found)
    release(path, last, sequences, prefixes, nodes)
    return found


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over ``conversations``."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
