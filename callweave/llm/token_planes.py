"""Token-ID / binary output (operator 7): bit-plane shuffling.

Format: a Parquet table of chunks, so that Spark's committer keeps it whole when a task is tried again. A
chunk holds whole documents: ``shard`` (number of the range of ids), ``chunk`` (number inside it), ``first``
(ids of the shard before it), the index ``doc_ids`` and ``n_tokens``, ``n_ids``, ``plane_sizes`` and
``planes``. The ids, little-endian unsigned 32-bit, are cut into blocks of ``BLOCK`` (the last filled with
zeros); each block is transposed to four byte planes or 32 bit planes, and every plane is compressed with
zstandard by itself. ``plane_sizes`` lists the planes of the first block, then of the next, so that any block
can be read without the others (``read_block``).
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.byte_bpe import Seen, blocks
from callweave.llm.common import small_batches, table
from callweave.session import shared_dir

BLOCK, CHUNK_IDS, END_ID = 1 << 14, 1 << 18, 2
#: Text of a block, pieces that are cut at once, parts encoded as one text and texts in one call, parts that a worker keeps (about 200 bytes each), and how the vocabulary writes a space.
BLOCK_BYTES, PIECES, TOGETHER, REMEMBERED, SPACE = 16 << 20, 50_000, 50, 700_000, "\u0120"
#: White space after a space, or a space at the end.
RUN = r" [\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| $"
#: Parts of pieces: letters, numbers and signs as far as these few make the end of a match certain, a line break before a letter, or the rest.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PART = re.compile(rf" ?[{LETTER}]+(?=[\x00-@\[-`{{-\x7f]|\Z)| ?[0-9]+(?=[\x00-/:-\x7f]|\Z)| ?[!-&(-/:-@\[-`{{-~]+(?=[A-Za-z0-9\n ]|\Z)|\n(?=[{LETTER}])| ?[^ ]+")
_tokenizers: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(ids: np.ndarray, mode: str = "byte") -> tuple[list[int], bytes]:
    """Sizes of all planes of all blocks, and the compressed planes of ids (unsigned 32-bit) one after the other."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    squeezed = []
    for at in range(0, len(ids), BLOCK):
        block = np.zeros(BLOCK, dtype="<u4")
        block[: min(BLOCK, len(ids) - at)] = ids[at : at + BLOCK]
        octets = np.ascontiguousarray(block.view(np.uint8).reshape(BLOCK, 4).T)
        planes = octets if mode == "byte" else [np.packbits(p >> bit & 1) for p in octets for bit in range(8)]
        squeezed += [squeeze(p.tobytes()) for p in planes]
    return [len(x) for x in squeezed], b"".join(squeezed)


def read_block(k: int, n_ids: int, sizes: list[int], data: bytes) -> np.ndarray:
    """The ids of block ``k`` of a chunk, from its own planes alone; the number of planes tells the mode."""
    each = len(sizes) // -(-n_ids // BLOCK)
    ends = np.cumsum(sizes)
    expand = zstandard.ZstdDecompressor().decompress
    planes = [np.frombuffer(expand(data[e - s : e]), dtype=np.uint8) for s, e in zip(sizes[k * each : (k + 1) * each], ends[k * each : (k + 1) * each])]
    if each == 4:
        octets = np.stack(planes, axis=-1)
    else:
        bits = np.stack([np.unpackbits(p, count=BLOCK) for p in planes]).reshape(4, 8, BLOCK)
        octets = (bits << np.arange(8, dtype=np.uint8)[:, None]).sum(axis=1, dtype=np.uint8).T
    return np.ascontiguousarray(octets).view("<u4").ravel()[: n_ids - k * BLOCK]


def unpack(n_ids: int, sizes: list[int], data: bytes) -> np.ndarray:
    """The ids of a chunk."""
    return np.concatenate([np.zeros(0, dtype="<u4"), *(read_block(k, n_ids, sizes, data) for k in range(-(-n_ids // BLOCK)))])


def kept(seen: Seen, uses: np.ndarray, most: int) -> tuple[Seen, np.ndarray]:
    """At most ``most`` of the strings that were used twice or more, the most used ones, and half their uses."""
    often = uses > max(1, np.partition(uses, -most - 1)[-most - 1])
    numbers, out = np.flatnonzero(often), Seen()
    out.name(itertools.compress(seen.numbers, often.tolist()))
    out.add(seen.ends[numbers + 1] - seen.ends[numbers], seen.ids(numbers))
    return out, uses[numbers] // 2


def encoder(path: str) -> Callable[[pa.Array | list[str]], list[bytes]]:
    """Texts to the bytes of their ids.

    The byte-level pattern always cuts before a single space between two other characters than white space, and
    no piece looks beyond such a cut, so each piece of the texts given together is looked at once. It also cuts
    where a run of letters, numbers or signs surely ends, so pieces are made of fewer parts (``PART``), which
    the tokenizer encodes once for a worker. New parts that begin with a space are encoded together as one text;
    only the first token of each begins with a space, which parts their ids again. A worker numbers its parts;
    once it knows more than ``REMEMBERED`` it keeps the more used half at most.
    """
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        leads[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        # Texts with one of the added tokens, which no pattern cuts, or with spaces in a run go to the tokenizer whole.
        whole = "|".join([RUN, *(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
        _tokenizers[path] = (tokenizer, leads, whole, [Seen(), np.zeros(0, dtype=np.int64)])
    tokenizer, leads, whole, known = _tokenizers[path]

    def alone(texts: list[str]) -> list[np.ndarray]:
        found = []
        for at in range(0, len(texts), TOGETHER):  # the library's encodings take many times the memory of their ids
            found += [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts[at : at + TOGETHER], add_special_tokens=False)]
        return found

    def learn(seen: Seen) -> None:
        parts = seen.new()
        spaced = np.fromiter((p[0] == " " for p in parts), dtype=bool, count=len(parts))
        sizes = np.zeros(len(parts), dtype=np.int64)
        after = [p for p in parts if p[0] == " "]
        joined = np.concatenate([np.zeros(0, dtype="<u4"), *alone(["".join(after[at : at + TOGETHER]) for at in range(0, len(after), TOGETHER)])])
        sizes[spaced] = np.diff(np.flatnonzero(leads[joined]), append=len(joined))
        others = alone([p for p in parts if p[0] != " "])
        sizes[~spaced] = [len(x) for x in others]
        ids, of_spaced = np.zeros(sizes.sum(), dtype=np.uint32), np.repeat(spaced, sizes)
        ids[of_spaced], ids[~of_spaced] = joined, np.concatenate([np.zeros(0, dtype="<u4"), *others])
        seen.add(sizes, ids)

    def spell(pieces: pa.Array) -> pa.Array:
        """The bytes of the ids of pieces, each after a space."""
        seen, named = known[0], [np.zeros(0, dtype=np.int32)]
        for at in range(0, len(pieces), PIECES):
            some = pieces.slice(at, PIECES)
            named.append(seen.name(PART.findall(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py())))
        learn(seen)
        named = np.concatenate(named)
        uses = np.bincount(named, minlength=len(seen.numbers))
        uses[: len(known[1])] += known[1]
        known[1] = uses
        ends, starts = (seen.ends[named + 1] - seen.ends[named]).cumsum(), np.flatnonzero(leads[seen.flat[seen.ends[named]]])
        ends = np.concatenate([[0], ends[starts[1:] - 1], ends[-1:]]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(4 * ends), pa.py_buffer(seen.ids(named).astype("<u4"))])

    def encode(texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if len(known[0].numbers) > REMEMBERED:
            known[:] = kept(*known, REMEMBERED // 2)
        plain = pc.invert(pc.match_substring_regex(texts, whole))
        cut = pc.split_pattern(texts.filter(plain), " ")
        starts, pieces = cut.offsets.to_numpy(), cut.values
        firsts, later = pa.array(starts[:-1]), np.ones(len(pieces), dtype=bool)
        later[starts[:-1]] = False
        # A text's first piece has no space before it.
        heads, others = iter(alone(pieces.take(firsts).to_pylist())), iter(alone(texts.filter(pc.invert(plain)).to_pylist()))
        coded = pieces.filter(pa.array(later)).dictionary_encode()
        del cut, pieces, later
        found = spell(coded.dictionary).take(coded.indices)
        at, data = (np.frombuffer(found.buffers()[1], dtype=np.int64), memoryview(found.buffers()[2])) if len(found) else (np.zeros(1, dtype=np.int64), b"")
        bounds = at[starts - np.arange(len(starts))].tolist()
        spans = iter(zip(bounds, bounds[1:]))
        out = []
        for is_plain in plain.to_pylist():
            if is_plain:
                lo, hi = next(spans)
                out.append(next(heads).tobytes() + data[lo:hi])
            else:
                out.append(next(others).tobytes())
        return out

    return encode


def gathered(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[list[pa.Array]]:
    """The two columns of batches, in blocks with about ``block_bytes`` of text or one longer text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in blocks(batches, block_bytes):
        if held and size + part.column(1).nbytes > block_bytes:
            yield [pa.concat_arrays([p.column(k) for p in held]) for k in range(2)]
            held, size = [], 0
        held.append(part)
        size += part.column(1).nbytes
    if held:
        yield [pa.concat_arrays([p.column(k) for p in held]) for k in range(2)]


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS, mode: str = "byte") -> None:
    """Write the ids of every whole text (null: empty), each with ``end_id`` behind, in ascending doc_id order.

    Equal ids stand in the order of their texts' hashes; null ids come first. Extra columns are ignored. An
    empty table gives a format without chunks.
    """
    tokenizer = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    source = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    kind = dict(source.dtypes)["doc_id"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        names: list = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            sizes, planes = pack(ids, mode)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "first": pa.array([first], pa.int64()), "doc_ids": pa.array([names], pa.list_(id_type)), "n_tokens": pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())), "n_ids": pa.array([len(ids)], pa.int64()), "plane_sizes": pa.array([sizes], pa.list_(pa.int64())), "planes": pa.array([planes], pa.binary())})

        size = 0
        for ids, texts in gathered(batches, BLOCK_BYTES):
            id_type = ids.type
            for name, found in zip(ids.to_pylist(), encode(texts)):
                names.append(name)
                parts.append(found + end)
                size += len(parts[-1]) // 4
                if size >= chunk_ids:
                    yield flush()
                    chunk, first, names, parts, size = chunk + 1, first + size, [], [], 0
        if parts:
            yield flush()

    schema = f"shard int, chunk int, first long, doc_ids array<{kind}>, n_tokens array<long>, n_ids long, plane_sizes array<long>, planes binary"
    source.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32``, with ``ids`` the ids themselves too."""
    chunks = spark.read.parquet(path)
    kind = dict(chunks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    # A row of two numbers a shard, as many as the writing tasks were (100,000 make 2 MB): one task sums them, all get the result.
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    placed = chunks.join(F.broadcast(before), "shard").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "n_tokens", "n_ids", "plane_sizes", "planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, counts, n, sizes, data = (batch.column(k)[i] for k in range(6))
                found = unpack(n.as_py(), sizes.as_py(), data.as_py()).tobytes()
                counts = np.array(counts.as_py(), dtype=np.int64)
                ends = counts.cumsum()
                cut = [found[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                out = {"doc_id": docs.values, "start": pa.array(start.as_py() + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64())}
                if ids:
                    out["ids"] = pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in cut], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def token_table(docs: DataFrame, *, path: str | None = None, tokenizer: str | None = None, mode: str = "byte") -> DataFrame:
    """Write ``docs`` to ``path`` (not there yet; none: a new folder of the shared one) and read the documents' digests back from its files."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-planes-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer=tokenizer, mode=mode)
    return read_tokens(spark, path)


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over ``documents``, in byte planes. Null texts have the end id alone; an empty table gives no rows."""
    return token_table(table(spark, sf_dir, "documents"))
