"""Phrase collocation mining (operator 11): SON partitioning.

The corpus is dealt to a few shards. A phrase of ``support`` occurrences has its proportional part of them in at
least one shard, so mining every shard completely at that lowered support misses none; the union of what is
frequent in any shard is then counted exactly in the whole corpus. A shard is a part of the corpus, not of a
task: with a support that doesn't grow with the corpus, one shard a task would have a local support of one and
keep every phrase. So shards are mined by all tasks together.

Texts are packed to chunks of one language. Mining sends sorted hashes of phrases with their counts in a
chunk, packed by ranges of hashes whose number follows the size of the corpus; a range is summed by shard in
one task, and hashes that are frequent in a shard go back to the chunks that hold them. A hash only ever lets
too many phrases through: each chunk then counts its candidates by their words, and these counts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import table, text_bytes
from callweave.session import materialize, release

#: The contract's letters, ends of pieces and spaces, as one table of bytes; none is part of another UTF-8 character.
TRANSLATION = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: A byte that no UTF-8 text holds stands for the end of a piece among the words.
END = b"\xff"
#: Bytes of a chunk's text and of a row of it, hashes of a range, bits of a hash.
CHUNK_BYTES, SLICE_BYTES, RANGE_KEYS, KEY_BITS = 8 << 20, 1 << 16, 2_000_000, 48


def packed(keys: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their differences, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().cumsum(dtype=np.uint64)


def slices(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``data`` cut at ends of pieces into parts of ``size`` bytes, or of one longer piece."""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= size else data.rfind(b"\n", at, at + size) + 1
        end = end or data.find(b"\n", at + size) + 1 or len(data)
        yield data[at:end]
        at = end


def chunked(docs: DataFrame, *, lang: str = "lang", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The corpus as rows ``chunk, lang, n_words, data`` of lower-cased text whose pieces end with a line feed.

    Rows of a chunk hold one language and lie side by side. A task fills one chunk a language and closes the
    largest whenever all together reach ``chunk_bytes``, so that its memory doesn't grow with the languages.
    """
    source = text_bytes(docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs["text"].alias("text")), "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, total, filling, sizes = TaskContext.get().partitionId(), 0, 0, {}, {}

        def close(name: str) -> pa.RecordBatch:
            nonlocal made, total
            made += 1
            total -= sizes.pop(name)
            parts = [x for text in filling.pop(name) for x in slices(text)]
            rows, kept = [], []
            for part in parts:  # short texts share a row
                if kept and sum(map(len, kept)) + len(part) > SLICE_BYTES:
                    rows.append(b"".join(kept))
                    kept = []
                kept.append(part)
            rows += [b"".join(kept)] if kept else []
            n = len(rows)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([task << 32 | made] * n, pa.int64()), "lang": pa.array([name] * n, pa.string()), "n_words": pa.array([len(r.split()) for r in rows], pa.int64()), "data": pa.array(rows, pa.binary())})

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py().translate(TRANSLATION) + b"\n"
                filling.setdefault(name, []).append(data)
                sizes[name] = sizes.get(name, 0) + len(data)
                total += len(data)
                while total >= chunk_bytes:
                    yield close(max(sizes, key=sizes.get))
        for name in list(filling):
            yield close(name)

    return source.mapInArrow(run, "chunk long, lang string, n_words long, data binary")


class Numbered:
    """The words of a chunk by number, and its phrases of one to ``longest`` words by numbers and hashes."""

    def __init__(self, rows: list[bytes], lang: str):
        tokens = b"\n".join(rows).replace(b"\n", b" \xff ").split()
        self.words = [END, *set(tokens) - {END}]
        index = {w: i for i, w in enumerate(self.words)}
        self.ids = np.fromiter(map(index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], dtype=np.uint64)[self.ids]

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, first positions and hashes of the phrases of each size."""
        at, key = np.flatnonzero(self.ids), self.hashes
        for size in range(1, longest + 1):
            if size > 1:
                at = at[at + size - 1 < len(self.ids)]
                at = at[self.ids[at + size - 1] != 0]
                key = (key[: len(key) - 1] * np.uint64(0x9E3779B97F4A7C15) ^ (key[: len(key) - 1] >> np.uint64(29))) + self.hashes[size - 1 :]
            mixed = key[at] * np.uint64(0xC2B2AE3D27D4EB4F)
            yield size, at, (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - KEY_BITS)

    def spelled(self, size: int, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The distinct phrases that begin at ``at`` and their counts, told apart by their words."""
        group = self.ids[at]
        for k in range(1, size):
            pair = group << 32 | self.ids[at + k]
            _, first, group, counts = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        if size == 1:
            _, first, counts = np.unique(group, return_index=True, return_counts=True)
        return [b" ".join(self.words[i] for i in self.ids[p : p + size].tolist()).decode("utf-8", "replace") for p in at[first].tolist()], counts


def mined(chunks: DataFrame, *, support: int, shards: int, longest: int, range_keys: int = RANGE_KEYS) -> DataFrame:
    """``(chunk, keys)``: the hashes of each chunk's phrases that are frequent in some shard."""
    shard_of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    # One row a shard, of which there are few by definition.
    words = {r["shard"]: r["n"] for r in chunks.groupBy(shard_of("chunk").alias("shard")).agg(F.sum("n_words").alias("n")).collect()}
    total = sum(words.values())
    needs = np.array([max(1, -(-support * words.get(s, 0) // max(1, total))) for s in range(shards)], dtype=np.int64)
    bits = max(0, (longest * total // range_keys).bit_length())
    cut = np.uint64(KEY_BITS - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, shard, lang, rows in runs(batches):
            keys = np.concatenate([keys for _, _, keys in Numbered(rows, lang).phrases(longest)])
            if not len(keys):
                continue
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
            keys, counts = keys[first], np.diff(first, append=len(keys)).astype(np.uint32)
            ranges = (keys >> cut).astype(np.int64)
            starts = np.flatnonzero(np.diff(ranges, prepend=-1))
            squeeze = zstandard.ZstdCompressor(level=1).compress
            out = [(int(ranges[a]), shard, chunk, packed(keys[a:b]), squeeze(counts[a:b].tobytes())) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])]
            for at in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out[at : at + 500]), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "shard", "chunk", "keys", "counts"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, rows = None, []
        for batch in batches:
            for chunk, shard, lang, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (chunk, shard, lang) != now:
                    if rows:
                        yield *now, rows
                    now, rows = (chunk, shard, lang), []
                rows.append(data)
        if rows:
            yield *now, rows

    def keep(group: pa.Table) -> pa.Table:
        blobs = [unpacked(x.as_py()) for x in group.column("keys")]
        expand = zstandard.ZstdDecompressor().decompress
        keys, row = np.concatenate(blobs), np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
        counts = np.concatenate([np.frombuffer(expand(x.as_py()), dtype=np.uint32) for x in group.column("counts")])
        shard, chunk = (group.column(c).to_numpy() for c in ("shard", "chunk"))
        order = keys.argsort(kind="stable")
        keys, row, counts = keys[order], row[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
        frequent = np.zeros(len(starts), dtype=bool)
        for s in np.unique(shard).tolist():
            frequent |= np.add.reduceat(np.where(shard[row] == s, counts, 0), starts) >= needs[s]
        here = np.repeat(frequent, np.diff(starts, append=len(keys)))
        keys, at = keys[here], chunk[row[here]]
        order = np.lexsort((keys, at))
        keys, at = keys[order], at[order]
        cuts = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))
        rows = [(int(at[a]), packed(keys[a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)])]
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    sent = chunks.select("chunk", shard_of("chunk").alias("shard"), "lang", "data").mapInArrow(send, "range long, shard int, chunk long, keys binary, counts binary")
    return sent.groupBy("range").applyInArrow(keep, "chunk long, keys binary")


def counted(chunks: DataFrame, candidates: DataFrame, *, longest: int) -> DataFrame:
    """``(lang, phrase, n)``: exact counts of all candidates in all chunks."""

    def count(keys: pa.Table, text: pa.Table) -> pa.Table:
        if not text.num_rows or not keys.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        wanted = np.unique(np.concatenate([unpacked(x.as_py()) for x in keys.column("keys")]))
        lang = text.column("lang")[0].as_py()
        numbered = Numbered([x.as_py() for x in text.column("data")], lang)
        phrases, counts = [], []
        for size, at, key in numbered.phrases(longest):
            place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            at = at[wanted[place] == key]
            if len(at):
                spelled, n = numbered.spelled(size, at)
                phrases += spelled
                counts.append(n)
        return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "n": pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *counts]), pa.int64())})

    each = candidates.groupBy("chunk").cogroup(chunks.select("chunk", "lang", "data").groupBy("chunk")).applyInArrow(count, "lang string, phrase string, n long")
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, *, lang: str = "lang", support: int = 10, shards: int = 4, longest: int = 3, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, f)`` of all phrases of 1 to ``longest`` words that occur ``support`` times or more, and ``(lang, n)``, the words of each language; both written."""
    chunks = materialize(chunked(docs, lang=lang, chunk_bytes=chunk_bytes))
    found = counted(chunks, mined(chunks, support=support, shards=shards, longest=longest), longest=longest)
    found = materialize(found.where(F.col("n") >= support).withColumnRenamed("n", "f"))
    totals = materialize(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    release(chunks)
    return found, totals


def collocations(docs: DataFrame, *, lang: str = "lang", support: int = 10, shards: int = 4, longest: int = 3, inside_percent: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    a, l and r are occurrences of a phrase and of its parts before and behind a cut, n the words of its language;
    the cut of the lowest floor(10^6 a a / (l r)) counts, of equals the first. A phrase is dropped if a longer
    candidate holds it and occurs ``inside_percent`` of a or more. Equal scores stand by a, then by the phrase's
    bytes. Counts are exact up to 10^16 occurrences (decimals of 38 digits). Null texts are empty, a null language is ``und``. Repeated rows count
    each. Extra columns of any name are ignored. An empty table gives no rows.
    """
    found, totals = frequent_phrases(docs, lang=lang, support=support, shards=shards, longest=longest)
    words = F.split("phrase", " ")
    phrases = found.withColumn("words", words).where(F.size("words") >= 2)
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    # Parts of a frequent phrase are frequent, so both are found.
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    big = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * {big('a')} * {big('a')} div ({big('l')} * {big('r')})")
    best = cut.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # The most frequent longer phrase around each; sums are made before rows move.
    spans = F.expr("flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), i -> array_join(slice(words, i, s), ' '))))")
    around = phrases.where(F.size("words") > 2).select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over ``documents``: phrases of two and three words, ten occurrences, four shards, 2000 a language."""
    return collocations(table(spark, sf_dir, "documents"))
