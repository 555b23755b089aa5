"""Benchmark decontamination (operator 9): spaced-seed hashing.

Fixed masks pick some of the token positions of a window, so that a hit survives substitutions at the others.
Seed hashes of the test items and of all documents are joined inside the tasks; each hit fixes an alignment
of item and document, and the alignment is verified token by token. The item index is sent to the tasks in
blocks of a bounded size; more items make more blocks, each a pass over the documents.

No allowed substitution is missed. A window of 13 tokens may differ in two, and each placement of two leaves one
of ``MASKS`` whole. An item shorter than a window may differ in k tokens, so one of its k + 1 parts of nearly
equal size is whole (pigeonhole); the parts are its seeds, the whole item where k is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from callweave.llm.common import small_batches, table, text_bytes

#: Masks of weight five and span up to ten: 1 positions must agree.
MASKS = ("11111", "1101101", "11001011", "1010100101")
#: Words are what stays between ASCII characters that are neither letters nor digits.
SPLIT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def tokens(text: bytes) -> list[bytes]:
    """Words of ``text``, A-Z in lower case."""
    return text.translate(SPLIT).lower().split()


def picked(ids: np.ndarray, at: list[int], tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of ``ids`` in which all positions ``at`` are known (not 0)."""
    n = max(0, len(ids) - at[-1])
    known = np.ones(n, dtype=bool)
    for i in at:
        known &= ids[i : i + n] > 0
    places = np.flatnonzero(known)
    hashes = np.full(len(places), tag, dtype=np.uint64)
    for k, i in enumerate(at):
        hashes = (hashes ^ ids[places + i].astype(np.uint64)) * ODD[k % len(ODD)]
        hashes ^= hashes >> np.uint64(29)
    return places, hashes


class Index:
    """The seeds of one block of items: by picked positions, sorted hashes with item and place."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int, similarity: float):
        self.window, self.similarity = window, similarity
        self.vocabulary: dict[bytes, int] = {}
        self.items = [(i, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(t)], dtype=np.int64)) for i, t in items]
        found: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        for k, (_, ids) in enumerate(self.items):
            if not len(ids):
                continue
            if len(ids) >= window:
                cuts = [(tuple(i for i, x in enumerate(mask) if x == "1"), 0, len(ids)) for mask in MASKS]
            else:
                parts = len(ids) - self.least(len(ids)) + 1
                ends = [len(ids) * p // parts for p in range(parts + 1)]
                cuts = [(tuple(range(b - a)), a, b) for a, b in zip(ends, ends[1:])]
            for at, a, b in cuts:
                places, hashes = picked(ids[a:b], list(at), len(at))
                found.setdefault(at, []).extend(zip(hashes.tolist(), [k] * len(places), (places + a).tolist()))
        self.seeds = {}
        for at, entries in found.items():
            entries.sort()
            self.seeds[at] = (np.array([x[0] for x in entries], dtype=np.uint64), *(np.array([x[c] for x in entries], dtype=np.int64) for c in (1, 2)))

    def least(self, width: int) -> int:
        """Tokens of ``width`` that must agree."""
        return int(np.ceil(self.similarity * width - 1e-9))

    def ids(self, text: bytes) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in tokens(text)], dtype=np.int64)

    def alignments(self, ids: np.ndarray, room: int = 1 << 20) -> np.ndarray:
        """Distinct (item, place of its first token) of all hits; at most ``room`` hits are held before they are made distinct."""
        known = np.zeros((0, 2), dtype=np.int64)
        for at, (index, item, place) in self.seeds.items():
            places, hashes = picked(ids, list(at), len(at))
            low, high = np.searchsorted(index, hashes), np.searchsorted(index, hashes, side="right")
            hit = np.flatnonzero(high > low)
            size = high[hit] - low[hit]
            until = size.cumsum()
            while len(hit):
                n = max(1, int(np.searchsorted(until, room)))
                now, of = size[:n], np.repeat(hit[:n], size[:n])
                entry = np.arange(now.sum()) - np.repeat(now.cumsum() - now, now) + np.repeat(low[hit[:n]], now)
                known = np.unique(np.concatenate([known, np.stack([item[entry], places[of] - place[entry]], axis=1)]), axis=0)
                hit, size, until = hit[n:], size[n:], until[n:] - until[n - 1]
        return known

    def overlaps(self, ids: np.ndarray) -> dict[int, int]:
        """Item number -> most tokens of it found in one verified alignment."""
        best: dict[int, int] = {}
        for k, shift in self.alignments(ids).tolist():
            item = self.items[k][1]
            start, end = max(0, -shift), min(len(item), len(ids) - shift)
            width = min(self.window, len(item))
            if end - start >= width:
                same = item[start:end] == ids[start + shift : end + shift]
                runs = np.concatenate([[0], same.cumsum()])
                if (runs[width:] - runs[:-width]).max() >= self.least(width):
                    best[k] = max(best.get(k, 0), int(same.sum()))
        return best


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    if n <= 1:
        return [items]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == k) for k in range(n)]


def _indexes(benchmark: DataFrame, window: int, similarity: float, block_bytes: int) -> Iterator[Index]:
    for block in _blocks(benchmark, block_bytes):
        yield Index([(r[0], bytes(r[1])) for r in block.collect()], window, similarity)


def contaminations(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, similarity: float = 0.8, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, matched, item_tokens, contaminated`` (true).

    A document holds an item if an alignment agrees in at least ``similarity`` of some ``window`` tokens in a
    row (of all tokens of a shorter item; under five tokens, all). ``matched`` counts the agreeing tokens of the best
    alignment. Null texts and items without a token are in nothing. Repeated rows and items give repeated results.
    Extra columns are ignored. An empty table on either side gives no rows.
    """
    source = text_bytes(docs, "doc_id")
    kind = dict(source.dtypes)["doc_id"]
    item_kind = dict(benchmark.dtypes)["item_id"]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = []
    for index in _indexes(benchmark, window, similarity, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, index.items[k], n) for i, t in enumerate(batch.column(1)) for k, n in sorted(index.overlaps(index.ids(t.as_py())).items())]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(at), "item_id": pa.array([r[1][0] for r in rows], item_type), "matched": pa.array([r[2] for r in rows], pa.int64()), "item_tokens": pa.array([len(r[1][1]) for r in rows], pa.int64())})

        parts.append(source.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, matched long, item_tokens long"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumn("contaminated", F.lit(True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, similarity: float = 0.8, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents, all their columns, that hold no item in the sense of ``contaminations``; null texts stay. One pass a block, no shuffle."""
    small_batches(docs.sparkSession)
    for index in _indexes(benchmark, window, similarity, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index, at: int = docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not index.overlaps(index.ids((t.as_py() or "").encode())) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over ``documents`` and ``benchmark``. Null texts hold nothing; an empty table gives no rows."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
