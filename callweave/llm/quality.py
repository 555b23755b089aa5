"""Quality rules (operator 2): base rules, then cross-document line frequency.

Each text is read once: a Python pass counts what the base rules need and hashes its normalised lines. The
line hashes are counted over all hosts (a document counts once for a line) with partial aggregation; the few
that pass the least limit are counted by host, too. Lines above their limits are joined back as hashes, and
documents that lose too much are rejected. Texts never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import table, text_bytes
from callweave.session import materialize

#: Symbols that the base rules count: fixed value of the contract.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Lines of so many words are long: that two documents share one by chance is out of the question.
LONG_WORDS = 20


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that occur twice or more in the text, first occurrences included.

    Windows get exact numbers by doubling: equal pairs of words, then of pairs, then of fours.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == n:
        return 0
    span = 1
    while span < width:
        both = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids, counts = np.unique(both, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        span *= 2
    twice = counts[ids] > 1
    covered = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((covered.cumsum()[:-1] > 0).sum())


def measure(text: bytes, long_words: int = LONG_WORDS) -> tuple[int, int, int, int, int, list[int], list[int], list[bool]]:
    """Words, their code points, symbols, duplicate lines, repeated words; of the distinct normalised lines hashes, words (of all repeats) and whether one has ``long_words`` or more."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()]
    sizes: dict[int, int] = {}
    long: dict[int, bool] = {}
    for line in lines:
        parts = line.lower().split()
        h = xxhash.xxh64_intdigest(b" ".join(parts), 0) - (1 << 63)
        sizes[h] = sizes.get(h, 0) + len(parts)
        long[h] = len(parts) >= long_words
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), list(sizes), list(sizes.values()), list(long.values())


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), long_words: int = LONG_WORDS) -> DataFrame:
    """One row per document with the base counts and its lines, written so that ``row`` stays as it is."""
    source = text_bytes(docs.withColumn("__row", F.monotonically_increasing_id()), *keep, "__row")
    types = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>, line_long array<boolean>"
    fields = [*(f"{c}" for c in keep), "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "line_long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[measure(t.as_py(), long_words) for t in batch.column(len(keep) + 1)])) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *(pa.array(x, k) for x, k in zip(found, kinds))], names=fields)

    return materialize(source.mapInArrow(run, schema))


def quality(docs: DataFrame, *, host: str = "source", max_docs: int = 8, max_share: float = 0.05, long_words: int = LONG_WORDS, least_share: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words``.

    A line of ``long_words`` or more words that more than ``max_docs`` documents of all hosts carry is removed. A
    shorter one is removed from a host if more than ``max_docs`` and more than ``max_share`` of its documents carry
    it, and from all hosts if that holds for all documents. A document is kept if it passes the base rules and has at least ``least_share`` of its words left. Null and empty texts have no words and
    fail. Repeated rows are documents of their own. A null host is a host. Extra columns are ignored. An empty
    table gives no rows.
    """
    rows = measured(docs, tuple(dict.fromkeys(("doc_id", host))), long_words)
    lines = rows.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "row", F.explode(F.arrays_zip("lines", "line_words", "line_long")).alias("x"))
    lines = lines.select("host", "row", F.col("x.lines").alias("line"), F.col("x.line_words").alias("size"), F.col("x.line_long").alias("long"))
    often = materialize(lines.groupBy("line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs))
    hits = materialize(lines.join(often, "line"))
    hosts = materialize(rows.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count("*").alias("n")))
    by_host = hits.groupBy("host", "line", "long").agg(F.count("*").alias("own"), F.max("docs").alias("docs"))
    limits = by_host.join(hosts, "host").crossJoin(F.broadcast(hosts.agg(F.sum("n").alias("all"))))
    here = (F.col("own") > max_docs) & (F.col("own") > max_share * F.col("n"))
    common = limits.where(F.col("long") | here | (F.col("docs") > max_share * F.col("all"))).select("host", "line")
    lost = hits.join(materialize(common), ["host", "line"]).groupBy("row").agg(F.sum("size").alias("n_removed_words"))
    found = rows.join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words") >= least_share * F.col("n_words")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, failed.alias("base_failed"), (~failed & left).alias("kept"), "n_removed_words")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
