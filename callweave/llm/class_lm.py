"""LM scoring (operator 10): Brown class-based n-grams.

1. Every word has a unit that its last bytes give. Unit bigrams of all training text are counted, and exchange
   clustering puts the units into classes; its matrix has the fixed size of the units. This is the start.
2. Texts are tokenised once. Every task cuts its documents into parts of a bounded number of tokens, numbers
   the words of a part, and writes the documents as numbers next to the part's words, each with its training
   count and how often each class stands before and behind it in training text.
3. The rows of a word, of all parts, meet in one sweep: their counts are summed (c, N, V), and every word of the
   vocabulary moves to the class under which the corpus is most likely, by the neighbours it has in all training text.
   Unknown words stay in the class of their unit.
4. Parts are cogrouped with their words' counts and classes, which gives base scores and the classes of each text.
   Class bigrams and class sizes are counted anew; transitions and emissions score the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import crc_mod, table, text_bytes
from callweave.session import materialize, release

#: Units of words; behind them those of the begin and the end of a text.
UNITS = 509
START, END = UNITS, UNITS + 1
WORDS, DOCS = 0, 1
#: Bits that a neighbour count takes beside its code, and codes a word can have: classes before and behind it.
COUNT_BITS, CODES = 24, 256


def squeeze(ids: np.ndarray) -> bytes:
    """32-bit numbers as zstandard-compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()


def units_of(text: bytes) -> np.ndarray:
    """The unit of every word of a text in lower case: a hash of its last three bytes."""
    octets = np.frombuffer(b"   " + text + b" ", dtype=np.uint8)
    space = (octets == 0x20) | (octets >= 0x09) & (octets <= 0x0D)
    last = np.flatnonzero(space[1:] & ~space[:-1])
    code, inside = np.zeros(len(last), dtype=np.uint32), np.ones(len(last), dtype=bool)
    for back in range(3):
        inside &= ~space[last - back]
        code = code * np.uint32(257) + np.where(inside, octets[last - back], 0).astype(np.uint32)
    code *= np.uint32(2654435761)
    return ((code ^ code >> np.uint32(15)) % np.uint32(UNITS)).astype(np.int64)


def unit_bigrams(texts: DataFrame) -> np.ndarray:
    """How often each unit follows each other one in ``texts(text)``, of texts with their begin and end; summed by Spark."""
    n = UNITS + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                path = np.concatenate([[START], units_of(text.as_py().lower()), [END]])
                counts += np.bincount(path[:-1] * n + path[1:], minlength=n * n) if len(path) > n else 0
                if len(path) <= n:
                    np.add.at(counts, path[:-1] * n + path[1:], 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(counts[at])})

    found = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n * n)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(n, n)


def exchange(bigrams: np.ndarray, fixed: tuple[int, ...], classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of every unit: ``fixed`` ones have the classes behind the first ``classes``, others start by frequency and
    move to the class that makes the class bigrams most likely, until a sweep moves none."""
    total = classes + len(fixed)
    of = np.zeros(len(bigrams), dtype=np.int64)
    of[list(fixed)] = classes + np.arange(len(fixed))
    free = [u for u in np.argsort(-(bigrams.sum(axis=0) + bigrams.sum(axis=1)), kind="stable").tolist() if u not in fixed]
    of[free] = np.arange(len(free)) % classes
    member = np.eye(total)[of]
    table_ = member.T @ bigrams @ member

    def gain(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = False
        for u in free:
            own = bigrams[u, u]
            to, back = bigrams[u] @ member, bigrams[:, u] @ member
            if to.sum() + back.sum() == 0:
                continue
            k = of[u]
            to[k] -= own
            back[k] -= own
            table_[k] -= to
            table_[:, k] -= back
            table_[k, k] -= own
            rows, columns = table_.sum(axis=1) + back, table_.sum(axis=0) + to
            corner = np.diagonal(table_)
            value = (gain(table_ + to) - gain(table_)).sum(axis=1) + (gain(table_ + back[:, None]) - gain(table_)).sum(axis=0)
            value += gain(corner + to + back + own) + gain(corner) - gain(corner + to) - gain(corner + back)
            value -= gain(rows + to.sum() + own) - gain(rows) + gain(columns + back.sum() + own) - gain(columns)
            best = int(value[:classes].argmax())
            best = k if value[k] >= value[best] - 1e-9 else best
            moved |= best != k
            table_[best] += to
            table_[:, best] += back
            table_[best, best] += own
            member[u, k], member[u, best] = 0, 1
            member[u, best] = 1
            of[u] = best
        if not moved:
            break
    return of


def affinity(moves: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """What a neighbour adds to the log-likelihood of a word's class, ``[code, class]`` with the class before as code and
    ``CODES // 2`` more for the class behind, and the logarithm of the classes' sizes, which an occurrence costs."""
    smooth = moves + 0.5
    out = np.zeros((CODES, classes))
    out[: len(moves)] = np.log(smooth / smooth.sum(axis=1, keepdims=True))[:, :classes]
    out[CODES // 2 : CODES // 2 + len(moves)] = np.log(smooth / smooth.sum(axis=1, keepdims=True))[:classes].T
    return out, np.log(smooth.sum(axis=0)[:classes])


def tokenised(source: DataFrame, of_unit: np.ndarray, *, part_tokens: int = 3_000_000) -> DataFrame:
    """Rows of two kinds in one written table from ``source(doc_id, held_out, text)``: documents as numbers of their
    part's words, and words of parts with training counts and neighbours (``code << COUNT_BITS | count``)."""
    id_type = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, trained = uuid.uuid4().int >> 65, {}, []
        kind = None

        def vocabulary() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            classes = of_unit[units_of(b" ".join(words))]
            counts = np.zeros(len(words), dtype=np.int64)
            keys = []
            for ids in trained:
                counts += np.bincount(ids, minlength=len(words)) if len(ids) > len(words) >> 3 else 0
                if len(ids) <= len(words) >> 3:
                    np.add.at(counts, ids, 1)
                path = np.concatenate([[of_unit[START]], classes[ids], [of_unit[END]]])
                keys += [ids.astype(np.int64) * CODES + path[:-2], ids.astype(np.int64) * CODES + CODES // 2 + path[2:]]
            keys = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            key, n = keys[first], np.diff(first, append=len(keys))
            near = ((key % CODES) << COUNT_BITS | n).astype("<u4")
            cuts = np.searchsorted(key, np.arange(len(words) + 1) * CODES)
            for at in range(0, len(words), 1 << 16):
                end = min(len(words), at + (1 << 16))
                offsets = pa.py_buffer(((cuts[at : end + 1] - cuts[at]) * 4).astype(np.int32).tobytes())
                data = pa.Array.from_buffers(pa.binary(), end - at, [None, offsets, pa.py_buffer(near[cuts[at] : cuts[end]].tobytes())])
                yield rows(WORDS, end - at, word=pa.array(words[at:end], pa.binary()), number=pa.array(np.arange(at, end, dtype=np.int32)), n=pa.array(counts[at:end]), near=data)

        def rows(which: int, many: int, **given: pa.Array) -> pa.RecordBatch:
            none = {"doc_id": kind, "held_out": pa.bool_(), "ids": pa.binary(), "word": pa.binary(), "number": pa.int32(), "n": pa.int64(), "near": pa.binary()}
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(many, which, np.int8)), "part": pa.array(np.full(many, part, np.int64)), **{c: given.get(c, pa.nulls(many, t)) for c, t in none.items()}})

        size = 0
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                packed = []
                for text, out in zip(piece.column(2), piece.column(1).to_pylist()):
                    words = text.as_py().lower().split()
                    get = seen.get
                    ids = [get(w) for w in words]
                    if None in ids:
                        put = seen.setdefault
                        ids = [put(w, len(seen)) for w in words]
                    ids = np.array(ids, dtype=np.int32)
                    packed.append(squeeze(ids))
                    size += len(ids)
                    if not out:
                        trained.append(ids)
                yield rows(DOCS, piece.num_rows, doc_id=piece.column(0), held_out=piece.column(1), ids=pa.array(packed, pa.binary()))
                if size >= part_tokens:
                    yield from vocabulary()
                    part, seen, trained, size = uuid.uuid4().int >> 65, {}, [], 0
        if seen:
            yield from vocabulary()

    return materialize(source.mapInArrow(run, f"kind byte, part long, doc_id {id_type}, held_out boolean, ids binary, word binary, number int, n long, near binary"))


def classified(words: DataFrame, of_unit: np.ndarray, moves: np.ndarray, classes: int) -> DataFrame:
    """``of_part, number, c, class`` of every row of ``words(word, part, number, n, near)``, and ``lead``, true on one row of a word.

    Rows are dealt out and sorted by word. Of a word that goes on over batches only sums and places are kept.
    """
    adds, size = affinity(moves, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_word, places, total, heard = None, [], 0, np.zeros(CODES)

        def finish(word: list[bytes], starts: np.ndarray, place: list[np.ndarray], c: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
            value = near @ adds - c[:, None] * size
            of = np.where(c > 0, value.argmax(axis=1), of_unit[units_of(b" ".join(word))])
            part, number = (np.concatenate(x) for x in zip(*place))
            lead = np.zeros(len(part), dtype=bool)
            lead[starts] = True
            each = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(part)))
            return pa.RecordBatch.from_pydict({"of_part": pa.array(part), "number": pa.array(number), "c": pa.array(c[each]), "class": pa.array(of[each].astype(np.int16)), "lead": pa.array(lead)})

        for batch in batches:
            word = batch.column(0)
            n = batch.num_rows
            if not n:
                continue
            change = np.ones(n, dtype=bool)
            if n > 1:
                change[1:] = pc.not_equal(word.slice(1), word.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(change)
            group = change.cumsum() - 1
            part, number, counts = (batch.column(k).to_numpy() for k in (1, 2, 3))
            lengths = pc.binary_length(batch.column(4)).to_numpy() // 4
            near = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<u4")
            of_entry = np.repeat(group, lengths)
            c = np.bincount(group, weights=counts).astype(np.int64)
            # Of no entries bincount gives whole numbers, which floats can't be added to.
            sums = np.bincount(of_entry * CODES + (near >> COUNT_BITS), weights=near & ((1 << COUNT_BITS) - 1), minlength=len(starts) * CODES).astype(np.float64).reshape(-1, CODES)
            first = word[0].as_py()
            if open_word is not None and first != open_word:
                yield finish([open_word], np.array([0]), places, np.array([total]), heard[None])
                places, total, heard = [], 0, np.zeros(CODES)
            held = sum(len(p[0]) for p in places)
            c[0] += total
            sums[0] += heard
            cut = starts[-1]
            if len(starts) > 1:
                moved = starts[:-1] + held
                moved[0] = 0
                yield finish([word[i].as_py() for i in starts[:-1].tolist()], moved, [*places, (part[:cut], number[:cut])], c[:-1], sums[:-1])
                places = []
            open_word, total, heard = word[int(cut)].as_py(), int(c[-1]), sums[-1]
            places = [*places, (part[cut:], number[cut:])]
        if open_word is not None:
            yield finish([open_word], np.array([0]), places, np.array([total]), heard[None])

    dealt = words.select("word", "part", "number", "n", "near").repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "of_part long, number int, c long, class short, lead boolean")


def lm_scores(docs: DataFrame, *, classes: int = 32, smooth: float = 0.5, held_mod: int = 7, held: int = 2) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` and ``perplexity`` per token.

    A text has the probability of its class path, transitions smoothed by ``smooth``, times those of its words in
    their classes, (c + 1) over the class's tokens, types and one; a class's unknown words share one type. Null and empty
    texts have one token, the end. Held-out documents (crc32 of the id modulo ``held_mod`` is ``held``) give no
    counts. With no training document every token is unknown and N is 0. Equally good classes: the first. Repeated rows
    count and score each. Extra columns are ignored, whatever their names. An empty table gives no rows.
    """
    source = text_bytes(docs.select("doc_id", "text", (crc_mod("doc_id", held_mod) == held).alias("held_out")), "doc_id", "held_out")
    bigrams = unit_bigrams(source.where("not held_out").select("text"))
    of_unit = exchange(bigrams, (START, END), classes)
    member = np.eye(classes + 2)[of_unit]
    rows = tokenised(source, of_unit)
    texts = rows.where(F.col("kind") == DOCS).select("part", "doc_id", "held_out", "ids")
    placed = materialize(classified(rows.where(F.col("kind") == WORDS), of_unit, member.T @ bigrams @ member, classes))
    sizes = {r["class"]: (r["tokens"], r["types"]) for r in placed.where("lead and c > 0").groupBy("class").agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).collect()}
    ends = texts.where("not held_out").count()
    total, distinct = sum(t for t, _ in sizes.values()) + ends, sum(k for _, k in sizes.values()) + (ends > 0)
    id_type = dict(texts.dtypes)["doc_id"]
    floor_ = float(np.log10(total + distinct + 1))

    def convert(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        c = np.zeros(len(number), dtype=np.int64)
        of = np.zeros(len(number), dtype=np.uint8)
        c[number], of[number] = right.column("c").to_numpy(), right.column("class").to_numpy()
        log = np.log10(c + 1.0)
        out = {"n_tokens": [], "n_known": [], "logs": [], "path": []}
        for packed in left.column("ids").to_pylist():
            ids = unsqueeze(packed)
            out["n_tokens"].append(len(ids) + 1)
            out["n_known"].append(int((c[ids] > 0).sum()) + (ends > 0))
            out["logs"].append(float(log[ids].sum()))
            out["path"].append(of[ids].tobytes())
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "logs": pa.float64(), "path": pa.binary()}
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    pairs = texts.groupBy("part").cogroup(placed.select("of_part", "number", "c", "class").groupBy("of_part"))
    scored = materialize(pairs.applyInArrow(convert, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, path binary"))
    release(rows, placed)
    first, last, n = classes, classes + 1, classes + 2

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                path = np.concatenate([[first], np.frombuffer(packed, dtype=np.uint8), [last]]).astype(np.int64)
                counts += np.bincount(path[:-1] * n + path[1:], minlength=n * n)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(counts[at])})

    after = np.zeros((n, n))
    for r in scored.where("not held_out").select("path").mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        after[divmod(r["pair"], n)] = r["n"]
    after += smooth
    after[:, first] = 0
    log_moves = np.log10(np.maximum(after / after.sum(axis=1, keepdims=True), 1e-300))
    log_size = np.array([np.log10(sum(sizes.get(k, (0, 0))) + 1) for k in range(classes)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, logs = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            base = logs + np.log10(ends + 1.0) - tokens * floor_
            score = np.zeros(len(tokens))
            for i, packed in enumerate(batch.column(5).to_pylist()):
                words = np.frombuffer(packed, dtype=np.uint8)
                path = np.concatenate([[first], words, [last]]).astype(np.int64)
                score[i] = logs[i] - log_size[words].sum() + log_moves[path[:-1], path[1:]].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(tokens), total, np.int64)), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / np.maximum(tokens, 1)))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return scored.mapInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over ``documents``. Null and empty texts have the end alone; an empty table gives no rows."""
    return lm_scores(table(spark, sf_dir, "documents"))
