"""Language ID (operator 8): a byte convolutional network.

Bytes of fixed-length windows are embedded; filters of several widths run over them, each filter keeps its
maximum over the window, and a softmax layer gives the languages. The network is trained in numpy on a
bounded, hashed sample of labelled text and applied in the tasks to all windows of all whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import crc_mod, table, text_bytes

LENGTH, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
UNKNOWN = "und"


class ByteConvNet:
    """Parameters of the network; ``labels`` in the order of the softmax."""

    def __init__(self, labels: list[str], seed: int = 8):
        rng = np.random.default_rng(seed)
        widest, filters = max(WIDTHS), FILTERS * len(WIDTHS)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.conv = rng.normal(0, 0.3, (widest * EMBED, filters)).astype(np.float32)
        self.mask = np.zeros_like(self.conv)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.conv *= self.mask
        self.bias = np.zeros(filters, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (filters, len(labels))).astype(np.float32)
        self.base = np.zeros(len(labels), dtype=np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        widest = max(WIDTHS)
        e = self.embed[windows].reshape(len(windows), -1)
        view = np.lib.stride_tricks.as_strided(e, (len(windows), LENGTH - widest + 1, widest * EMBED), (e.strides[0], EMBED * e.strides[1], e.strides[1]))
        return view.reshape(-1, widest * EMBED)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The maximum of every filter over every window (uint8, rows of LENGTH)."""
        flat = self._patches(windows) @ self.conv
        return flat.reshape(len(windows), -1, flat.shape[1]).max(axis=1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.pooled(windows[i : i + 16]) for i in range(0, len(windows), 16)]
        z = np.maximum(np.concatenate(parts) + self.bias, 0) @ self.out + self.base
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, windows: np.ndarray, classes: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.005, seed: int = 8) -> None:
        """Adam on the cross-entropy; gradients reach a filter only through the place of its maximum."""
        rng = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "out", "base")
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                x, y = windows[order[at : at + batch]], classes[order[at : at + batch]]
                n = len(x)
                patches = self._patches(x)
                flat = (patches @ self.conv).reshape(n, -1, self.conv.shape[1])
                place = flat.argmax(axis=1)
                top = np.take_along_axis(flat, place[:, None, :], axis=1)[:, 0] + self.bias
                hidden = np.maximum(top, 0)
                z = hidden @ self.out + self.base
                z = np.exp(z - z.max(axis=1, keepdims=True))
                dz = z / z.sum(axis=1, keepdims=True)
                dz[np.arange(n), y] -= 1
                dz /= n
                dtop = (dz @ self.out.T) * (top > 0)
                rows = np.arange(n)[:, None] * flat.shape[1] + place
                picked = patches[rows]
                dconv = np.einsum("nf,nfd->df", dtop, picked) * self.mask
                dpatch = dtop[:, :, None] * self.conv.T[None]
                dembed = np.zeros_like(self.embed)
                for k in range(max(WIDTHS)):
                    np.add.at(dembed, x[np.arange(n)[:, None], place + k].ravel(), dpatch[:, :, k * EMBED : (k + 1) * EMBED].reshape(-1, EMBED))
                grads = {"embed": dembed, "conv": dconv, "bias": dtop.sum(axis=0), "out": hidden.T @ dz, "base": dz.sum(axis=0)}
                step += 1
                for name in names:
                    g = grads[name].astype(np.float32)
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - rate * move).astype(np.float32))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Label and probability of each whole text: the softmax of the mean window log-probabilities."""
        spoken = [bool(t) and bool(self.labels) and has_letter(t) for t in texts]
        tiled = [windows_of(t) for t, ok in zip(texts, spoken) if ok]
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if tiled:
            logs = self.log_probabilities(np.concatenate(tiled)).astype(np.float64)
            sizes = np.array([len(t) for t in tiled])
            mean = np.add.reduceat(logs, sizes.cumsum() - sizes, axis=0) / sizes[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i, k, row in zip(np.flatnonzero(spoken).tolist(), best.tolist(), p):
                labels[i], scores[i] = self.labels[k], float(row[k])
        return labels, scores


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def windows_of(text: bytes) -> np.ndarray:
    """All bytes of a text, A-Z in lower case, as windows; the last one is filled with zeros."""
    n = -(-len(text) // LENGTH)
    return np.frombuffer(text.lower().ljust(n * LENGTH, b"\0"), dtype=np.uint8).reshape(n, LENGTH)


def sample(docs: DataFrame, *, per_language: int, held: int = 1, pieces: int = 3) -> list[tuple[str, bytes]]:
    """Labelled pieces of at most LENGTH characters from documents that are not held out.

    Documents are picked by the hash of id and text with a share for each language that expects at most
    ``per_language`` of them, repeated rows once; pieces lie at hashed places. So the sample is bounded whatever the
    table's size, and every language is learned.
    """
    rows = docs.where((crc_mod("doc_id", 3) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # A number a language, as the softmax has: no text is shuffled to meet them.
    shares = {r["lang"]: min(1.0, per_language / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return []
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    room = F.greatest(F.length("text") - LENGTH, F.lit(0)) + 1
    cuts = [F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", "text", F.lit(k)), room) + 1).cast("int"), F.lit(LENGTH)) for k in range(pieces)]
    picked = rows.where(draw < share).select("lang", "doc_id", F.array_distinct(F.array(*cuts)).alias("pieces")).distinct()
    return sorted((r[0], r[1].encode()) for r in picked.select("lang", F.explode("pieces")).collect())


def fit(docs: DataFrame, *, per_language: int = 600, held: int = 1) -> ByteConvNet:
    pieces = [(lang, p) for lang, p in sample(docs, per_language=per_language, held=held) if has_letter(p)]
    labels = sorted({lang for lang, _ in pieces})
    net = ByteConvNet(labels)
    if labels:
        tiles = [windows_of(p[:LENGTH]) for _, p in pieces]
        net.train(np.concatenate(tiles), np.array([labels.index(lang) for lang, _ in pieces]))
    return net


def languages(docs: DataFrame, net: ByteConvNet, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every whole text.

    Null, empty and letterless texts, and all texts if nothing was labelled, are ``und`` with score 0. Ties go to
    the first label. Repeated rows are kept. Extra columns are ignored. An empty table gives no rows.
    """
    source = text_bytes(docs, *keep)
    types = dict(source.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                labels, scores = net.predict([t.as_py() for t in part.column(len(keep))])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over ``documents``. Null and letterless texts are ``und`` with score 0; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, fit(docs))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
