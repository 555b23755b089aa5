"""Byte-level BPE (operator 12): corpus-level merge replay.

A task cuts a block of whole texts into the matches of the vocabulary's pattern and replays the merges over all
distinct new ones at once: an inverted index from the token that a pair would make to the positions of the pair
is emptied in rank order, every merge is applied at all its positions, and only the pairs beside a merge are
looked up again. Words are encoded once for a worker, until it remembers too many; texts never leave their task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from callweave.llm.common import table, text_bytes

#: Text of a block, strings that a worker remembers, matches of one text and units that are matched at once.
BLOCK_BYTES, REMEMBERED, HELD, UNITS = 16 << 20, 1_000_000, 1 << 20, 50_000
RUN = re.compile(r" \s")
NONE = np.int64(1 << 40)
_replays: dict[tuple[str, str], Replay] = {}


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def own_classes(pattern: str) -> tuple[str, str]:
    """``pattern`` with letters and numbers as the tiktoken library knows them, and a class of the characters for which that matters.

    The two libraries may follow different Unicode versions. They are asked about all code points that this
    Python's older tables leave unassigned: in tiktoken, a letter behind ``a`` is one match with it, a number
    behind ``1``; so with tokens for such pairs, one id tells the class.
    """
    import tiktoken

    open_points = [chr(c) for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"]
    ranks = {bytes([i]): i for i in range(256)}
    for lead in "a1":
        for c in open_points:
            ranks[(lead + c).encode()] = len(ranks)
    ask = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    unsure: set[str] = set()

    def ranges(chars: set[str]) -> str:
        runs = [[p for _, p in g] for _, g in itertools.groupby(enumerate(sorted(map(ord, chars))), lambda x: x[1] - x[0])]
        return "".join(rf"\U{r[0]:08X}-\U{r[-1]:08X}" for r in runs)

    for lead, name in (("a", "L"), ("1", "N")):
        theirs = {c for c in open_points if len(ask(lead + c)) == 1}
        ours = set(regex.findall(rf"\p{{{name}}}", "".join(open_points)))
        unsure |= theirs ^ ours
        # A class inside of a class, which the V1 rules allow, in the pattern's sets as well as alone.
        if theirs - ours:
            pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}{ranges(theirs - ours)}]")
        if ours - theirs:
            pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{ranges(ours - theirs)}]]")
    return pattern, f"[{ranges(unsure)}]" if unsure else "(?!)"


class Seen:
    """Strings by number, in the order of their first use, and the ids of each."""

    def __init__(self):
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ends, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def name(self, strings: Iterator[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, strings), dtype=np.int32)

    def new(self) -> list[str]:
        """Strings that have no ids yet."""
        return list(itertools.islice(reversed(self.numbers), len(self.numbers) - len(self.ends) + 1))[::-1]

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + sizes.cumsum()])

    def ids(self, named: np.ndarray) -> np.ndarray:
        starts, sizes = self.ends[named], self.ends[named + 1] - self.ends[named]
        return self.flat[np.repeat(starts - (sizes.cumsum() - sizes), sizes) + np.arange(sizes.sum())]


class Replay:
    """The merges of one vocabulary, and the words seen so far.

    A pattern that takes a space with what follows it cuts before a single space, whatever is before it, so
    texts without other white space behind a space are cut at spaces first, and each such unit is matched once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, by_space: bool = False):
        exact, unsure = own_classes(pattern)
        self.ranks, self.unsure, self.by_space = ranks, re.compile(unsure), by_space
        # The exact pattern is slower, so texts without the characters that need it take the given one.
        self.patterns = regex.compile(pattern), regex.compile(exact, regex.V1)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.names = {i: str(i) for i in ranks.values()}
        self.tokens = {i: t for t, i in ranks.items()}
        made = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        made.sort()
        self.pairs = np.array([p for p, _ in made] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.made = np.array([i for _, i in made] + [NONE], dtype=np.int64)
        # Tokens that are part of one of a lower rank, so that merging them can bring that one's turn before the next.
        self.hasty = {x for p, i in made for x in (p >> 32, p & 0xFFFFFFFF) if i < x}
        self.words, self.units = Seen(), Seen()

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, which is its rank, or NONE."""
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.made[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word and the ids of all, by the lowest rank in each word again and again, the leftmost of equals first."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        n, last = len(data), sizes.cumsum() - 1
        if not n:
            return sizes, np.zeros(0, dtype=np.uint32)
        tok, of = self.byte_ids[data], np.repeat(np.arange(len(words)), sizes)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[last[sizes > 0]] = -1
        before[(last - sizes + 1)[sizes > 0]] = -1
        alive, makes = np.ones(n, dtype=bool), np.full(n, NONE)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look(at: np.ndarray) -> None:
            """Enter the pairs that begin at ``at``, which have a right neighbour, in the index."""
            found = self._made(tok[at], tok[following[at]])
            makes[at] = found
            at, found = at[found < NONE], found[found < NONE]
            if not len(at):
                return
            order = found.argsort(kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            for token, lo, hi in zip(found[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                if token not in index:
                    index[token] = []
                    heapq.heappush(queue, token)
                index[token].append(at[lo:hi])

        look(np.flatnonzero(following >= 0))
        while queue:
            token = heapq.heappop(queue)
            found = index.pop(token)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = np.unique(at[alive[at] & (makes[at] == token)])
            if not len(at):
                continue
            right, every = following[at], at
            if len(at) > 1:
                # In a chain of overlapping pairs every second one merges, from the left.
                chained = np.concatenate([[False], right[:-1] == at[1:]])
                if chained.any():
                    begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - begin) % 2 == 0]
                    right = following[at]
            beyond, ahead = following[right], before[at]
            new = np.full(len(at), token)
            if len(at) > 1 and token in self.hasty:
                # A merge whose new neighbour pair ranks lower comes before the word's later merges of this token.
                early = (beyond >= 0) & (self._made(new, tok[beyond]) < token)
                left = tok[ahead]
                left[1:] = np.where(ahead[1:] == right[:-1], token, left[1:])
                early |= (ahead >= 0) & (self._made(left, new) < token)
                if early.any():
                    stop = dict(zip(of[at[early]][::-1].tolist(), at[early][::-1].tolist()))
                    late = lambda x: np.array([p > stop.get(w, p) for p, w in zip(x.tolist(), of[x].tolist())])
                    index[token] = [every[late(every)]]
                    heapq.heappush(queue, token)
                    now = ~late(at)
                    at, right, beyond = at[now], right[now], beyond[now]
            tok[at], following[at] = token, beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            alive[right] = False
            makes[at] = NONE
            ahead = before[at]
            touched = np.concatenate([at, ahead[ahead >= 0]])
            touched = np.unique(touched[alive[touched]])
            look(touched[following[touched] >= 0])
        return np.bincount(of[alive], minlength=len(words)), tok[alive].astype(np.uint32)

    def learn(self) -> None:
        """Match and encode the units, and encode the words, that have been named since the last time."""
        # Units joined again are cut where they were, and only the first match of one begins with a space.
        units, parts, sizes = self.units.new(), [], []
        for at in range(0, len(units), UNITS):
            joined = " " + " ".join(units[at : at + UNITS])
            found = self.pattern(joined).findall(joined)
            parts.append(self.words.name(found))
            starts = np.flatnonzero(np.fromiter((w[0] == " " for w in found), dtype=bool, count=len(found)))
            sizes.append(np.diff(starts, append=len(found)))
        new = [w.encode() for w in self.words.new()]
        whole = np.array([self.ranks.get(w, -1) for w in new], dtype=np.int64)
        lengths, ids = self.merge([b"" if i >= 0 else w for w, i in zip(new, whole.tolist())])
        # A word that is a token needs no merge: its id goes in where the merged ones left no room.
        ids = np.insert(ids, (lengths.cumsum() - lengths)[whole >= 0], whole[whole >= 0])
        self.words.add(np.where(whole >= 0, 1, lengths), ids)
        if units:
            matched, of = np.concatenate(parts), np.repeat(np.arange(len(units)), np.concatenate(sizes))
            each = self.words.ends[matched + 1] - self.words.ends[matched]
            self.units.add(np.bincount(of, weights=each, minlength=len(units)).astype(np.int64), self.words.ids(matched))

    def pattern(self, text: str) -> regex.Pattern:
        """The given pattern where that is exact for this text."""
        if text.isascii():
            return self.patterns[0]
        try:
            text.encode("latin-1")  # a quick test of most texts; no class is in doubt there
        except UnicodeEncodeError:
            return self.patterns[self.unsure.search(text) is not None]
        return self.patterns[0]

    def match(self, text: str) -> np.ndarray:
        """Numbers of the text's words."""
        pattern = self.pattern(text)
        if len(text) <= 4 * HELD:
            return self.words.name(pattern.findall(text))
        matches, parts = (m.group() for m in pattern.finditer(text)), []
        while len(part := self.words.name(itertools.islice(matches, HELD))):
            parts.append(part)
        return np.concatenate(parts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words.numbers) + len(self.units.numbers) > REMEMBERED:
            self.words, self.units = Seen(), Seen()
        named = []
        for text in texts:
            if not self.by_space or " " not in text or text[-1] == " " or RUN.search(text):
                named.append((self.match(text), None))
            else:
                head, *rest = text.split(" ")
                named.append((self.match(head), self.units.name(rest)))
        self.learn()
        return [self.words.ids(words) if units is None else np.concatenate([self.words.ids(words), self.units.ids(units)]) for words, units in named]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


def replay(path: str, pattern: str) -> Replay:
    """This worker's words and merges of a vocabulary."""
    if (path, pattern) not in _replays:
        _replays[path, pattern] = Replay(load_ranks(path), pattern, pattern == default_vocabulary()[1])
    return _replays[path, pattern]


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose last column, the text, holds about ``block_bytes`` or is one longer text."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.num_columns - 1)], dtype=np.int64)
        cuts = np.flatnonzero(np.diff(sizes.cumsum() // block_bytes, prepend=0)).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def encode(docs: DataFrame, *, vocabulary: str | None = None, pattern: str | None = None, ids: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text; with ``ids`` the ids and the decoded bytes, too.

    Null texts are empty and have no id. Repeated rows are encoded each. Null ids are kept. Extra columns of any
    name are ignored. An empty table gives no rows.
    """
    path, default = default_vocabulary() if vocabulary is None or pattern is None else (None, None)
    path, rule = vocabulary or path, pattern or default
    source = text_bytes(docs, "doc_id")
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = replay(path, rule)
        for block in blocks(batches, block_bytes):
            found, rows = words.encode([str(x.as_buffer(), "utf-8", "replace") for x in block.column(1)]), []
            for each in found:
                numbers = each.tolist()
                back = words.decode(numbers)
                rows.append((len(numbers), hashlib.sha256(words.listed(numbers).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), *((numbers, back) if ids else ())))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if ids else 3]
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * ids)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over ``documents``. Null texts have no id; an empty table gives no rows."""
    return encode(table(spark, sf_dir, "documents"))
