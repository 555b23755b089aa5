"""Phrases, byte-level BPE and the prefix trie against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.llm import byte_bpe, class_lm, phrases, prefix_trie, token_planes

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def phrases_by_hand(rows, support=10, top=2000, longest=3):
    """Plain reading of the contract, one text after the other."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans(UPPER, UPPER.lower()))
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, c in f.items():
        known = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        around = Counter()
        for p, a in known.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], a)
        found = []
        for p, a in known.items():
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if p not in around or 100 * around[p] < 50 * a:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(1)
    words = "A a the The é É of \x00 \x1c x y -- w1 w2 w3 ß".split(" ")
    text = lambda: "".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t", ". ", ", ", "\n", "\r\n", "  "]) for _ in range(rng.randrange(80)))
    rows = [(rng.choice(["en", None, "und", "x y"]), rng.choice([text(), text(), text(), None, "", "  "])) for _ in range(300)]
    rows += [("en", "z " * 30000), ("de", "".join(rng.choice("abc") + " " for _ in range(60000)))] + [("en", text())] * 12
    return rows


def test_phrases_by_brute_force(spark, talk):
    df = spark.createDataFrame(talk, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).withColumn("chunk", F.lit(2)).repartition(5)
    for top, shards in ((2000, 4), (7, 1)):
        got = phrases.collocations(df, top=top, shards=shards)
        assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == phrases_by_hand(talk, top=top)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_shards_miss_no_phrase(spark, talk, monkeypatch):
    """Many small chunks, ranges and shards, longer phrases: counts are those of all texts."""
    monkeypatch.setattr(phrases, "RANGE_KEYS", 5000)
    df = spark.createDataFrame(talk, "lang string, text string").repartition(6)
    want = Counter()
    for lang, text in talk:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(str.maketrans(UPPER, UPPER.lower()))):
            words = re.findall(r"[^ \t]+", piece)
            want.update((lang or "und", " ".join(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    for shards in (3, 8):
        found, totals = phrases.frequent_phrases(df, longest=4, shards=shards, chunk_bytes=4000)
        assert {(r["lang"], r["phrase"]): r["f"] for r in found.collect()} == {p: n for p, n in want.items() if n >= 10}
        assert {r["lang"]: r["n"] for r in totals.collect()} == {x: sum(n for (lang, p), n in want.items() if lang == x and " " not in p) for x in ("en", "und", "x y", "de")}


def test_scores_are_exact_beyond_64_bits(spark, tmp_path, monkeypatch):
    n = 4 * 10**12
    counts = [("en", "a", n), ("en", "b", n + 7), ("en", "a b", n - 3)]
    found = spark.createDataFrame(counts, "lang string, phrase string, f long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a, **b: (found, spark.createDataFrame([("en", 3 * n)], "lang string, n long")))
    row = phrases.collocations(found).collect()[0]
    assert row["score"] == 10**6 * (n - 3) ** 2 // (n * (n + 7)) and (row["a"], row["l"], row["r"]) == (n - 3, n, n + 7)


def test_slices_end_with_pieces():
    rng = random.Random(2)
    for _ in range(200):
        data = "".join(rng.choice(["ab ", "\n", "c" * rng.randrange(30)]) for _ in range(rng.randrange(40))).encode() + b"\n"
        parts = list(phrases.slices(data, 16))
        assert b"".join(parts) == data and all(p.endswith(b"\n") for p in parts)
    keys = np.unique(np.random.default_rng(0).integers(0, 2**48, 1000).astype(np.uint64))
    assert (phrases.unpacked(phrases.packed(keys)) == keys).all() and len(phrases.unpacked(phrases.packed(keys[:0]))) == 0


def odd_texts(seed, n):
    rng = random.Random(seed)
    point = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xE000, 0x40000), 32, 32, 10, 0x1C, 0x85, 0xA0, 0x2028]))
    texts = ["".join(point() for _ in range(rng.randrange(60))) for _ in range(n)]
    texts += ["".join(rng.choice("abAB =-'s") for _ in range(rng.randrange(300))) for _ in range(n // 4)]
    return [*texts, "a" * 5000, "ab" * 3000, "=" * 4001, " " * 3000, "\n" * 999, "aaab" * 999, "", " ", "x ", " x", "a  b", "a \n b", "é" * 2001, "'s're'LL don't"]


def library(ranks, pattern):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_merge_replay_equals_the_library(monkeypatch):
    path, pattern = byte_bpe.default_vocabulary()
    replay = byte_bpe.replay(path, pattern)
    want = library(replay.ranks, pattern)
    texts = odd_texts(5, 3000)
    assert [x.tolist() for x in replay.encode(texts)] == [want(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "HELD", 7)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 100)
    for at in range(0, 600, 50):
        assert [x.tolist() for x in replay.encode(texts[at : at + 50])] == [want(t) for t in texts[at : at + 50]]


def test_merges_of_unordered_ranks():
    """Ranks that no training makes: a merge can bring a lower rank, whose turn is before the next of its own."""
    rng = random.Random(9)
    for _ in range(60):
        parts = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 5))) for _ in range(25)})
        rng.shuffle(parts)
        ranks = {bytes([i]): i for i in range(256)} | {p: 256 + i for i, p in enumerate(parts)}
        replay, want = byte_bpe.Replay(ranks, r"\S+|\s+"), library(ranks, r"\S+|\s+")
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
        assert [x.tolist() for x in replay.encode(texts)] == [want(t) for t in texts]
        assert all(replay.decode(ids.tolist()) == t.encode() for ids, t in zip(replay.encode(texts), texts))


def test_classes_are_the_library_s():
    path, pattern = byte_bpe.default_vocabulary()
    exact = byte_bpe.regex.compile(byte_bpe.own_classes(pattern)[0], byte_bpe.regex.V1)
    texts = [lead + chr(c) for c in range(0, 0x110000, 3) if not 0xD800 <= c <= 0xDFFF for lead in "a1!"]
    ranks = {bytes([i]): i for i in range(256)}
    for t in texts:
        ranks.setdefault(t.encode(), len(ranks))
    want = library(ranks, pattern)
    assert [len(want(t)) == 1 for t in texts] == [len(exact.findall(t)) == 1 for t in texts]


def test_encoding_of_a_table(spark):
    path, pattern = byte_bpe.default_vocabulary()
    want = library(byte_bpe.load_ranks(path), pattern)
    texts = [*odd_texts(7, 200), None, None, "the same", "the same", "long " * 50000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("")).repartition(3)
    got = byte_bpe.encode(df, ids=True, block_bytes=1000).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = [(i, len(ids := want(t or "")), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())) for i, t in rows]
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, expected))
    assert all(len(r["ids"]) == r["n_tokens"] and digest(bytes(r["decoded"])) == r["decoded_sha256"] for r in got)
    assert byte_bpe.encode(df.limit(0)).count() == 0


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_hand(rows, block=20, heads=4):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(turns.get(c - c % block, [])[:h] + own[h:])
    members, kids, saved, leaves = defaultdict(list), defaultdict(set), Counter(), Counter()
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    for node, of in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(of) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
            leaves[node[:d]] += not kids[node]
    ends = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if whole[c] == node).encode()).hexdigest()
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], ends(n)) for n, m in members.items()}


def test_trie_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 30)
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(-30, 60)]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "u"]), rng.choice([None, "", "a b", "c"])) for _ in range(500)]
    rows += [(70, i, "u", "x y") for i in range(400)] + [(c, 0, "user", "hello there") for c in range(100, 400)] + [(90, 0, "u", "long " * 50000)]
    # Conversations without turns: only own turns that the head replaces, and no base.
    rows += [(c, 0, "u", "gone") for c in range(1001, 1020)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).withColumn("x", F.lit("")).withColumn("c", F.lit(0)).repartition(5)
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(df).collect()]
    assert len(got) == len(set(got)) and set(got) == trie_by_hand(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_running_values_across_tasks(spark):
    rows = [(k, i, (k * 31 + i * 7) % 1000) for k in (None, 1, 2, 3) for i in range(2000 if k == 2 else 50) if k]
    df = spark.createDataFrame(rows, "k long, i long, v long").withColumn("s", F.col("v")).repartition(7)
    got = prefix_trie.running(df, "k", "i", xors=("v",), sums=("s",)).collect()
    want = {}
    for k, i, v in sorted(rows):
        n, x, s = want.get((k, i - 1), (0, 0, 0))
        want[k, i] = (n + 1, x ^ v, s + v)
    assert {(r["k"], r["i"]): (r["nth"], r["v"], r["s"]) for r in got} == want


def test_words_that_no_training_text_has(spark):
    """A batch of words without a neighbour in training text, as held-out texts alone give it."""
    rows = [(bytearray(w), p, i, 0, bytearray()) for i, (w, p) in enumerate([(b"a", 1), (b"a", 2), (b"b", 1)])]
    words = spark.createDataFrame(rows, "word binary, part long, number int, n long, near binary")
    found = class_lm.classified(words, np.zeros(class_lm.UNITS + 2, dtype=np.int64), np.ones((4, 4)), 2)
    assert sorted((r["of_part"], r["number"], r["c"], r["class"]) for r in found.collect()) == [(1, 0, 0, 0), (1, 2, 0, 0), (2, 1, 0, 0)]


def test_parts_of_pieces_are_encoded_once(monkeypatch):
    """Words with every sign and line break beside them cost one encoding each, and odd neighbours change no id."""
    from tokenizers import Tokenizer

    path = token_planes.default_tokenizer()
    monkeypatch.setattr(token_planes, "_tokenizers", {})
    encode, whole = token_planes.encoder(path), Tokenizer.from_file(path)
    want = lambda texts: [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    words, signs = [f"{a}{b}été" for a in "abcdefghij" for b in "klmnopqrst"], ["", ".", ",", "!", "?", ":", ";", ")", "|", "...", ".\n"]
    texts = ["x " + " ".join(w + s + (v if s == ".\n" else "") for s in signs) for w, v in zip(words, words[1:] + words[:1])]
    assert encode(texts) == want(texts)
    assert len(token_planes._tokenizers[path][-1][0].numbers) <= 2 * len(words) + len(signs)
    rng = random.Random(3)
    odd = [" ", " ", "a", "Zo", "É", "ª", "\u0301", "Ж", "中", "'", "'s", "'VE", ".", "|", "_", "\x7f", "\x85", "\xa0", "\n", "\t", "\x1c", "\x00", "0", "²", "٣", "<|endoftext|>", "<|", "endoftext", "\u3000", "😀"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    assert encode(pa.array(texts)) == encode(pa.array(texts, pa.large_string())) == want(texts)
    assert encode([]) == [] and encode(["", " "]) == want(["", " "])


def test_blocks_are_gathered_across_batches():
    texts = ["a" * n for n in (5, 0, 40, 3, 3, 3, 90, 1, 12)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(lo, hi)), "text": pa.array(texts[lo:hi], pa.string())}) for lo, hi in ((0, 2), (2, 2), (2, 5), (5, 9))]
    found = [(ids.to_pylist(), some.to_pylist()) for ids, some in token_planes.gathered(iter(batches), 80)]
    assert [i for ids, _ in found for i in ids] == list(range(9)) and [t for _, some in found for t in some] == texts
    assert 1 < len(found) < 5


def test_used_parts_are_kept(monkeypatch):
    """A worker that knows too many parts keeps the most used ones with their ids and forgets those used once."""
    monkeypatch.setattr(token_planes, "_tokenizers", {})
    monkeypatch.setattr(token_planes, "REMEMBERED", 60)
    path = token_planes.default_tokenizer()
    encode = token_planes.encoder(path)
    often, once = ["x " + " ".join(f"{c}old" for c in "abcdefgh")], ["x " + " ".join(f"{c}{d}new" for c in "abcdefgh" for d in "klmnopqr")]
    first = encode(often)
    assert encode(often) == first
    encode(once)
    assert encode(often) == first
    assert list(token_planes._tokenizers[path][-1][0].numbers) == [f" {c}old" for c in "abcdefgh"]
