"""Operators of the llm subpackage against brute force, on small tables with every odd case."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from callweave.llm import class_lm, decontaminate, html_text, language, mixing, quality, secrets, simhash, stages, token_planes, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words="the of and in to alpha beta gamma delta house tree river stone cloud paper glass".split()):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "a", "o", "ing", "er", "est"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    base = [prose(i, 150) for i in range(30)]
    near = [" ".join(x if k != 70 else "changed" for k, x in enumerate(b.split())) for b in base[:5]]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t)) for i, t in enumerate(base + near + [base[7], base[7]])]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s0", 4), (103, "12 34", "en", "s1", 5), (104, "é", "fr", "s1", 1), (104, "é", "fr", "s1", 1)]
    rows += [(200, "x y " * 20000, "en", "s2", 80000)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOC).withColumn("node", F.lit(1)).withColumn("key", F.lit("k")).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


def empty(docs):
    return docs.limit(0)


def test_golay_keys_miss_nothing():
    rng = np.random.default_rng(0)
    for radius in (1, 2, 3):
        a = rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
        b = a.copy()
        for i in range(500):
            for bit in rng.choice(64, radius, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        keys = [set(zip(*(x.tolist() for x in simhash.fuzzy_keys(f, radius)))) for f in (a, b)]
        assert len({r for r, _ in keys[0] & keys[1]}) == 500


def test_simhash_groups(docs, rows):
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)

    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    known = {}
    for r in rows:
        known.setdefault(fp(r[1]), []).append(r[0])
    root = {f: f for f in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in known:
        for y in known:
            if (x ^ y).bit_count() <= 3:
                root[find(x)] = find(y)
    low = {}
    for f, ids in known.items():
        low[find(f)] = min([*ids, low.get(find(f), 10**9)])
    assert sorted(got) == sorted((r[0], f"{fp(r[1]):016x}", low[find(fp(r[1]))]) for r in rows)
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_leave_one(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r[0] for r in kept.select("doc_id").collect())
    assert ids == [*range(30), 100, 103, 104, 200]
    assert simhash.drop_near_duplicates(docs.where("doc_id < 0")).count() == 0


def test_near_duplicates_by_block_edits(spark, tmp_path):
    """Appended, replaced and removed blocks and scattered words, against brute force by bands of similarity."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    rows, bands = [], {}
    for i in range(120):
        w = new(240)
        at, k = rng.randrange(200), rng.randrange(8, 61)
        other = (w + new(k), w[:at] + new(k // 2) + w[at + k // 2 :], w[:at] + w[at + k // 2 :], [x if rng.random() > k / 1500 else "zz" for x in w])[i % 4]
        texts = [" ".join(x) for x in (w, other)]
        a, b = (simhash.shingles(t.encode(), 5) for t in texts)
        rows += [(2 * i, texts[0]), (2 * i + 1, texts[1])]
        bands[2 * i + 1] = len(a & b) / len(a | b)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "edits"))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.read.parquet(str(tmp_path / "edits"))).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        assert any(low <= s < high for s in bands.values())
    assert {i for i, s in bands.items() if s >= 0.8} == {2 * i + 1 for i in range(120)} - kept


def test_sketches_rule_out_no_similar_sets(spark):
    rng = np.random.default_rng(3)
    rows, agree = [], []
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = {b"%d" % x for x in rng.integers(0, 10**9, n)}
        b = set(sorted(a)[int(len(a) * rng.uniform(0, 0.4)) :]) | {b"%d" % x for x in rng.integers(0, 10**9, int(n * rng.uniform(0, 0.3)))}
        words = [[len(x), *map(int, simhash.odd_sketch(x))] for x in (a, b)]
        rows.append((len(agree), *(dict(zip(["n", *(f"o{i}" for i in range(8))], w)) for w in words)))
        agree.append(len(a & b) >= 0.8 * len(a | b))
    kind = "struct<n:bigint," + ",".join(f"o{i}:bigint" for i in range(8)) + ">"
    got = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").select("i", simhash.may_agree("a", "b", 0.8).alias("may")).collect()
    may = {r["i"]: r["may"] for r in got}
    assert all(may[i] for i, yes in enumerate(agree) if yes) and any(agree)
    assert sum(not may[i] for i, yes in enumerate(agree) if not yes) > 100


def test_quality(docs, rows):
    got = {r["doc_id"]: r for r in quality.quality(docs, max_docs=1).collect()}
    assert got[200]["n_repeat_words"] == 40000 and got[200]["base_failed"] and not got[200]["kept"]
    assert (got[100]["n_words"], got[100]["kept"]) == (0, False)
    assert got[3]["kept"] and got[3]["n_words"] == 150
    text = "a b\n a b\nx\n\nlong word"
    assert quality.measure(text.encode())[:4] == (7, 13, 0, 0)
    assert quality.measure("é#\né#\n|".encode())[:4] == (3, 5, 3, 1)
    assert quality.quality(empty(docs)).count() == 0


def test_frequent_lines_reject(spark):
    data = [(i, "\n".join(["same line of words again and again here " * 3, f"own {i}"]), "h") for i in range(5)]
    got = quality.quality(spark.createDataFrame(data, "doc_id long, text string, source string"), max_docs=4).collect()
    assert all(not r["kept"] and r["n_removed_words"] == 24 for r in got)


def test_frequent_lines_over_hosts_and_sizes(spark):
    passage = "a long passage " * 10
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    data = [(i, f"{passage}\n{own(i, 20)}", f"spread{i}") for i in range(10)]  # one document a host
    data += [(100 + i, "\n".join([own(i, 20), *["short line"] * (15 if i < 40 else 0)]), "hot") for i in range(1000)]  # 4 % of the host
    data += [(2000 + i, "\n".join([own(i, 20), *["menu item"] * (15 if i < 20 else 0)]), "small") for i in range(100)]  # 20 % of the host
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, source string"), max_repeat_percent=100).collect()}
    assert all(got[i]["n_removed_words"] == 30 and not got[i]["kept"] for i in range(10))
    assert all(got[100 + i]["n_removed_words"] == 0 and got[100 + i]["kept"] for i in range(1000))
    assert all(got[2000 + i]["n_removed_words"] == (30 if i < 20 else 0) for i in range(100))


def test_repeated_words_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        w = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
        assert quality.repeated_words(w) == len(covered)


PATTERNS = (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "(AKIA[A-Z0-9]+)", "([0-9a-f]+)", "([A-Za-z0-9+/_=-]+)")
LEAST = (8, 16, 32, 16)


def all_spans(text):
    """(start, kind, end, secret) of base spans and candidates, by the contract."""
    found = [(m.start(), k, m.end(), m[1]) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text, re.I if k == 0 else 0) if len(m[1]) >= LEAST[k]]
    base = [x for x in found if x[1] < 3]
    free = [x for x in found if x[1] == 3 and re.search("[0-9]", x[3]) and re.search("[A-Za-z]", x[3]) and not any(b[0] < x[2] and x[0] < b[2] for b in base)]
    return base + free


def test_secrets_by_brute_force(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice("abcXYZ0189") for _ in range(rng.choice((7, 8, 15, 16, 20)))) for _ in range(12)] + ["0f" * 16, "AKIA" + "Z9" * 6, "0f" * 15, "deadbeef" * 5]
    forms = ["token = {}", 'SECRET": "{}', "api_key:{}", "see {} here", "é {}", "{}", "x={}", "password {}", "token=secret: {}", "AKIA{}", "{}{}"]
    texts = [" ".join(rng.choice(forms).replace("{}", rng.choice(keys)) for _ in range(rng.randint(0, 5))) for _ in range(150)] + [None, ""]
    data = [(i % 120, t, f"s{rng.randint(0, 4)}" if i % 9 else None, 1, 2) for i, t in enumerate(texts)]
    got = [tuple(r) for r in secrets.secrets(spark.createDataFrame(data, "doc_id long, text string, source string, row int, `End` int")).collect()]
    owners, names = {}, ("assign", "access", "hex", "owned")
    for i, t, s, *_ in data:
        for x in all_spans(t or ""):
            owners.setdefault(x[3], set()).add((s, i))
    live = {h for h, who in owners.items() if len({s for s, _ in who}) <= 1 and len(who) <= 5}
    want = []
    for i, t, *_ in data:
        found = sorted(x for x in all_spans(t or "") if x[1] < 3 or x[3] in live)
        said = lambda xs: ",".join(f"{names[x[1]]}:{x[0]}:{x[2]}" for x in xs)
        base = [x for x in found if x[1] < 3]
        want.append((i, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(said(base).encode()).hexdigest(), said(found), len(found) - len(base), sum(x[3] in live for x in base), sum(x[3] not in live for x in base)))
    assert sorted(got) == sorted(want)
    assert sum(w[6] for w in want) and sum(w[8] for w in want)
    assert secrets.secrets(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_many_secrets_in_one_text(spark):
    rng = random.Random(0)
    text = " ".join("%032x" % rng.getrandbits(128) for _ in range(30000))
    got = secrets.secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (got["n_hex"], got["n_live"], got["n_owned"]) == (30000, 30000, 0)


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/", "https://b.net/es/1", "https://b.net/xx", "noscheme", None, "http://c.org?q", "https://d.org/"]
    html = [None, "", "", '<a href="https://b.net/es/9">', "", None, '<a href="//b.net/x">', '<img src=http://www.example.com/a>']
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("b.net", "/es/1", "net/es/", "block")
    assert got[3] == ("b.net", "/xx", None, "block")  # its host is a blocked seed
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("c.org", "", None, "block")  # links to a blocked seed
    assert got[7][3] == "allow"
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_urls_far_from_seeds_and_leaks(spark):
    # h0 is a blocked seed; h11 links to it over eleven hosts. Half of the trust of h20 leaks to a host without links.
    edges = [(f"h{i + 1}", f"h{i}") for i in range(11)] + [("h20", "h21"), ("h20", "h22"), ("h22", "h20")]
    links = spark.createDataFrame([(*e, 1) for e in edges], "src string, dst string, n long")
    seeds = [("h0", "distrust", 1.0), ("h20", "trust", 1.0)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(links, spark.createDataFrame(seeds, "host string, way string, weight double")).collect()}
    hosts = sorted({h for e in edges for h in e})
    for k, (way, turned) in enumerate((("trust", edges), ("distrust", [(b, a) for a, b in edges]))):
        start = np.array([float(any(s[:2] == (h, way) for s in seeds)) for h in hosts])
        move = np.array([[((a, b) in turned) / max(1, sum(x == a for x, _ in turned)) for a in hosts] for b in hosts])
        want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * move, 0.15 * start)
        assert [got.get(h, (0, 0))[k] for h in hosts] == pytest.approx((want / want.sum()).tolist(), rel=2e-3)
    assert got["h11"][1] > 0 and got["h11"][0] == 0


def test_token_planes_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_planes.default_tokenizer())
    for mode in ("byte", "bit"):
        got = sorted(tuple(r) for r in token_planes.token_table(docs, mode=mode).collect())
        assert len(got) == len(rows)
        assert [r[1] for r in sorted(got, key=lambda r: r[1])] == np.cumsum([0, *(r[2] for r in sorted(got, key=lambda r: r[1]))][:-1]).tolist()
        want = sorted((r[0], zlib.crc32(np.array(whole.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes())) for r in rows)
        assert sorted((r[0], r[3]) for r in got) == want
    assert token_planes.token_table(empty(docs)).count() == 0


def test_blocks_are_read_alone():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50000, 2 * token_planes.BLOCK + 77).astype("<u4")
    for mode in ("byte", "bit"):
        sizes, data = token_planes.pack(ids, mode)
        for k in range(3):
            assert token_planes.read_block(k, len(ids), sizes, data).tolist() == ids[k * token_planes.BLOCK : (k + 1) * token_planes.BLOCK].tolist()
        assert token_planes.unpack(len(ids), sizes, data).tolist() == ids.tolist()
    assert len(token_planes.unpack(0, *token_planes.pack(ids[:0]))) == 0


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    whole, pieces = Tokenizer.from_file(token_planes.default_tokenizer()), token_planes.encoder(token_planes.default_tokenizer())
    rng = random.Random(0)
    texts = ["".join(rng.choice([" ", "a", "b.", "\n", "\t", "é", "'s", "12", "  ", "<|endoftext|>", "\x1c", "　", "\x00"]) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    token_planes.REMEMBERED = 50  # the worker begins again
    pieces(texts[:500])
    assert pieces(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(docs, language.fit(docs), ("doc_id", "lang")).where("crc32(cast(doc_id as string)) % 3 = 1 and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)


def test_network_by_brute_force():
    net = language.ByteConvNet(["a", "b", "c"])
    text = "Some Wörds in a text. ".encode() * 30
    logs = []
    for at in range(0, len(text), language.LENGTH):
        x = [*text[at : at + language.LENGTH].lower(), *[0] * language.LENGTH][: language.LENGTH]
        pooled = []
        for f in range(net.conv.shape[1]):
            width = language.WIDTHS[f // language.FILTERS]
            ends = range(language.LENGTH - max(language.WIDTHS) + 1)
            pooled.append(max(sum(float(net.embed[x[p + k], e]) * float(net.conv[k * language.EMBED + e, f]) for k in range(width) for e in range(language.EMBED)) for p in ends))
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.base
        logs.append(z - np.log(np.exp(z).sum()))
    p = np.exp(np.mean(logs, axis=0))
    labels, scores = net.predict([text])
    assert labels == [net.labels[int(p.argmax())]] and scores[0] == pytest.approx(p.max() / p.sum(), rel=1e-4)


def test_every_language_is_learned(spark):
    data = [(i, f"word{i % 300} text", f"l{i % 300}") for i in range(900)]
    assert len(language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string")).labels) > 256
    rows = [(1, "same row " * 9, "x")] * 500
    assert len(language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10)) <= 3


def test_language_odd_rows(docs):
    got = {r["doc_id"]: r for r in language.languages(docs, language.fit(docs)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102, 103)) and got[104]["lang_pred"] != "und"
    none = language.fit(docs.where("doc_id = 100"))
    assert none.labels == [] and language.languages(docs, none).where("lang_pred <> 'und'").count() == 0


def test_decontamination(spark):
    item = prose(5, 40).split()
    hit = lambda words: prose(9, 50) + " " + " ".join(words) + "%%% " + prose(10, 50)
    changed = [w if i % 9 else "zzz" for i, w in enumerate(item)]
    data = [(0, hit(item)), (1, hit(changed)), (2, hit(item[:15])), (3, prose(11, 140)), (4, None), (5, ""), (6, hit(item[:4])), (7, hit(item).upper())]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame([(70, " ".join(item)), (71, None), (72, "a b")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, bench).collect())
    assert got == [(0, 70), (1, 70), (2, 70), (7, 70)]
    parts = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, bench, block_bytes=100).collect())
    assert parts == got
    assert sorted(r[0] for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminations(docs, bench.limit(0)).count() == 0


def test_decontamination_by_brute_force(spark):
    """Items of 1 to 16 tokens with every allowed number of changed tokens and one more, anywhere in a text."""
    rng = random.Random(6)
    items = [[f"w{rng.randrange(40)}x{i}" if rng.random() < 0.7 else "the" for _ in range(i)] for i in range(1, 17)]
    texts = []
    for item in items:
        for extra in (0, 1):
            for _ in range(4):
                bad = rng.sample(range(len(item)), min(len(item), len(item) // 5 + extra))
                texts.append([*(rng.choice(("the", "of", "q")) for _ in range(5)), *("zz" if i in bad else w for i, w in enumerate(item)), *(rng.choice(("the", "of", "q")) for _ in range(5))])
    docs = spark.createDataFrame([(i, "%".join(t)) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, "...")], "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for k, w in enumerate(items):
            width = min(13, len(w))
            for shift in range(-len(w), len(t)):
                same = [0 <= shift + i < len(t) and t[shift + i] == w[i] for i in range(len(w))]
                inside = [0 <= shift + i < len(t) for i in range(len(w))]
                if any(all(inside[a : a + width]) and 10 * sum(same[a : a + width]) >= 8 * width for a in range(len(w) - width + 1)):
                    want.add((d, k))
    for size in (4 << 20, 60):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, bench, block_bytes=size).collect()} == want
    kept = {r[0] for r in decontaminate.decontaminate(docs, bench).select("doc_id").collect()}
    assert kept == {*range(len(texts)), 999} - {d for d, _ in want}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_mixing_keeps_clashing_columns(spark):
    data = [(i, "some words here " * (i % 5), "s", "en", "mine", 7, i % 2) for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, topic string, `Tokens` int, sampled int")
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "topic_", "tokens_", "probability", "sampled_"]
    assert all(r["topic"] == "mine" and r["Tokens"] == 7 and r["tokens_"] == 3 * (r["doc_id"] % 5) for r in got.collect())
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns and all(tuple(r) in data for r in kept.collect())


def test_mixing_follows_the_targets(spark, docs):
    got = mixing.mix(docs)
    assert got.count() == docs.count() and got.where("sampled and tokens = 0").count() == 0
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", float(1 + i * 3 + j * 5 + k)) for i in range(3) for j in range(2) for k in range(2)], "source string, lang string, topic string, tokens double")
    goals = {d: mixing.targets(cells, d, 0.5) for d in mixing.DIMENSIONS}
    small, big = mixing.rake(cells, goals, rounds=30), mixing.rake(cells, goals, rounds=30, driver_cells=0)
    one, two = ({tuple(r[:3]): r["weight"] for r in x.collect()} for x in (small, big))
    assert one == pytest.approx(two)
    want = {r[0]: r[1] for r in goals["source"].collect()}
    assert {k: sum(w for c, w in one.items() if c[0] == k) for k in want} == pytest.approx(want, abs=1e-3)
    assert mixing.mix(empty(docs)).count() == 0


def test_topics_follow_the_patterns(spark):
    rules = (("legal", "licen[sc]ed? |copyright|all rights reserved"), ("technical", "password|secret|token|api_?key|https?://"), ("contact", "@|[0-9]{3}[- ][0-9]{3}"), ("tabular", "[|] [^|]* [|]"))
    texts = ["Password", "SECRET x", "the LICENSE of", "a licence to", "LICENCED by", "All Rights\nreserved", "ALL RIGHTS RESERVED", "Api_Key", "APIKEY", "see http://a.b", "call 555-123 now", "555 1234", "55-123", "a | b", "| a | b", "| a\nb |", "| |", "x@y", "Copyright secret", "license", "w " * 100, "w " * 99, " w " * 600, "", None]
    data = [(i, t, "s", "en") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["topic"] for r in mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string, lang string")).collect()}
    for i, t in enumerate(texts):
        n = len((t or "").split())
        want = next((name for name, p in rules if re.search(p, (t or "").lower())), "brief" if n < 100 else "prose" if n < 600 else "longform")
        assert got[i] == want, t


def test_lm_base_score(docs, rows):
    from collections import Counter
    from math import log10

    tok = lambda t: [*(t or "").encode().lower().split(), 0]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not out(r[0]) for w in tok(r[1]))
    n, v = sum(counts.values()), len(counts)
    got = sorted(class_lm.lm_scores(docs).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    for r, d in zip(got, sorted(rows, key=lambda r: (r[0], len(tok(r[1]))))):
        w = tok(d[1])
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d[0], out(d[0]), len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0
    assert class_lm.lm_scores(empty(docs)).count() == 0


def test_exchange_moves_are_the_best():
    """Each move of a sweep by the likelihood of whole tables."""
    rng = np.random.default_rng(2)
    bigrams = rng.integers(0, 9, (14, 14)).astype(float)
    bigrams[:, 12] = bigrams[13] = 0

    def likelihood(of):
        table = np.zeros((5, 5))
        for a in range(14):
            for b in range(14):
                table[of[a], of[b]] += bigrams[a, b]
        g = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return g(table) - g(table.sum(axis=0)) - g(table.sum(axis=1))

    of = np.array([0] * 12 + [3, 4])
    order = [u for u in np.argsort(-(bigrams.sum(axis=0) + bigrams.sum(axis=1)), kind="stable").tolist() if u < 12]
    of[order] = np.arange(12) % 3
    for u in order:
        tries = [likelihood(np.where(np.arange(14) == u, c, of)) for c in range(3)]
        of[u] = of[u] if tries[of[u]] >= max(tries) - 1e-9 else int(np.argmax(tries))
    assert class_lm.exchange(bigrams, (12, 13), 3, sweeps=1).tolist() == of.tolist()


def test_lm_scores_by_brute_force(docs, rows):
    from collections import Counter
    from math import log, log10

    K, unit, s = 6, lambda w: int(class_lm.units_of(w)[0]), 0.5
    tok = lambda t: (t or "").encode().lower().split()
    train = [tok(r[1]) for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    first = np.zeros((class_lm.UNITS + 2,) * 2)
    for t in train:
        path = [class_lm.START, *map(unit, t), class_lm.END]
        for a, b in zip(path, path[1:]):
            first[a, b] += 1
    of = class_lm.exchange(first, (class_lm.START, class_lm.END), K)
    start = lambda w: int(of[unit(w)])
    moves, near, c = Counter(), {}, Counter(w for t in train for w in t)
    for t in train:
        path = [K, *map(start, t), K + 1]
        moves.update(zip(path, path[1:]))
        for w, a, b in zip(t, path, path[2:]):
            near.setdefault(w, []).append((a, b))
    p = lambda a, b: (moves[a, b] + 0.5) / sum(moves[a, x] + 0.5 for x in range(K + 2))
    size = [sum(moves[x, k] + 0.5 for x in range(K + 2)) for k in range(K)]
    value = lambda w, k: sum(log(p(a, k)) + log(p(k, b)) for a, b in near[w]) - c[w] * log(size[k])
    classes = {w: max(range(K), key=lambda k, w=w: value(w, k)) for w in c}
    moves = Counter()
    for t in train:
        path = [K, *(classes[w] for w in t), K + 1]
        moves.update(zip(path, path[1:]))
    room = [sum(c[w] + 1 for w in classes if classes[w] == k) + 1 for k in range(K)]
    after = lambda a, b: (moves[a, b] + s) / sum(moves[a, x] + s for x in (*range(K), K + 1))
    assert sum(after(0, b) for b in (*range(K), K + 1)) == pytest.approx(1)
    assert sum((c[w] + 1) / room[0] for w in classes if classes[w] == 0) + 1 / room[0] == pytest.approx(1)
    want = []
    for r in rows:
        t = tok(r[1])
        path = [K, *(classes.get(w, start(w)) for w in t), K + 1]
        want.append((r[0], len(t) + 1, round(sum(log10(after(a, b)) for a, b in zip(path, path[1:])) + sum(log10((c[w] + 1) / room[k]) for w, k in zip(t, path[1:])), 5)))
    got = [(r["doc_id"], r["n_tokens"], round(r["score"], 5)) for r in class_lm.lm_scores(docs, classes=K).collect()]
    assert sorted(got) == sorted(want)


def test_classes_beat_the_base_on_held_out_text(spark):
    got = class_lm.op10_class_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.2


def test_html():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <article><h2>Head &amp; tail</h2><p>First <b>bo</b>ld&nbsp;text.<p>Short.</p><div class="ad">Buy now!</div><script>var x="</p>";</script><p>Last one.</p><section id="comments"><p>Reader says hi there.</p></section></article>
    <aside>More links</aside><form>Subscribe <input></form><footer>&copy; me</footer>"""
    assert html_text.main_text(page)[0] == "Head & tail First bold text. Short. Last one."
    assert html_text.main_text(None)[0] == html_text.main_text("")[0] == html_text.main_text("<p>")[0] == ""


ODD_PAGES = {
    "<p>Let <math><mi>x</mi></math> be.</p>": "Let x be.",
    "<p>One.</p><button>Go<p>Two is here.</p>and <object>three</object> four.": "One. Two is here. and three four.",
    "<p>My short note</p>": "My short note",
    "no markup": "no markup",
    '<article class="post side"><p>Hi there.</p></article>': "Hi there.",
    '<div class="post-header"><h1>Title</h1></div><div class="post-content"><p>Body text is here.</p></div>': "Title Body text is here.",
    "<form><article><p>Inside a form.</p></article></form>": "Inside a form.",
    "<aside><article><p>Teaser of something.</p></article></aside><main><p>Yes it is.</p></main>": "Yes it is.",
    "<p>a < b and c > d &lt;&eacute;&#x263A;</p>": "a < b and c > d <é☺",
    "<article><p>One.<script>var a = '<p>no</p>';": "One.",
    "<article><p>One</p><p>two\n three<!-- no --></p>": "One two three",
    "<textarea>no end <p>Still there.</p>": "no end Still there.",
    "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>" * 3 + "<div><p>A paragraph of text, long enough to be an article of its own.</p></div>": "A paragraph of text, long enough to be an article of its own.",
    "": "",
    "<p>": "",
}


def test_odd_pages(spark):
    pages = [(i, None, x, "k") for i, x in enumerate(ODD_PAGES)] + [(99, "u", None, "k")] * 2
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    want = [(i, None, t, len(t)) for i, t in enumerate(ODD_PAGES.values())] + [(99, "u", "", 0)] * 2
    assert sorted((tuple(r[:4]) for r in got), key=str) == sorted(want, key=str)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_large_and_broken_pages_are_read_in_linear_time():
    for unit in ("<a x ", '<a x="', "<", "<b>", "<div>", "<script>", "<p>word. </p><p><a>l</a></p>", "<p>x</p><div class=ad>y</div>"):
        times = []
        for n in (100_000, 400_000):
            began = time.process_time()
            html_text.main_text(unit * (n // len(unit)))
            times.append(time.process_time() - began)
        assert times[1] < 10 * max(times[0], 0.05), unit


def test_the_cut_changes_labels(spark):
    """Blocks whose own costs say otherwise follow their element, and the pages' articles come out whole."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    flipped = 0
    for (page,) in rows:
        found = html_text.parse(page)
        ends, edges = html_text.graph(found)
        kept = html_text.min_cut(ends, edges)[len(found.tag) :]
        flipped += sum((a >= b) != k for (a, b), k in zip(ends[len(found.tag) :], kept))
        article = re.sub(r"<[^>]*>", " ", re.search("<article>(.*)</article>", page, re.S)[1])
        assert " ".join(html_text.main_text(page)[0].split()) == " ".join(html.unescape(article).split())
    assert flipped > 100


def test_min_cut_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 8)
        ends = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 5)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda s: sum(d if x else k for x, (k, d) in zip(s, ends)) + sum(c for a, b, c in edges if s[a] != s[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.min_cut(ends, edges)) == pytest.approx(best)


def test_pipeline_stages(spark, docs, tmp_path):
    item = prose(3, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = docs.select("doc_id", "text", "lang", "source", "n_chars")
    sizes = []
    for k, (name, stage) in enumerate(stages.STAGES):
        out = stage(spark, seen, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        if k < len(stages.STAGES) - 1:
            assert out.columns == seen.columns
        seen = spark.read.parquet(str(tmp_path / name))
        sizes.append(seen.count())
    assert sizes[0] == docs.count() - 4 and sizes[1] == 32 and sizes[2] == 31 and sizes[3] == sizes[4] <= 31


def test_pipeline_run_by_brute_force(spark, tmp_path):
    """corpus_pipeline.run against each stage's definition in plain Python, on rows with every odd case."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(8)
    texts = [prose(i, rng.randint(5, 200)) for i in range(60)]
    for i in range(20):  # near copies at all similarities
        w = texts[i].split()
        for k in rng.sample(range(len(w)), rng.randint(0, len(w) // 12)):
            w[k] = "edited"
        texts.append(" ".join(w))
    item = prose(77, 30)
    texts += [texts[0].upper(), texts[3], prose(200, 20) + " " + item, prose(201, 60) + "\n" + item.replace("the", "thy", 1), "12 34", "", None, "a", "x y " * 3000, "call 555-123 " * 9, "license x " * 30]
    data = [(i if i != 70 else None, t, ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    spark.createDataFrame(data, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    net = language.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    labels, scores = net.predict([None if t is None else t.encode() for t in texts])
    rows = [r for r, x, p in zip(data, labels, scores) if x != "und" and p >= 0.5]
    sets = [simhash.shingles(r[1].encode(), 5) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    least = lambda r: (r[0] is not None, r[0] or 0)
    rows = [min(g, key=least) for g in groups.values()]
    words = decontaminate.tokens(item.encode())
    leaks = lambda t: any(sum(x == y for x, y in zip(t[s : s + 13], words[a : a + 13])) >= 11 for s in range(len(t) - 12) for a in range(len(words) - 12))
    rows = [r for r in rows if not leaks(decontaminate.tokens(r[1].encode()))]
    rules = (("legal", "licen[sc]ed? |copyright|all rights reserved"), ("technical", "password|secret|token|api_?key|https?://"), ("contact", "@|[0-9]{3}[- ][0-9]{3}"), ("tabular", "[|] [^|]* [|]"))

    def cell(r):
        n = len(r[1].split())
        return (r[3] or "(none)", r[2] or "(none)", next((name for name, p in rules if re.search(p, r[1].lower())), "brief" if n < 100 else "prose" if n < 600 else "longform"))

    cells = {}
    for r in rows:
        cells[cell(r)] = cells.get(cell(r), 0) + len(r[1].split())
    weight = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(12):
        for d in range(3):
            now, have = {}, {}
            for c in cells:
                now[c[d]] = now.get(c[d], 0) + weight[c]
                have[c[d]] = have.get(c[d], 0) + cells[c]
            goal = {k: n**0.9 / sum(x**0.9 for x in have.values()) for k, n in have.items()}
            weight = {c: w * goal[c[d]] / now[c[d]] for c, w in weight.items()}
    top = max(weight[c] / cells[c] for c in cells)
    draw = lambda i: int(hashlib.md5(f"{'' if i is None else i}:mix".encode()).hexdigest()[:8], 16) / 2**32
    rows = sorted((r for r in rows if draw(r[0]) < weight[cell(r)] / cells[cell(r)] / top), key=least)
    whole, want, start = Tokenizer.from_file(token_planes.default_tokenizer()), [], 0
    for r in rows:
        ids = [*whole.encode(r[1], add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == want and 20 < len(want) < 75
