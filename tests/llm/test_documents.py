"""Operators on documents against brute force: the small table, and a table of
odd rows (nulls, empty and long texts, ties, repeated rows, clashing columns)."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from honeyframe import llm
from honeyframe.llm import common, exact_dedup as X, language, licenses, packing, planes, setsketch, sharding, suffix_tree
from honeyframe.llm.bpe import decode_ids, encode_texts, round_trip
from honeyframe.llm.encoding import ByteEncoder, StreamDecoder, WordEncoder
from honeyframe.llm.ship import ship

P = pytest.importorskip("public_tokenizers")
llm.load()

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")

LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, "the cat and the dog sat on the mat by the door", "en", 0),
    (2, "the cat and the dog sat on the mat by the door", "en", 0),
    (2, "the cat and the dog sat on the mat by the door", "en", 0),
    (3, None, "de", 1),
    (4, "", None, 1),
    (5, None, None, None),
    (None, "le chat et le chien sont dans la maison", "fr", 2),
    (None, None, None, None),
    (6, LONG, "en", 3),
    (7, "  \t\n\x1c  　x ", "en", 3),
    (8, "¿Qué? 12345 --- it's <|endoftext|> don't   WE'LL  \r\n\r\n naïve é", "es", 3),
    (9, "12 34 !!", "de", 3),
    (10, "THE cat and the dog sat on the mat by the door", "en", 0),
    (11, "a" * 5000, "en", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, n int")
    for name in ("uid", "h", "c", "key", "size", "shard", "row", "entry", "component", "block", "id", "length", "word", "path0", "piece", "held_out", "sha", "_id", "kept"):
        d = d.withColumn(name, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- exact dedup -------------------------------------------------------------------


def by_text(table):
    groups = defaultdict(list)
    for d, t in table:
        groups[t or ""].append(d)
    return groups


def test_exact_dedup_odd_rows(odd, empty):
    got = rows(X.exact_dedup(odd, cache_bytes=1, bucket_bytes=64))
    want = Counter()
    for t, ids in by_text((r[0], r[1]) for r in ODD).items():
        keep = max((d for d in ids if d is not None), default=None)
        for d in ids:
            want[(d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((d, k, n, s) for d, k, n, _, s in got) == want
    assert sum(r[3] for r in got) == len(by_text((r[0], r[1]) for r in ODD))
    assert rows(X.exact_dedup(empty)) == []


def test_keep_one_returns_whole_rows(odd):
    kept = X.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in ODD})


def test_directory_splits_only_what_is_overfull():
    flat = X.grow_directory({i: 1 for i in range(16)}, 4, 100)
    assert set(flat) == {(0, 0)}
    grown = X.grow_directory({0: 90, 1: 90, 8: 1, 15: 1}, 4, 100)
    assert grown[0] != grown[1] and grown[0][1] == 4
    assert len({grown[i] for i in range(8, 16)}) == 1
    for i, (bucket, depth) in enumerate(grown):
        assert i >> (4 - depth) == bucket


# -- sharding ------------------------------------------------------------------------


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, run = (low + high) // 2, 1, 0
        for s in sizes:
            n, run = (n + 1, s) if run + s > mid else (n, run + s)
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_shards(request, spark, table):
    d = request.getfixturevalue(table)
    keyed = d.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    got = sharding.shard_documents(d).collect()
    size = Counter()
    for r in keyed:
        size[r["k"]] += len(r["t"].encode()) + 1
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(got) == len(keyed) and set(load) <= set(range(8))
    assert max(load.values()) == best_capacity([size[k] for k in sorted(size)], 8)
    crc = Counter((r["doc_id"], len(r["t"].encode()) + 1, zlib.crc32(r["t"].encode())) for r in keyed)
    assert crc == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    place = defaultdict(set)
    for r in got:
        place[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in place.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_nothing(empty):
    assert rows(sharding.shard_documents(empty)) == []


# -- tokens --------------------------------------------------------------------------


def word_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def rank_encoding():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = [r[1] or "" for r in ODD] + ["   x", "a   b\n\n\n", "x\x1c\x1d!\x1e ?", "ÀÉÎ Straße ǅ İ ΑΣ", "'S 'll'RE", "日本語 テキスト 12３４", "é́ ́x", "aaaaaaaaaaaaaaaaaaaaaaa"]


def test_cached_ids_equal_the_library():
    got = WordEncoder(WORDS, cache=3).encode(HARD)
    assert [g for g in got] == [word_ids(t).tobytes() for t in HARD]
    enc, want = ByteEncoder(RANKS, P.PATTERN, cache=3), rank_encoding()
    for t in HARD:
        (ids,) = enc.encode([t])
        assert ids.tolist() == want.encode_ordinary(t)
        assert enc.decode(ids) == t.encode()


def test_offsets_and_split_characters():
    enc = ByteEncoder(RANKS, P.PATTERN)
    text = "naïve 日本語 🙂🙃 x"
    (ids,) = enc.encode([text])
    start, char = enc.offsets(ids, text.encode())
    for i, (s, c) in enumerate(zip(start.tolist(), char.tolist())):
        assert text.encode()[s : s + enc.lengths[ids[i]]] == enc.bytes_of[ids[i]]
        assert len(text[:c].encode()) <= s < len(text[: c + 1].encode())
    d = StreamDecoder(enc)
    assert "".join(d.feed(ids[i : i + 1]) for i in range(len(ids))) + d.close() == text
    d = StreamDecoder(enc)
    assert d.feed(np.array([enc.encode(["é"])[0][0]])) in ("", "é")


def test_byte_bpe_table(odd, empty):
    want = rank_encoding()
    expect = Counter()
    for d, t, *_ in ODD:
        ids = want.encode_ordinary(t or "")
        expect[(d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(rows(round_trip(odd, RANKS, P.PATTERN))) == expect
    assert rows(round_trip(empty, RANKS, P.PATTERN)) == []
    enc = encode_texts(odd, RANKS, P.PATTERN)
    assert Counter(bytes(r["data"]) for r in decode_ids(enc, RANKS, P.PATTERN).collect()) == Counter((t or "").encode() for _, t, *_ in ODD)


# -- plane files ----------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_plane_round_trip(bits, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << 32, n, dtype=np.uint32).astype("<u4")
    assert (planes.from_planes(planes.to_planes(ids, bits), n, bits) == ids).all()
    data = planes.pack_file([None, 5, 5, -3], [0, n // 2, 0, n - n // 2], ids.tobytes(), 64, bits)
    got = list(planes.unpack_file(data))
    assert [d for d, _ in got] == [None, 5, 5, -3]
    assert b"".join(i.tobytes() for _, i in got) == ids.tobytes()


@pytest.mark.parametrize("bits", [1, 8])
def test_plane_files(odd, bits):
    got = rows(planes.write_and_read(odd, WORDS, bits=bits, block=100, file_ids=300))
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for d, t, *_ in order:
        ids = np.append(word_ids(t), 1).astype("<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_plane_files_of_nothing(empty):
    assert rows(planes.write_and_read(empty, WORDS)) == []


# -- packing ------------------------------------------------------------------------------


def check_packing(got, table, capacity):
    want = Counter()
    for d, t in table:
        ids = np.append(word_ids(t), 1).astype("<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[(d, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in got) // capacity)


def test_packing(docs, texts, odd, empty):
    n, least = check_packing(packing.pack_documents(docs, WORDS).collect(), texts.items(), 4096)
    assert n <= least + 1
    check_packing(packing.pack_documents(odd, WORDS, capacity=64).collect(), [(r[0], r[1]) for r in ODD], 64)
    assert rows(packing.pack_documents(empty, WORDS)) == []


def test_evolution_wins_bins(spark):
    """Items in threes that fill a bin exactly: best fit fails, islands improve."""
    rng = np.random.default_rng(4)
    sizes = []
    for _ in range(60):
        a, b = rng.integers(270, 460, 2)
        sizes += [int(a), int(b), 1000 - int(a) - int(b)]
    sizes = np.array(sizes, np.int32)
    start = packing.fitness(packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), 1000), sizes, 1000)
    ship(spark)
    from honeyframe.llm.common import Written

    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, length int")
    got = packing.pack_items(items, 1000, Written(spark)).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append(int(sizes[r["uid"]]))
    assert len(got) == len(sizes) and all(sum(b) <= 1000 for b in bins.values())
    assert 60 <= len(bins) <= start[0]


def test_crossover_keeps_all_items():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 300).astype(np.int32)
    a = packing.best_fit(sizes, np.argsort(-sizes), 100)
    b = packing.best_fit(sizes, rng.permutation(300), 100)
    for _ in range(20):
        c = packing.crossover(a, b, sizes, 100, rng)
        assert (c >= 0).all() and np.bincount(c, sizes).max() <= 100
        assert len(np.unique(c)) == c.max() + 1


# -- near duplicates --------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(table, percent=85):
    sets = [shingles(t) for _, t in table]
    root = list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, j in {(i, j) for h in holders.values() for i in h for j in h if i < j}:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    name = {}
    for i, (d, _) in enumerate(table):
        if d is not None:
            name[find(i)] = min(d, name.get(find(i), d))
    return Counter((d, len(sets[i]), name.get(find(i)), d == name.get(find(i))) for i, (d, _) in enumerate(table))


def test_near_duplicates(docs, texts, odd, empty):
    assert Counter(rows(setsketch.near_duplicates(docs))) == near_groups(sorted(texts.items()))
    assert Counter(rows(setsketch.near_duplicates(odd))) == near_groups([(r[0], r[1]) for r in ODD])
    assert rows(setsketch.near_duplicates(empty)) == []


def test_hub_whose_copies_are_not_linked_with_each_other(spark):
    """Every copy is near the hub only; blocks of a few rows find all links."""
    ship(spark)
    rng = np.random.default_rng(9)
    hub = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    table = [(1000, " ".join(hub))]
    for k in range(40):
        copy = list(hub)
        for at in rng.choice(390, 6, replace=False):
            copy[at] = f"x{k}_{at}"
        table.append((k, " ".join(copy)))
    d = spark.createDataFrame(table, "doc_id long, text string")
    assert Counter(rows(setsketch.near_duplicates(d, block_rows=7))) == near_groups(table)


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    """Small tables are not a file for each of many partitions."""
    files = []
    write = common.Written.write

    def counted(self, df, *args):
        out = write(self, df, *args)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common.Written, "write", counted)
    store = common.Written(spark)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = store.write(spark.range(2000).where("id % 100 <> 99").selectExpr("id AS a", "id + 1 AS b"))
        got = common.components(spark.range(2000).select(F.col("id").alias("node")), edges, store).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["node"], r["component"]) for r in got} == {(i, i - i % 100) for i in range(2000)}
    assert max(files) <= spark.sparkContext.defaultParallelism


def test_stage_of_near_copies_links_from_four_fifths_on(spark, tmp_path):
    """Pairs at 0.80 and 0.84 are linked, one below 0.80 is not."""
    import corpus_pipeline

    ship(spark)
    table = []
    for k, cut in enumerate((21, 17, 25)):  # of 200 words: words behind the common part
        common = [f"c{k}_{i}" for i in range(200 - cut)]
        for side in "ab":
            table.append((len(table), " ".join(common + [f"{side}{k}_{i}" for i in range(cut)])))
    sets = [shingles(t) for _, t in table]
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (0, 2, 4)]
    assert share[2] < 0.8 <= share[0] < share[1] < 0.85
    d = spark.createDataFrame(table, "doc_id long, text string")
    kept = corpus_pipeline.without_near_copies(spark, d, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5]
    assert setsketch.band_rows(85) == 6 and setsketch.band_rows(80) == 5


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.6, 0.85, 0.95, 1.0):
        both = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
        rest = rng.integers(0, 1 << 63, (2, 2000 - len(both)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r])) for r in rest)
        sa, sb = setsketch.registers(a), setsketch.registers(b)
        assert (setsketch.merge(sa, sb) == setsketch.registers(np.union1d(a, b))).all()
        true = len(both) / (4000 - len(both))
        (got,) = setsketch.estimate(np.array([len(a)]), np.array([len(b)]), np.array([(sa > sb).sum()]), np.array([(sa < sb).sum()]))
        assert got == pytest.approx(true, abs=0.12)


# -- language -----------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(PIECES)
    rng = np.random.default_rng(5)
    prob = rng.random((pieces.size, 2))
    prob[-1] = 0
    prob /= prob.sum(axis=0)

    def brute(w):
        if not w:
            return np.ones(2)
        total = np.zeros(2)
        for i in range(1, len(w) + 1):
            if w[:i] in pieces.id_of:
                total = total + prob[pieces.id_of[w[:i]]] * brute(w[i:])
            elif i == 1:
                total = total + np.prod(prob[[pieces.byte + b for b in w[0].encode()]], axis=0) * brute(w[1:])
        return total

    for group in (["▁there", "▁house", "▁ꙮꙮxy "], ["▁a", "▁ꙮ"]):
        for w, p in zip(group, language.forward(pieces, group, prob)):
            assert p == pytest.approx(brute(w), rel=1e-9)


def test_language(docs, odd, empty, spark):
    got = language.identify(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    out = language.identify(odd, PIECES).collect()
    assert len(out) == len(ODD)
    und = [r["doc_id"] for r in out if r["lang_pred"] == "und"]
    assert sorted(und, key=str) == sorted([3, 4, 5, None, 9], key=str)
    assert {r["doc_id"]: r["lang_pred"] for r in out}[1] == "en"
    assert rows(language.identify(empty, PIECES)) == []
    kept = language.keep_languages(odd, PIECES)
    assert kept.columns == odd.columns and kept.where("text is null or text = '' or doc_id = 9").isEmpty()
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled, PIECES).collect()} == {"und"}


# -- scoring ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_scores(request, table):
    d = request.getfixturevalue(table)
    base = [(r["doc_id"], r["text"]) for r in d.collect()]
    tokens = [(t or "").encode().lower().split() + [None] for _, t in base]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in base]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(i), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 3))
        for (i, _), h, t in zip(base, held, tokens)
    )
    got = suffix_tree.score_texts(d).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 3)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if table == "docs":
        assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_scores_of_nothing(empty):
    assert rows(suffix_tree.score_texts(empty)) == []


def test_tree_is_a_distribution_and_takes_the_longest_suffix():
    rng = np.random.default_rng(2)
    mass = rng.random(256)
    tree = suffix_tree.Tree(mass / mass.sum())
    counts = np.zeros((2, 256), np.int64)
    counts[0, 5], counts[1, 7] = 1000, 800
    tree.add(1, np.array([3, 4]), counts)
    deep = np.zeros((1, 256), np.int64)
    deep[0, 9] = 500
    tree.add(2, np.array([6 << 8 | 3]), deep)
    assert tree.prob.sum(axis=1) == pytest.approx(np.ones(len(tree.prob)))
    states = tree.states(np.array([1, 3, 1, 6, 3, 1, 4, 2]))
    assert states.tolist() == [0, 0, 1, 0, 0, 3, 0, 2]
    same = suffix_tree.Tree(mass / mass.sum())
    same.add(1, np.array([3]), (same.prob[:1] * 10**6).astype(np.int64))
    assert len(same.keys[1]) == 0  # nothing diverges


def scores_by_hand(table, least=2):
    """All contexts of all lengths, one by one."""
    tokens = [(t or "").lower().split() + [""] for _, t in table]
    train = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in table]
    c = Counter(w for t, h in zip(tokens, train) if h for w in t)
    norm = sum(c.values()) + 0.5 * (len(c) + 1)
    base = lambda w: (c[w] + 0.5) / norm
    follow, prob, miss = {(): Counter(c)}, {(): {w: base(w) for w in c}}, {(): None}
    grown, kept = {()}, 0
    size = 0
    while grown:
        size += 1
        fresh, holders = defaultdict(Counter), defaultdict(set)
        for k, (t, h) in enumerate(zip(tokens, train)):
            line = ["^", *t]
            for at in range(size, len(line)) if h else ():
                if tuple(line[at - size + 1 : at]) in grown:
                    fresh[tuple(line[at - size : at])][line[at]] += 1
                    holders[tuple(line[at - size : at])].add(k)
        grown = set()
        for ctx, n in fresh.items():
            total, above = sum(n.values()), prob[ctx[1:]]
            if len(holders[ctx]) < least:
                continue
            gain = sum(k / total * math.log(k / total / above[w]) for w, k in n.items())
            keep = total < sum(follow[ctx[1:]].values()) and gain > suffix_tree.DIVERGENCE + len(n) / (2 * total)
            follow[ctx], miss[ctx], kept = n, len(n) / (total + len(n)) if keep else None, kept + keep
            prob[ctx] = {w: (k + len(n) * above[w]) / (total + len(n)) if keep else above[w] for w, k in n.items()}
            if len(n) > 1:
                grown.add(ctx)
    out = []
    for t in tokens:
        line, score = ["^", *t], 0.0
        for at in range(1, len(line)):
            p, k = base(line[at]), 1
            while k <= at and (ctx := tuple(line[at - k : at])) in prob:
                p = prob[ctx].get(line[at], p * (miss[ctx] or 1.0))
                k += 1
            score += math.log10(p)
        out.append(score)
    return out, size, kept


@pytest.mark.parametrize("few, words", [(1 << 21, 40), (0, 6)])
def test_scores_use_words_long_contexts_and_rare_ones(spark, monkeypatch, few, words):
    """A passage of many words is in a few texts of many, with other words after it;
    a rare pair of words is there three times."""
    ship(spark)
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{k % 7}x" for k in range(words))
    table = []
    for i in range(300):
        t = " ".join(f"w{int(k)}x" for k in rng.zipf(1.4, 10) % 60)
        if i % 40 < 2:
            t = f"{t} {passage} {['mox', 'nax'][i % 2]} {t}"
        if i % 90 == 5:
            t += " raro seldix"
        table.append((i, t))
    monkeypatch.setattr(suffix_tree, "BLOCK", 4_000)
    monkeypatch.setattr(suffix_tree, "FEW", few)
    want, size, kept = scores_by_hand(table)
    assert size > words and kept > 50
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_texts(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in table] == pytest.approx(want, abs=1e-6)


def test_support_of_contexts_is_absolute(spark):
    """Two contexts that tell the next word keep doing so in a table forty times as long."""
    ship(spark)
    pairs = [(5 * k, f"alpha beta{k % 2} gamma{k % 2}") for k in range(1, 9)]
    noise = [(1000 + i, " ".join(f"z{(i * 7 + k * k) % 500}" for k in range(200))) for i in range(400)]

    def gain(table):
        d = spark.createDataFrame(table, "doc_id long, text string")
        return {r["doc_id"]: r["score"] - r["base_score"] for r in suffix_tree.score_texts(d).collect()}

    alone, among = gain(pairs + noise[:10]), gain(pairs + noise)
    assert all(among[d] >= alone[d] > 0 for d, _ in pairs)


# -- licences ----------------------------------------------------------------------------------------------


def test_licenses_by_path(spark):
    ship(spark)
    files = [
        ("a/LICENSE", "Released under the MIT License.\n", 1),
        ("a/b/c/x.py", "print(1)", 2),
        ("a/b/y.py", "# Licensed under CC BY-NC 4.0.\nprint(2)", 3),
        ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0.", 4),
        ("a/b/c/d/z.py", None, 5),
        ("q/r.py", "the of and under", 6),
        (None, "Released under the MIT License.", 7),
        (None, None, 8),
        ("a/b/c/x.py", "print(1)", 2),
        ("a/long.txt", "word " * 50_000, None),
        ("top.py", "", 9),
    ]
    d = spark.createDataFrame(files, "path string, text string, doc_id long").withColumns({"own": F.lit(1), "dir": F.lit("x"), "up": F.lit(2), "score": F.lit(3)})
    got = Counter((r["doc_id"], r["license"], r["inherited_from"]) for r in licenses.scan_licenses(d).collect())
    assert got == Counter([
        (1, "MIT", None), (2, "Apache-2.0", "a/b"), (2, "Apache-2.0", "a/b"), (3, "CC-BY-NC-4.0", None), (4, "Apache-2.0", None),
        (5, "Apache-2.0", "a/b"), (6, None, None), (7, "MIT", None), (8, None, None), (None, "MIT", "a"), (9, None, None),
    ])
    assert licenses.scan_licenses(d.where("false")).collect() == []


def test_licenses_of_documents(spark, sf, docs, texts):
    """Cosine of every line in plain Python."""
    got = {r["doc_id"]: r for r in llm.QUERIES["op2_licenses"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    seen = {w: sum(w in licenses.words(t or "") for t in texts.values()) for s in licenses.TEMPLATES.values() for w in licenses.words(s)}
    n = len(texts)
    idf = lambda w: math.log((n + 1) / ((seen[w] if w in seen else 0) + 1)) + 1

    def cosine(a, b):
        va, vb = ({w: k * idf(w) for w, k in licenses.words(x).items()} for x in (a, b))
        top = sum(x * vb.get(w, 0) for w, x in va.items())
        return top / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values())) if va and vb else 0.0

    for d, t in texts.items():
        best = max((max(cosine(line, s) for s in licenses.TEMPLATES.values()) for line in (t or "").split("\n") if line.strip()), default=0.0)
        own = got[d]["license"] is not None and got[d]["inherited_from"] is None
        assert own == (best >= 0.8) or "LICENSE" in got[d]["path"]
        if own and got[d]["line"] is not None:
            assert got[d]["score"] == pytest.approx(best, abs=1e-9)


class _Sums:
    """Running sums of group sizes in memory, with the look-ups of the written ones."""

    def __init__(self, sizes):
        self.upto = np.cumsum(sizes).tolist()
        self.total, self.largest = self.upto[-1], max(sizes)

    def at_most(self, limits):
        return [max((u for u in self.upto if t - self.largest < u <= t), default=0) for t in limits]

    def at_least(self, limit):
        return 0 if limit <= 0 else min(u for u in self.upto if limit <= u)


@pytest.mark.parametrize("share", [0, 5, 20, 90])
def test_capacity_is_the_smallest(share):
    """Also where one group has a large share of all bytes."""
    rng = np.random.default_rng(share)
    for _ in range(300):
        sizes = rng.integers(1, 60, int(rng.integers(1, 70))).tolist()
        if share:
            sizes[int(rng.integers(0, len(sizes)))] += sum(sizes) * share // (100 - share)
        best = best_capacity(sizes, 8)
        sums = _Sums(sizes)
        assert sharding.smallest_capacity(sums, 8) == best
        cuts = [0, *sharding.cut_sums(sums, 8, best), sums.total]
        assert max(b - a for a, b in zip(cuts, cuts[1:])) == best


def test_shards_with_a_hot_text(spark):
    ship(spark)
    table = [(i, "hot text " * 20) for i in range(40)] + [(100 + i, "t" * (3 + i * 7 % 41)) for i in range(60)]
    d = spark.createDataFrame(table, "doc_id long, text string")
    keys = {r["doc_id"]: r["k"] for r in d.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    size = Counter()
    for i, t in table:
        size[keys[i]] += len(t) + 1
    load = Counter()
    for r in sharding.shard_documents(d).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) == best_capacity([size[k] for k in sorted(size)], 8)
