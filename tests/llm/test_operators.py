"""Small tests of the ten operators: brute-force results, and the edge cases that each docstring defines."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.llm import fingerprint, kernels, linededup, links, media, mixing, near, packing, privacy, quality, sharding, toxicity

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, `row` string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Plain, near-copied, exact-copied, null, empty and long texts, repeated rows, extra columns with names that operators use."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(3, 120)) for _ in range(60)]
    base = prose(rng, 150).split()
    for k in range(25):
        w = base.copy()
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 20 + [None, "", " \n\t ", "one", "One", prose(rng, 30000), "a\nb\n" + texts[5] + "\n\n" + texts[6]]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{min(i % 7, 3)}", len(t or ""), 7, "b", "r") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id here at all today", "en", "s1", 1, 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_kernels_split_words_as_the_pattern():
    texts = ["A b\tc", "", "  x ", "é ü\x0bz", "no-break joined", "y" * 9000 + " q"]
    _, bounds = kernels.words(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(words_of(t)) for t in texts]
    h, b = kernels.words(pa.array(["Same word", "same WORD", "other word"]))
    assert h[0] == h[2] and h[1] == h[3] and h[4] != h[0]
    assert list(kernels.steps(pa.array(["ab", "cd", "efg"]), 4)) == [(0, 2), (2, 3)]


def test_near_groups_equal_brute_force(docs):
    got = near.groups(docs).toPandas()
    rows = [(r[0], r[1]) for r in corpus() if r[0] is not None]
    comp, size = brute_components(dict(rows).items())
    for r in got.itertuples():
        if r.doc_id == r.doc_id:
            assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], comp[r.doc_id], comp[r.doc_id] == r.doc_id)
        else:
            assert r.kept and r.component_id != r.component_id
    assert len(got) == len(corpus())
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == int(got["kept"].sum())


@pytest.mark.parametrize("block", [3, 1 << 17])
def test_links_of_a_large_bucket_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    rng = random.Random(6)
    # values within 1 are linked; in bucket 0 id 1 leads and is alone, and pairs of leftover members are linked
    value = {i: 1000 * i for i in range(1, 21)} | {16: 15001, 18: 17001, 20: 19001} | {i: rng.randrange(60) for i in range(21, 81)}
    held = [(0, i) for i in range(1, 21)] + [(b, i) for b in (1, 2, 3) for i in rng.sample(range(21, 81), 25)]
    buckets = spark.createDataFrame([(b, i, 1) for b, i in held], "bucket long, id long, n long")
    full = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "little"))) for i, v in value.items()], "id long, own binary")

    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([abs(int.from_bytes(x.as_py(), "little") - int.from_bytes(y.as_py(), "little")) <= 1 for x, y in zip(a, b, strict=True)], pa.bool_())

    root = {i: i for i in value}
    for (b, i), (c, j) in ((x, y) for x in held for y in held):
        if b == c and abs(value[i] - value[j]) <= 1 and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    got = {i: i for i in value} | {r["id"]: r["comp"] for r in links.star_components(buckets, lambda ids: full.join(ids, "id", "left_semi"), close).collect()}
    assert got == root


def test_near_empty(empty):
    assert near.groups(empty).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
    b = np.unique(np.concatenate([a[:30], rng.integers(0, 2**63, 10).astype(np.uint64)]))
    same = np.mean([np.mean(near.signature(kernels.mix(a + np.uint64(s))[kernels.mix(a + np.uint64(s)).argsort()]) == near.signature(np.sort(kernels.mix(b + np.uint64(s))))) for s in range(40)])
    assert abs(same - 30 / 50) < 0.06


def test_mixing_laws(docs):
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert len(got) == len(corpus())
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert (by["target"] <= 2 * by["size"] + 1e-6).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-3
    assert ((by["taken"] - by["target"]).abs() <= by["most"]).all()
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    assert rows.count() == int(got["copies"].where(got["size"] > 0, 1).sum())


def test_mixing_nested(docs):
    small = mixing.mix(docs, share=0.5).select("doc_id", F.col("copies").alias("few"))
    large = mixing.mix(docs, share=1.2).select("doc_id", "copies")
    assert small.where("doc_id IS NOT NULL").dropDuplicates().join(large.dropDuplicates(), "doc_id").where("few > copies").count() == 0


def test_mixing_empty(empty):
    assert mixing.mix(empty).count() == 0


def test_sharding_laws(docs):
    got = sharding.shard(docs, 16).toPandas()
    assert len(got) == len(corpus())
    n = got.groupby("shard").size().reindex(range(16), fill_value=0)
    assert n.max() - n.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    size = {r[0]: (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus()}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        assert (r.size, r.text_crc32) == size[r.doc_id]
    # equal texts lie in as few shards as can be, but for cuts at borders
    spread = got[got["size"] > 1].groupby("text_crc32")["shard"].nunique()
    assert (spread - 1).sum() <= 15 + 5


def test_shards_and_slots_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(i, "one hot text" if i % 3 == 0 else f"text {rng.randrange(300)}" if i % 3 == 1 else f"own {i}") for i in range(1000)]
    seen = []
    for deal in (lambda d: d.repartition(1), lambda d: d.repartition(7, "text"), lambda d: d.orderBy(F.desc("doc_id"))):
        seen.append({tuple(r) for r in sharding.shard(deal(spark.createDataFrame(rows, "doc_id long, text string"))).select("doc_id", "shard", "slot").collect()})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 1000


@pytest.mark.parametrize("n", [200, 20000])
def test_propagation_cuts_fewer_links_than_the_start(spark, n):
    rng = random.Random(4)
    rows = [(i, f"t{rng.randrange(n // 6)}" if i % 3 else f"own {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard(df, 4).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == n and sizes.max() - sizes.min() <= 1
    start = df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("s")).toPandas().set_index("doc_id")["s"]
    got["start"], got["text"] = got["doc_id"].map(start), got["doc_id"].map(dict(rows))

    def cut(column):
        # pairs of equal texts in different shards
        inside = got.groupby(["text", column]).size()
        whole = got.groupby("text").size()
        return int((whole * (whole - 1) // 2).sum() - (inside * (inside - 1) // 2).sum())

    assert cut("shard") < 0.1 * cut("start")


def test_propagation_over_links(spark, empty):
    rng = random.Random(7)
    # 24 communities of 50; each document is in two hubs of its own community and at times in one of another
    rows, links = [], []
    for i in range(1200):
        c = i % 24
        rows.append((i, f"text {i}"))
        links += [(i, f"h{c}.{rng.randrange(6)}"), (i, f"h{c}.{rng.randrange(6)}")]
        if rng.random() < 0.1:
            links.append((i, f"h{rng.randrange(24)}.{rng.randrange(6)}"))
    df, edges = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(links, "doc_id long, hub string")
    got = sharding.shard(df, 4, edges).toPandas().set_index("doc_id")["shard"]
    sizes = got.value_counts()
    assert len(got) == 1200 and sizes.max() - sizes.min() <= 1
    of = defaultdict(list)
    for i, h in links:
        of[h].append(i)
    start = df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("s")).toPandas().set_index("doc_id")["s"]
    cut = lambda shard: sum(shard[a] != shard[b] for own in of.values() for k, a in enumerate(own) for b in own[:k])
    assert cut(got) < 0.6 * cut(start)
    assert sharding.shard(df, 4, edges.limit(0)).count() == 1200 and sharding.shard(empty, 4, edges.limit(0)).count() == 0


def test_sharding_empty(empty):
    assert sharding.shard(empty).count() == 0


def test_fullest_equals_enumeration():
    rng = random.Random(5)
    for _ in range(60):
        stock = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 60)
        items = [k for k, v in stock.items() for _ in range(v)]
        best = max((s for s in {sum(c) for m in range(1 << len(items)) for c in [[x for i, x in enumerate(items) if m >> i & 1]]} if s <= room), default=0) if len(items) <= 12 else None
        got = packing.fullest(stock, room)
        assert all(v <= stock[k] for k, v in got.items())
        if best is not None:
            assert sum(k * v for k, v in got.items()) == best


def test_fill_uses_up_the_stock():
    rng = random.Random(6)
    stock = {rng.randrange(1, 1025): rng.randrange(1, 400) for _ in range(200)}
    bins = packing.fill(stock)
    used = Counter()
    for times, kind in bins:
        assert sum(k * n for k, n in kind) <= 1024
        for k, n in kind:
            used[k] += times * n
    assert used == Counter(stock)


def test_packing_round_trip(docs):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    got = packing.pack(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path).toPandas()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    for i, text in {r[0]: r[1] for r in corpus() if r[0] is not None}.items():
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        own = got[got["doc_id"] == i].sort_values("piece")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(ids)
        if len(own) > 1:
            assert (own["length"].iloc[1:] == 1024).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 1024


def test_token_ids_of_odd_texts():
    public = pytest.importorskip("public_tokenizers")
    ids = packing.Ids(public.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    signs = "ab é ' st're'll \n\t 12.,!?  \x0b\x0c'd_-ABÿ×÷ªſ中\x1d"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(800)] + ["<|endoftext|> x", "it's", "''s", "a  \n b", ""]
    for t, got in zip(texts, ids(pa.array(texts)), strict=True):
        assert got.tolist() == ids.encode(t).tolist()


def packed_lines(*texts):
    lines, _, bounds = linededup.line_hashes(pa.array(texts))
    return [lines[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def test_patience_alignment():
    assert linededup.patience([1, 2, 3, 4, 5, 6], [9, 2, 3, 4, 8, 6, 7]) == [(1, 1), (2, 2), (3, 3), (5, 5)]
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)] and linededup.patience([1], [2]) == []
    assert linededup.patience([7, 1, 7, 2], [7, 3, 7, 2]) == [(0, 0), (2, 2), (3, 3)]
    assert linededup.rising([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    ten = "one two three four five six seven eight nine ten"
    a, b, c = packed_lines(f"x\n{ten} a\n\n{ten} b\ny", f"{ten} a\n{ten} b\nz\nx", f"x\n\ny\n{ten} a")
    assert linededup.aligned(a, b) == [(0, 1)] and linededup.aligned(a, c) == []


def test_what_the_diff_leaves_out_is_looked_up():
    rng = random.Random(1)
    one, two = ("\n".join(prose(rng, 9) for _ in range(n)) for n in (7, 12))
    a, b = packed_lines(f"{one}\n{two}", f"{two}\n{one}")
    assert linededup.aligned(a, b) == [(0, 11)]
    assert linededup.aligned(a, b, [(10, 12), (12, 14), (16, 18), (3, 5)]) == [(0, 11), (12, 14), (16, 18)]


def in_shared_blocks(a, b):
    """Lines of b that are in a run of lines that is a block and that a holds too, by brute force from that definition."""
    x, y = ([(k, " ".join(v.split())) for k, v in enumerate(t.split("\n")) if v.split()] for t in (a, b))
    gone = set()
    for i in range(len(x)):
        for j in range(len(y)):
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n][1] == y[j + n][1]:
                n += 1
            if n and (i == 0 or j == 0 or x[i - 1][1] != y[j - 1][1]):
                words = sum(len(v.split()) for _, v in y[j : j + n])
                if words >= 20 or n >= 2 and words >= 10:
                    gone |= set(range(y[j][0], y[j + n - 1][0] + 1))
    return gone


def deduplicated_lines(texts):
    out = {}
    for i, t in texts.items():
        gone = set().union(*(in_shared_blocks(u, t) for j, u in texts.items() if j < i))
        out[i] = "\n".join(v for k, v in enumerate(t.split("\n")) if k not in gone)
    return out


def test_line_dedup_equals_the_definition(spark):
    rng = random.Random(12)
    pool = ["\n".join(prose(rng, rng.randrange(4, 12)) for _ in range(rng.randrange(3, 6))) for _ in range(14)]
    refrain = [prose(rng, 6), prose(rng, 7)]
    texts = {}
    for i in range(60):
        parts = []
        for k in rng.choices(range(14), k=rng.randrange(0, 5)):  # in any order, some twice
            parts += [prose(rng, rng.randrange(1, 14)), pool[k], "menu"]
        if i % 6 == 0:
            parts += refrain * rng.randrange(1, 5)
        if i % 10 == 0:
            parts += [""] * 3 + parts[:3]
        texts[i] = "\n".join([*parts, prose(rng, 5)])
    got = {r["doc_id"]: r["text"] for r in linededup.clean(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    want = deduplicated_lines(texts)
    assert got == want and sum(len(texts[i]) - len(want[i]) for i in texts) > 3000


@pytest.mark.parametrize("more", [1, 63, 64, 300])
def test_line_dedup_is_alike_for_any_number_of_holders(spark, more):
    """Two blocks in swapped order, a refrain between other edges, a passage three times."""
    rng = random.Random(8)
    two = ["\n".join(prose(rng, 15) for _ in range(2)) for _ in range(2)]
    refrain = "\n".join([prose(rng, 12), prose(rng, 12)] * 4)
    passage = prose(rng, 30)
    first = f"{two[0]}\nmine\n{two[1]}\n{refrain}\nend\n{passage}"
    texts = {0: first} | {i: f"{two[1]}\n{two[0]}\nother {i}\n{refrain}\n{i} a\n{passage}\n{i} b\n{passage}\n{i} c\n{passage}" for i in range(1, more + 1)}
    got = {r["doc_id"]: r["text"] for r in linededup.clean(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {0: first} | {i: f"other {i}\n{i} a\n{i} b\n{i} c" for i in range(1, more + 1)}


def test_line_dedup_of_very_long_texts(spark):
    """Longer than a step of the kernels, with blocks at its borders."""
    rng = random.Random(2)
    block = "\n".join(prose(rng, 10) for _ in range(4))
    fill = lambda n: "\n".join(f"{rng.random()} {rng.random()}" for _ in range(n))
    texts = {1: fill(40000) + "\n" + block, 2: block + "\n" + fill(40000) + "\n" + block, 3: "a\n" + block}
    got = {r["doc_id"]: r["n_removed"] for r in linededup.clean(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 8, 3: 4}


def test_line_dedup_takes_blocks_from_the_later(spark, docs, empty):
    block = "this line has five words\nshort\nanother line of six words here"
    rows = [(1, f"first own line of five words\n{block}\nend"), (2, f"{block}\nunique second line stays right here"), (3, block), (4, None), (5, ""), (6, "short\nend"), (2, f"{block}\nunique second line stays right here"), (None, block), (7, "this line has five words")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in linededup.clean(made).collect():
        got[r["doc_id"]].append((r["text"], r["n_lines"], r["n_removed"]))
    assert got[1] == [(rows[0][1], 5, 0)]
    assert got[2] == [("unique second line stays right here", 4, 3)] * 2
    assert got[3] == [("", 3, 3)]
    assert got[4] == [(None, 0, 0)] and got[5] == [("", 1, 0)] and got[6] == [("short\nend", 2, 0)] and got[None] == [(block, 3, 0)]
    assert got[7] == [("this line has five words", 1, 0)]  # a lone common line is no block
    kept = linededup.cleaned(docs)
    assert kept.columns == docs.columns
    assert kept.where("text IS NOT NULL AND n_chars <> char_length(text) AND doc_id IS NOT NULL").count() == 0
    assert linededup.clean(empty).count() == 0 and linededup.cleaned(empty).count() == 0


def test_line_dedup_pairs_all_holders_and_short_lines(spark):
    rng = random.Random(5)
    middle = prose(rng, 12)
    block = f"{prose(rng, 8)}\n{middle}\n{prose(rng, 8)}"
    short = "\n".join(f"a{i} b{i}" for i in range(200))
    rows = [(1, f"{prose(rng, 9)}\n{middle}\n{prose(rng, 9)}"), (2, f"{prose(rng, 9)}\n{block}"), (3, f"{block}\n{prose(rng, 4)}"), (4, short), (5, short)]
    got = {r["doc_id"]: r for r in linededup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4, 5)] == [0, 0, 3, 0, 200]


def test_fingerprints_are_homomorphic():
    a, b, both, turned = fingerprint.encoded(*fingerprint.vectors(pa.array(["one two\nthree", "four five six", "one two\nthree\nfour five six", "four five six\n\nthree\none two"])))
    assert fingerprint.add(a, b) == both == turned
    assert fingerprint.subtract(both, b) == a and a != b


def test_compared_with_the_next(docs, empty):
    one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.compared(one).collect()}
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, k = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - k] + texts[j][:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and (t != texts[j] or got[i]["near_next"] == 1)
    same = [got[i]["fingerprint"] for i in ids if texts[i] == texts[0]]
    assert len(set(same)) == 1
    assert fingerprint.compared(empty).count() == 0
    assert fingerprint.compared(docs).count() == len(corpus())


def test_restoration_of_disguised_words(spark):
    clean = spark.createDataFrame([(i, "you are an idiot and a clown said the stupid moron to the worthless loser") for i in range(40)], "doc_id long, text string")
    d = toxicity.Decoder(toxicity.language_model(clean))
    for raw in ("1d10t", "i d i o t", "id.i.ot", "idiiiot"):
        assert d.decode(raw) == "idiot"
    assert toxicity.restored(pa.array(["such a cl0wn.", None, "fine text", "m o r o n!"]), d).to_pylist() == ["such a clown.", "", "fine text", "moron!"]


def test_restoration_of_long_words_and_letters_outside_ascii(spark):
    clean = spark.createDataFrame([(i, "you are an idiot and a clown said the stupid moron to the worthless loser") for i in range(40)], "doc_id long, text string")
    d = toxicity.Decoder(toxicity.language_model(clean))
    long = ["id" + "i" * 60 + "ot", "i" * 3 + "d" * 30000, " ".join("stupidmoronstupidmoronidiot"), "crétééén", "crééé", "éton"]
    found = [[t.encode()[a:b].decode() for r, a, b in toxicity.suspects(pa.array(long)) if r == i] for i, t in enumerate(long)]
    assert found == [[long[0]], [long[1]], [long[2]], [long[3]], [long[4]], []]
    assert toxicity.restored(pa.array(long[:1]), d).to_pylist() == ["idiot"]


@pytest.mark.parametrize("score", [quality.scored, toxicity.scored])
def test_scores(spark, docs, labels, empty, score):
    got = score(docs, labels).toPandas()
    assert len(got) == len(corpus()) and got["score"].between(0, 1).all()
    for r in got.dropna(subset=["doc_id"]).itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0)
    # held-out labels don't matter
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = score(docs, turned).toPandas()
    assert sorted(got["score"]) == sorted(again["score"])
    assert score(empty, labels).count() == 0
    assert set(score(docs, labels.limit(0)).toPandas()["score"]) == {0.5}


def test_quality_learns_and_keeps_columns(spark):
    rng = random.Random(9)
    rows = [(i, (" ".join(rng.choice(["good", "fine", "plain"]) for _ in range(20)) if i % 3 else " ".join(rng.choice(["$$$", "###", "x|y"]) for _ in range(20))), "kept") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = quality.scored(df, lab).where("held_out").toPandas()
    assert (got["predicted"] == (got["doc_id"] % 3 > 0)).mean() > 0.95
    kept = quality.accepted(df, lab)
    assert kept.columns == df.columns and 190 <= kept.count() <= 210


def naive_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, d[::-1])))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("ab@@..-+ 0123456789%()é") for _ in range(rng.randrange(0, 45)))
        assert privacy.base_spans(t) == naive_spans(t)
    for t in ("4111 1111 1111 1111", "a@b.c@d.e", "x@y", "1.2.3.4.5", "+1 (234) 567-8901", "ü jo.e@ex-a.com!"):
        assert privacy.base_spans(t) == naive_spans(t)


def test_disclosing_terms(spark, docs, empty):
    rng = random.Random(2)
    talk = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, f"{talk(5)} zanzibar{'' if i % 2 else ','} contact bob@corp.example {talk(4)}") for i in range(12)]
    rows += [(i, f"contact {talk(12)}") for i in range(12, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in privacy.detect(df).collect()}
    for i, text in rows:
        spans = [s.split(":") for s in got[i]["spans"].split(",") if s]
        found = {text[int(a) : int(b)] for k, a, b in spans if k == "term"}
        assert ("zanzibar" in found) == (i < 12) and "contact" not in found
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitised(df).collect()}
    assert "bob@" not in clean[0] and "zanzibar" not in clean[0] and clean[20] == rows[20][1]
    assert privacy.detect(empty).count() == 0
    assert privacy.detect(docs).count() == len(corpus())


def test_entities_in_all_documents_and_far_words(spark):
    df = spark.createDataFrame([(i, f"w{i} call bob@corp.example now please") for i in range(8)], "doc_id long, text string")
    assert {r["spans"].count("term") for r in privacy.detect(df).collect()} == {0}
    one = spark.createDataFrame([(1, "a@b.cd near")], "doc_id long, text string")
    assert privacy.detect(one).first()["n_private"] == 1
    text = f"alpha {'1' * 3000} bob@corp.example {'2' * 3000} omega"
    at = text.index("bob@")
    assert [text[a:b] for a, b in privacy.near_terms(text, at, at + 16)] == ["alpha", "omega"]
    key = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"
    assert privacy.secrets(f'token = "{key}" and {"a1" * 20} x {"9" * 30}', []) == [("secret", 9, 49)]


def disclosure_by_brute_force(rows):
    """(entity value, term) at the threshold, from definitions."""
    n, where, held, near = len(rows), defaultdict(set), defaultdict(set), defaultdict(lambda: defaultdict(set))
    inside = defaultdict(lambda: defaultdict(set))
    for i, t in rows:
        spans = privacy.base_spans(t)
        terms = [(m[0].lower(), *m.span()) for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", t)]
        for w, _, _ in terms:
            held[w].add(i)
        free = [(k, w) for k, (w, a, b) in enumerate(terms) if not any(a < y and b > x for _, x, y in spans)]
        for kind, a, b in spans:
            e = privacy.entity(t, kind, a, b)
            where[e].add(i)
            around = [w for w, x, y in terms if y <= a][-8:] + [w for w, x, y in terms if x >= b][:8]
            for w in around:
                near[e, w][tuple(around)].add(i)
            seen = set()
            for k, w in free:
                if w not in seen:
                    seen.add(w)
                    c = tuple(terms[j][0] if 0 <= j < len(terms) else None for j in range(k - 8, k + 9))
                    inside[e, w][c].add(i)
    out = set()
    for table in (near, inside):
        for (e, w), contexts in table.items():
            if max(len(near.get((e, w), ())), len(inside.get((e, w), ()))) >= privacy.SUPPORT and len(where[e]) < n:
                together = max(sum(map(len, t[e, w].values())) if (e, w) in t else 0 for t in (near, inside))
                p = min(1.0, together / len(held[w]))
                if 1 - np.log(p) / np.log(len(where[e]) / n) >= privacy.THRESHOLD:
                    out.add(w)
    return out


@pytest.mark.parametrize("prefix", [20, 2])
def test_disclosing_terms_equal_brute_force(spark, monkeypatch, prefix):
    """With a prefix of two bits there are many more terms than prefixes."""
    monkeypatch.setattr(privacy, "PREFIX", prefix)
    rng = random.Random(14)
    names = [f"n{''.join(rng.choice('abcdef') for _ in range(4))}" for _ in range(30)]
    mails = [f"{x}@corp.example" for x in names[:8]]
    rows = []
    for i in range(240):
        words = [rng.choice(WORDS[:120]).replace("w", "w" + "xyz"[i % 3]).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(rng.randrange(5, 30))]
        if i % 4 == 0:
            k = rng.randrange(8)
            words.insert(rng.randrange(len(words)), mails[k])
            words.insert(rng.randrange(len(words)), names[10 + k])
        elif i % 7 == 0:
            words.append(rng.choice(names))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = set()
    for r in privacy.detect(df).collect():
        found |= {dict(rows)[r["doc_id"]][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"}
    assert found == disclosure_by_brute_force(rows) and len(found) >= 6


def test_disclosing_terms_far_from_the_entity_and_without_it(spark):
    rng = random.Random(8)
    talk = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, f"é {talk(3)} Kim {talk(40)} contact bob@corp.example {talk(4)} Ann {talk(2)}") for i in range(12)]
    rows += [(12, f"{talk(9)} ann, {talk(30)} KIM {talk(3)}"), (13, f"Annex {talk(9)}")] + [(i, f"é contact {talk(12)}") for i in range(14, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in privacy.detect(df).collect()}
    for i, text in rows:
        found = [text[int(a) : int(b)] for k, a, b in got[i] if k == "term"]
        assert found == (["Kim", "Ann"] if i < 12 else ["ann", "KIM"] if i == 12 else [])
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitised(df).collect()}
    assert "ann" not in clean[12] and "KIM" not in clean[12] and "Kim" not in clean[0] and clean[13] == rows[13][1]


def wav_file(data, channels, rate, bits, form=1):
    head = struct.pack("<HHIIHH", form, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF\0\0\0\0WAVE" + b"LIST\x05\0\0\0data\0\0" + b"fmt \x10\0\0\0" + head + b"data" + len(data).to_bytes(4, "little") + data


def test_wav_files():
    left = (np.sin(np.arange(3000) / 9) * 3000).astype("<i2")
    got = media.samples(wav_file(np.stack([left, -left // 2], axis=1).tobytes(), 2, 8000, 16), 8000)
    assert np.allclose(got, (left.astype(float) + (-left // 2)) / 512, atol=1e-3)
    half = media.samples(wav_file(left.tobytes(), 1, 8000, 16), 4000)
    assert len(half) == 1500 and np.allclose(half, left[::2] / 256, atol=1e-3)
    for bad in (wav_file(b"abcd", 1, 8000, 24), wav_file(b"abcd", 1, 8000, 8, 3), b"RIFF\0\0\0\0WAVE", b"", None):
        assert len(media.samples(bad, 8000)) == 0
    assert media.samples(b"\x80\x81", 8000).tolist() == [0, 1]


def tune(rng, shape, frames):
    n = frames * shape.hop
    at, out = np.arange(n) / shape.rate, np.zeros(n)
    step = int(shape.hop * rng.integers(6, 12))
    for i in range(0, n, step):
        for f in 440 * 2 ** (rng.integers(-12, 12, 3) / 12):
            out[i : i + step] += np.sin(2 * np.pi * f * at[i : i + step])
    return np.clip(128 + 25 * out, 0, 255)


@pytest.mark.parametrize("shape", [media.AUDIO, media.TEXT])
def test_recordings_that_are_alike_share_a_class(spark, shape):
    """All pairs by brute force against classes: at least 0.9 of the linked pairs, noisy, cut and shifted, and no other pair."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(14):
        base = tune(rng, shape, int(rng.choice([60, 120])))
        for k, noise in enumerate((0, 6, 15, 6)):
            x = np.clip(base + rng.normal(0, noise, len(base)), 0, 255)
            x = x[shape.hop * int(rng.integers(0, 12)) :] if k >= 2 else x
            x = x[int(rng.integers(0, shape.hop // 3)) :] if k == 3 else x
            rows.append((10 * i + k, bytearray(x.astype(np.uint8).tobytes())))
    own = dict(zip((i for i, _ in rows), media.codes([media.samples(bytes(x), shape.rate) for _, x in rows], shape), strict=True))
    ids = sorted(own)
    pairs = {(i, j) for i in ids for j in ids if i < j and media.linked(len(own[i]), len(own[j]), *media.align(own[i], own[j])[1:])}
    root = {i: i for i in ids}
    for i, j in sorted(pairs):
        a, b = sorted((root[i], root[j]))
        root = {k: a if r == b else r for k, r in root.items()}
    got = {r["doc_id"]: r["class_id"] for r in media.recordings(spark.createDataFrame(rows, "doc_id long, samples binary"), shape).collect()}
    assert len(pairs) > 30
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert all(root[i] == root[j] for i in ids for j in ids if got[i] == got[j])


def test_recordings(spark, docs, empty):
    rng = np.random.default_rng(0)
    base = rng.integers(60, 200, 12000).astype(np.uint8)
    cut = base[64 * 40 :]
    noisy = base.copy()
    noisy[rng.integers(0, len(base), 60)] += 3
    other = rng.integers(60, 200, 12000).astype(np.uint8)
    wav = wav_file(base[:, None].repeat(2, axis=1).tobytes(), 2, 2048, 8)
    a, b, c = media.codes([x.astype(np.float32) - 128 for x in (base, cut, other)], media.TEXT)
    assert media.align(a, b)[0] == 40 and media.align(a, b)[2] == 0
    made = spark.createDataFrame([(1, bytearray(base)), (2, bytearray(cut)), (3, bytearray(noisy)), (4, bytearray(other)), (5, None), (6, bytearray()), (7, bytearray(wav)), (1, bytearray(base)), (None, bytearray(base))], "doc_id long, samples binary")
    got = defaultdict(list)
    for r in media.recordings(made, media.TEXT).collect():
        got[r["doc_id"]].append(r)
    assert [got[i][0]["class_id"] for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 1, 1, 4, 5, 6, 1]
    assert got[2][0]["shift"] == 40 and got[2][0]["bit_error"] == 0 and len(got[1]) == 2 and got[None][0]["class_id"] is None
    assert media.recordings(empty.select("doc_id", F.col("text").cast("binary").alias("samples"))).count() == 0
    assert media.recordings(docs.select("doc_id", F.col("text").cast("binary").alias("samples"))).count() == len(corpus())


def test_packing_of_empty_and_repeated_rows(spark, empty):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    assert packing.pack(empty, path).count() == 0
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (2, None), (3, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).toPandas()
    assert len(got) == 5 and sorted(got["length"])[:2] == [1, 1] and got["sequence_id"].nunique() == 1
    assert sorted(got["offset"]) == [0, *sorted(got.sort_values("offset")["length"].cumsum())[:-1]]


def test_leader_updates_equal_a_plain_loop():
    rng = random.Random(2)
    model, z, n = quality.Follow(6), [0.0] * 7, [0.0] * 7

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * model.l1) / ((model.beta + np.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(200):
        at, y = sorted(rng.sample(range(6), 3)) + [6], rng.randrange(2)
        x = [rng.random() for _ in at]
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        model.update(np.array(at), np.array(x), y)
        for i, v, own in zip(at, x, w, strict=True):
            g = (p - y) * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / model.alpha * own
            n[i] += g * g
    assert np.allclose(model.weights(slice(None)), [weight(i) for i in range(7)])
