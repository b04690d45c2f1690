"""SimHash balls, the divergence audit and centroid clustering against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, corpus, docs, empty, words_of  # noqa: F401
from tidewire.llm import centroids, divergence, simhash, toxicity


def plain_print(text):
    w = words_of(text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints):
    """Least reachable id by index, from (id, fingerprint)."""
    n = len(prints)
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    least = {}
    for i in range(n):
        if prints[i][0] is not None:
            least[root[i]] = min(least.get(root[i], prints[i][0]), prints[i][0])
    return [least.get(r) for r in root]


def test_fingerprints_equal_the_definition(docs):  # noqa: F811
    rows = [(r[0], r[1]) for r in corpus()]
    got = simhash.groups(docs).collect()
    prints = [(i, plain_print(t)) for i, t in rows]
    want = Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints), strict=True))
    assert Counter(tuple(r) for r in got) == want


def test_the_hash_is_that_of_spark(spark):
    texts = ["One two  three four", "a\tb", "é ü ö é", "x" * 5000 + " y z w"]
    for t in texts:
        w = words_of(t)
        runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        want = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(r,) for r in runs], "r string").select(F.xxhash64("r")).collect()]
        assert simhash.run_hashes(t.encode()) == want


def test_balls_link_all_within_the_radius(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:  # chains, whole balls and pairs just outside
        for _ in range(25):
            b ^= sum(1 << k for k in rng.sample(range(64), rng.choice((1, 2, 3))))
            prints.add(b)
    prints |= {1 << k for k in range(64)}
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    links = simhash.ball_links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for _, p in rows], "fp long")).collect()
    near = {(r["u"], r["v"]) for r in links}
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 2 and u < v for u, v in near) and len(near) == len(links)
    root = {p: p for _, p in rows}
    for u, v in near:
        a, b = root[u & (1 << 64) - 1], root[v & (1 << 64) - 1]
        root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    want = plain_components(rows)
    number = {p: i for i, p in rows}
    least = defaultdict(lambda: 1 << 70)
    for p, r in root.items():
        least[r] = min(least[r], number[p])
    assert [least[root[p]] for _, p in rows] == want


def test_simhash_of_nothing(spark, empty):  # noqa: F811
    assert simhash.groups(empty).count() == 0
    rows = [(5, None), (4, " \n"), (None, ""), (9, "x"), (None, "y z"), (9, "X")]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(5, 4), (4, 4), (None, 4), (9, 9), (9, 9), (None, None)])
    assert {r["fingerprint"] for r in got if r["component_id"] == 4} == {"0" * 16}


def plain_audit(rows, least=30):
    counts, docs_of = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        counts[lang, source] += found
        docs_of[lang].update(found.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs_of[lang].items() if n >= least)
        own = sorted(s for x, s in groups if x == lang)
        total = {s: {t: counts[lang, s][t] for t in kept} for s in own}
        every = {t: sum(total[s][t] for s in own) for t in kept}

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        of, q = {s: p(total[s]) for s in own}, p(every)
        for s in own:
            pairs = sorted(((-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in own if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - of[s][t], t.encode()) for t in kept if total[s][t] and of[s][t] > q[t])[:50]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms, 1)]
    return Counter(out)


AUDITED = "doc_id long, text string, lang string, source string, term string, n int, `at` string"


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(9)
    words = [f"{chr(97 + i % 26)}{'e' * (i // 26)}" for i in range(120)] + ["Größe", "ÄÖ", "日本", "don't", "x1y"]
    rows = []
    for i in range(420):
        lang, source = rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["a", "a", "a", "b", "B", "é", None, ""])
        if lang == "xx":
            source, text = rng.choice(["p", "q", None]), f"once{chr(97 + i % 26)}{chr(97 + i // 26)}"
        else:
            k = {"a": 40, "b": 90}.get(source, 125)
            text = " ".join(rng.choice(words[:k]).upper() if rng.random() < 0.2 else rng.choice(words[:k]) for _ in range(rng.randrange(0, 60)))
        rows.append((i if i % 7 else None, None if i % 50 == 0 else text, lang, source))
    # a group of a kept language without terms, ties, repeated rows, and one very long text
    rows += [(1000, "12 34", "en", "bare"), (1001, None, "en", "bare"), (1002, " ".join(words[:30] * 3000), "en", "b")] + rows[3:6] * 2
    return [(*r, "clash", 7, "clash") for r in rows]


@pytest.mark.parametrize("batch", [10000, 7])
def test_audit_equals_dense_counts(spark, mixed, batch):
    """With small batches runs and terms cross their borders."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = divergence.audit(spark.createDataFrame(mixed, AUDITED).repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain_audit([r[1:4] for r in mixed])
    assert Counter(tuple(r) for r in got) == want
    assert {r["part"] for r in got} == {"pair", "term"} and any(r["lang"] == "xx" and r["value"] == 0 for r in got)


def test_audit_of_nothing(spark, empty):  # noqa: F811
    assert divergence.audit(empty).count() == 0
    few = divergence.audit(spark.createDataFrame([(1, "a b", "en", "x"), (2, "b", "en", "y"), (3, "c", "de", "x")], "doc_id long, text string, lang string, source string")).collect()
    assert Counter(tuple(r) for r in few) == Counter([("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)])


def test_bounds_of_what_a_scan_holds_change_nothing(monkeypatch):
    rng = random.Random(6)
    docs = [(rng.choice(["en", "de"]), rng.choice("abc"), i, " ".join(rng.choice(["x", "Y", "zé", "1 w", "v."]) for _ in range(rng.randrange(9)))) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs, strict=True)], schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("doc", pa.int32()), ("text", pa.string())]))
    terms = sorted((lang, term, s, rng.randrange(1, 90), 5 + ord(s) % 3, rng.randrange(1, 90)) for lang in ("de", "en") for term in "pqrst" for s in "abcd" if rng.random() < 0.8)
    kept = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*terms, strict=True)], ["lang", "term", "source", "p", "p0", "q"])

    def made():
        counts, found = Counter(), Counter()
        for b in divergence.counted(iter([batch.slice(0, 25), batch.slice(25)])):
            for r in b.to_pylist():
                counts[r["lang"], r["term"], r["source"], "docs"] += r["docs"]
                counts[r["lang"], r["term"], r["source"], "n"] += r["n"]
        for b in divergence.shared_terms(iter([kept.slice(k, 3) for k in range(0, kept.num_rows, 3)])):
            for r in b.to_pylist():
                found[r["lang"], r["part"], r["source"], r["item"]] += r["value"]
        return counts, found

    before = made()
    for name, value in (("HOLD", 2), ("FLUSH", 1), ("CELLS", 1)):
        monkeypatch.setattr(divergence, name, value)
    assert made() == before and sum(before[0].values()) > 100 and {k[1] for k in before[1]} == {"pair", "term"}


@pytest.mark.parametrize("least", [1, 20, 26])
def test_runs_and_terms_that_cross_batches_are_one(least):
    rng = random.Random(5)
    rows = sorted((rng.choice("xyz"), rng.choice("ab"), rng.choice("st"), rng.randrange(1, 3), rng.randrange(6)) for _ in range(100))
    docs, sums, totals = Counter(), Counter(), Counter()
    for term, lang, source, d, n in rows:
        docs[lang, term] += d
        sums[lang, term, source] += n
        totals[lang, term] += n
    want = [(*k, n, totals[k[:2]]) for k, n in sorted(sums.items(), key=lambda kv: (kv[0][1], kv[0][0], kv[0][2])) if docs[k[:2]] >= least]
    assert least == 1 or 0 < len(want) < len(sums)
    for size in (1, 2, 7, 100):
        batches = []
        for k in range(0, len(rows), size):
            term, lang, source, d, n = zip(*rows[k : k + size], strict=True)
            batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in (lang, term, source, d, n)], ["lang", "term", "source", "docs", "n"]))
        got = [tuple(r.values()) for b in divergence.run_lengths(least)(iter(batches)) for r in b.to_pylist()]
        assert got == want


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in start]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [nearest(v) for _, v in kept]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True))


VECTORS = "vec_id long, embedding array<float>, cluster int, v string"


@pytest.mark.parametrize(("k", "dim", "spread", "n"), [(8, 64, 0.2, 150), (5, 2, 0.002, 120), (1, 3, 1.0, 20), (8, 2, 0.0, 30), (6, 4, 1e6, 40)])
def test_clusters_equal_looking_at_all(spark, k, dim, spread, n):
    """Few distinct values make ties and equal centroids; large ones are far beyond a component of an embedding."""
    rng = random.Random(k + dim)
    rows = [(i if i % 9 else None, [rng.choice([-1, 0, 0.5]) + rng.gauss(0, spread / 20) if spread < 1e3 else rng.uniform(-1e4, 1e4) for _ in range(dim)]) for i in range(n)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += rows[:4] + [(900, None), (901, []), (902, [0.0] * (dim + 1)), (903, [float("nan")] * dim), (904, [float("inf")] + [0.0] * (dim - 1)), (905, [None] + [0.0] * (dim - 1))]
    made = spark.createDataFrame([(i, v, 3, "clash") for i, v in rows], VECTORS).repartition(3)
    got = centroids.clustered(made, k=k, dim=dim)
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows, k, 10, dim)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-4.0, 0.25])]
    got = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=2).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(rows, 8, 10, 2)
    assert centroids.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_exponion_looks_at_fewer_and_never_errs():
    rng = np.random.default_rng(1)
    v = (rng.integers(0, 12, 4000)[:, None] * 3000 + rng.normal(0, 300, (4000, 16))).astype("<i4")
    at, moved, looked = v[:12].astype(np.int64), np.zeros(12), []
    a, u, low = centroids.nearest(v, centroids.Centroids(at, moved))
    for _ in range(12):
        new = np.stack([v[a == j].astype(np.int64).sum(axis=0) // max(1, (a == j).sum()) if (a == j).any() else at[j] for j in range(12)])
        moved, at = np.sqrt(((new - at) ** 2).sum(axis=1).astype(float)) * (1 + centroids.SLACK), new
        a, u, low = centroids.exponion(v, a, u, low, centroids.Centroids(at, moved), looked)
        d = ((v[:, None].astype(np.int64) - at) ** 2).sum(axis=2)
        assert (a == d.argmin(axis=1)).all()
        own = d[np.arange(len(v)), a]
        d[np.arange(len(v)), a] = np.iinfo(np.int64).max
        assert (u**2 >= own * (1 - 1e-9)).all() and (low**2 <= d.min(axis=1) * (1 + 1e-9)).all()
    assert sum(looked) < 0.25 * 12 * 12 * len(v)


def readings(token, costs):
    """(cost, text) of every way to read a token, by the channel as the module's docstring states it."""
    out = []

    def go(i, x, y, last, cost, text):
        if i == len(token):
            out.append((cost + costs[x][y][0], text))
            return
        sign = token[i].lower()
        for letter, price in [(sign, toxicity.KEEP)] if sign.isalpha() else [(c, toxicity.LIKE) for c in toxicity.LOOKALIKES.get(sign, "")]:
            z = ord(letter) - 96 if "a" <= letter <= "z" else 27
            go(i + 1, y, z, letter, cost + price + costs[x][y][z], text + letter)
            if letter == last:
                go(i + 1, x, y, last, cost + price + toxicity.REPEAT, text)
        if not sign.isalpha():
            free = sign in " ._-*~'"
            go(i + 1, x, y, last, cost + (toxicity.SEPARATOR if free else toxicity.BORDER), text)
            if y:
                go(i + 1, y, 0, "", cost + (toxicity.BLANK if free else toxicity.BORDER) + costs[x][y][0], text + " ")

    go(0, 0, 0, "", 0.0, "")
    return out


def test_decoding_equals_enumeration():
    rng = np.random.default_rng(5)
    costs = -np.log(rng.dirichlet(np.full(28, 0.3), (28, 28)) + 1e-6)
    decoder, pick = toxicity.Decoder(costs), random.Random(5)
    for n in range(1, 8):
        for _ in range(40):
            token = "".join(pick.choice("abiloé01!|@$. -'8") for _ in range(n))
            if any(c.isalpha() for c in token) or n < 4:
                best = min(readings(token, costs.tolist()), default=(0, ""))
                cost = {t: c for c, t in sorted(readings(token, costs.tolist()), reverse=True)}
                assert abs(cost[decoder.decode(token)] - best[0]) < 1e-9
