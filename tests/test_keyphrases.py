"""Keyphrases: the formula is checked by SQL on tables; here case, neighbours, alike phrases and edges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewire.operators import keyphrases as K


def plain_distance(a, b):
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1][-1]


def test_alike_phrases_equal_plain_distances():
    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        b = "".join(rng.choice("abc") if rng.random() < 0.15 else c for c in a) + rng.choice(["", "", "a", "bc"])
        for alike in (0.5, 0.8, 0.9):
            assert K.too_alike(a, b, alike) == (1 - plain_distance(a, b) / max(len(a), len(b)) > alike)


def test_alike_are_left_out_and_the_next_moves_up():
    text = "Central banks raised rates. The Central bank said rates rise. Exporters of Siberian crude welcome rates, Exporters said."
    every, apart = K.keyphrases(text, 50, alike=1.0), K.keyphrases(text, 50, alike=0.8)
    kept = []
    for p, s in every:
        if not any(1 - plain_distance(p, q) / max(len(p), len(q)) > 0.8 for q, _ in kept):
            kept.append((p, s))
    assert apart == kept and len(apart) < len(every) and apart[:4] == K.keyphrases(text, 4, alike=0.8)
    assert [s for _, s in every] == sorted(s for _, s in every) and K.keyphrases(text, 50, highest=0.05) == [x for x in K.keyphrases(text, 50) if x[1] <= 0.05]


def test_case_and_spread_matter():
    weights = K.word_weights([["we", "saw", "Moscow", "today"], ["then", "Moscow", "moved", "today"], ["rain", "fell"]])
    assert weights["moscow"] < weights["today"] and "we" not in weights


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "... !!! ??? ... !!! ??? ..."), (5, "12345 67890 12345 67890 12"), (6, "word " * 60000), (7, "Ключевые слова статьи о рынке нефти. Рынок нефти растёт."), (7, "Ключевые слова статьи о рынке нефти. Рынок нефти растёт.")]
    got = K.of_documents(spark.createDataFrame(rows, "doc_id int, text string"), 3).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {6: 3, 7: 6}
    assert K.of_documents(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_texts_of_a_batch_are_worked_out_at_once(monkeypatch):
    """Texts together give what each gives alone: no word, sentence or phrase goes over from one to the next."""
    import pyarrow as pa

    rng = random.Random(7)
    made = [". ".join(" ".join(rng.choice(["oil", "Oil", "Market", "market", "price", "RATE", "12", "и", "the", "Нефть"]) + "x" * rng.randrange(2) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    texts = ["", "... !!", made[0], "no end", "Oil", *made, made[0], "12 34", ""]
    alone = [K.keyphrases(t, 6) for t in texts]
    calls, weights = [], K._weights
    monkeypatch.setattr(K, "_weights", lambda *a: calls.append(1) or weights(*a))
    assert K.of_texts(pa.array(texts), 6) == alone and len(calls) == 1 and sum(map(len, alone)) > 100
