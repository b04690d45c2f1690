"""Statistics after a batch of changes, checked against those of the changed tables made anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import corpus as C
from tidewire.operators import maintenance as N
from tidewire.plans.corpus import COLLOCATIONS, EDGES, VOCABULARY
from tidewire.plans.registry import query
from tidewire.sources.store import settle

#: Documents before the batch: those with an id that 7 divides aren't there yet, and every fifth other one is still its second half. The batch inserts, edits, and deletes every eleventh.
AFTER = "(SELECT * FROM documents WHERE doc_id % 11 <> 0)"


def before_and_batch(t):
    d = t.documents.select("doc_id", "text")
    i = F.col("doc_id")
    half = F.expr("substring(text, char_length(text) div 2)")
    before = d.where(i % 7 != 0).withColumn("text", F.when(i % 5 == 0, half).otherwise(F.col("text")))
    batch = d.where((i % 7 == 0) | (i % 5 == 0) | (i % 11 == 0)).withColumn("deleted", i % 11 == 0)
    return before, batch


@query(f"WITH {VOCABULARY.replace('FROM documents', f'FROM {AFTER}')} SELECT * FROM v")
def maintained_vocabulary(t):
    before, batch = before_and_batch(t)
    counts = N.merged(C.term_counts(before), N.term_delta(N.changes(before, batch, "doc_id")), ["term"])
    return C.vocabulary_of(counts)


@query(f"WITH {COLLOCATIONS.replace('FROM documents', f'FROM {AFTER}')} SELECT * FROM k ORDER BY frequency DESC, pmi_score DESC, term_a, term_b LIMIT 1000")
def maintained_collocations(t):
    before, batch = before_and_batch(t)
    signed = N.changes(before, batch, "doc_id")
    # occurrences of the tables before and of the changes are summed together: one shuffle in place of one for each and one for their sum
    terms = N.merged(N.term_rows(before), N.term_rows(signed), ["term"]).where(C._after(F.col("n") > 0, C.T.is_informative_token(F.col("term"))))
    pairs = N.merged(N.pair_rows(before), N.pair_rows(signed), ["a", "b"]).where("n > 0")
    return N.top_collocations(C.collocations_of(settle(terms), pairs))


@query(f"WITH {EDGES.replace('FROM lineitem', 'FROM lineitem WHERE l_orderkey % 11 <> 0')} SELECT * FROM e")
def maintained_edges(t):
    """Orders change: a seventh is new, of a fifth one line was missing, an eleventh goes."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("entity"), "l_linenumber")
    i = F.col("item")
    before = rows.where((i % 7 != 0) & ~((i % 5 == 0) & (F.col("l_linenumber") == 1))).select("item", "entity")
    touched = (i % 7 == 0) | (i % 5 == 0) | (i % 11 == 0)
    new = rows.where(touched & (i % 11 != 0)).select("item", "entity")
    return N.merged(C.cooccurrence(before), N.edge_delta(before.where(touched), new), ["a", "b"])
