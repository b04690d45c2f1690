"""SimHash near-dedup by meet-in-the-middle ball hashing: documents whose fingerprints differ in few bits are linked.

A fingerprint has 64 bits: of the XXH64 hashes (seed 42) of a text's runs of WORDS words, repeats
included, bit k is set if over half have it set. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, a run
is joined by single blanks, a text of fewer words is one run; without words the fingerprint is 0.

Links: fingerprints at most RADIUS bits apart. Each distinct fingerprint emits every variant within half
the radius: itself and its 64 neighbours. Two within RADIUS share a variant, which lies halfway. Variants
are shuffled, and those that one fingerprint alone emits go. A variant's bucket holds at most 65 different
fingerprints, for nothing else is within a bit of it, so no bucket is hot however many copies a text
has: copies fall together before (summed on the map side). Within a bucket the least fingerprint is paired
with each other one (all are within RADIUS of each other, so the star loses no component), pairs are
deduplicated, and each is verified by its bits. Components walk over these (``links.components``).

A row with a null text has fingerprint 0, and documents of fingerprint 0 are linked like any others. Rows
that repeat a doc_id are documents each. A row with a null doc_id takes part in links; its component is
the smallest doc_id that it reaches, or null. Whole texts are read, STEP runs at a time. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.links import components
from tidewire.llm.store import Shelf, lean

WORDS, BITS, SEED, RADIUS = 3, 64, 42, 2
#: Runs whose bits are counted at once.
STEP = 1 << 14


def run_hashes(text: bytes) -> list[int]:
    """XXH64 of each run of WORDS words, in order."""
    words = text.translate(K.LOWER.tobytes()).split()
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= WORDS:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    starts = np.concatenate([[0], ends[: 1 - WORDS - 1] + 1])
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[WORDS - 1 :].tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), STEP):
        part = np.array(hashes[k : k + STEP], "<u8").view(np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(text: pa.Array) -> pa.Array:
    """The fingerprint of each text, as a signed long."""
    data, at = K.view(text)
    found = [majority(run_hashes(data[a:b].tobytes())) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def ball_links(prints: DataFrame) -> DataFrame:
    """(u, v): pairs of the distinct longs ``fp`` of ``prints`` that join all within RADIUS bits of each other; u < v."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < BITS - 1 else -(1 << k)).cast("long") for k in range(BITS)))
    near = prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    buckets = near.groupBy("variant").agg(F.collect_list("fp").alias("own")).where("size(own) > 1")
    star = buckets.select(F.array_min("own").alias("u"), F.explode("own").alias("v")).where("u < v").distinct()
    return star.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of ``docs``."""
    shelf = Shelf(lean(docs).sparkSession)
    slim = shelf.put(docs.select("doc_id", F.arrow_udf(fingerprints, "long")(F.col("text")).alias("fp")))
    prints = shelf.put(slim.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(ball_links(prints), shelf=shelf)
    joined = prints.join(comp.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    # a component has few fingerprints or many; each side is summed by it before the join
    named = joined.join(joined.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("fp", "component_id")
    # a fingerprint with many rows is a hot key of this join, whose other side has one row for it: adaptive execution splits it
    return slim.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
