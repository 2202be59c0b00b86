"""Near-duplicate documents by word shingles: SimHash and MinHash find candidates, the exact Jaccard similarity links them.

A text's words are its lower-cased parts between ASCII white space; its shingles are the distinct runs of that many words,
as 64-bit hashes. Texts of the same words are one text (a 64-bit hash of the words tells), so exact copies cost one row.
The SimHash operator's grid join (simhash.py: popcount embedding, Manhattan distance, exact check), over the same shingles,
gives the classes of texts whose fingerprints lie within its distance of one another. At a similarity of 0.8 fingerprints
differ in some 10 bits, so further candidates are needed: MinHash signatures are cut into BANDS bands of ROWS, which find a pair at a similarity of 0.8 with a probability of 0.9998;
texts that share a band form a group, and the same group found by many bands is taken once. In each class and group the exact
similarity of the shingle sets decides. Only a spanning forest of a group's links is emitted. Those of more than GROUP
texts are met in two passes, as lines are (lines.py). Components are found by distributed rounds.

Null texts and texts without words are copies of one another. Texts with fewer words than a shingle give one shingle of
them all. Long texts are read whole; repeated rows and ids are each returned, told apart by the hash of their texts; a null
doc_id stands behind all others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logfold.llm import simhash
from logfold.llm.common import arrow_map, discard, free_shuffles, prepare, stored
from logfold.llm.components import components
from logfold.llm.lines import _linked, grouped, hot_links, packed_runs, parts_for

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
#: Texts of a group that one task compares.
GROUP = 4096
PIVOTS = 64

_A = np.random.default_rng(11).integers(1, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = np.random.default_rng(12).integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_key(words: list[bytes]) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(b" ".join(words)), "little", signed=True)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of words."""
    if not words:
        return np.zeros(1, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    code = np.fromiter(map(digest, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        h = (h ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def bands(hashes: np.ndarray) -> list[int]:
    """The band hashes of one text's shingles."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(least, ((low[k : k + 2048] ^ _B[:, None]) * _A[:, None]).min(axis=1), out=least)
    least = least.astype(np.uint64).reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = (acc ^ least[:, k]) * np.uint64(0xC4CEB9FE1A85EC53)
        acc ^= acc >> np.uint64(31)
    return acc.view(np.int64).tolist()


def numbered(docs: DataFrame) -> DataFrame:
    """doc (the greatest long for a null id), copy (the text's hash) and text: rows equal in the first two are copies."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc, copy, key, fingerprint and the bands of every text."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        words = [words_of(x) for x in texts]
        fps = np.array([simhash.fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
        return {"doc": batch.column("doc"), "copy": batch.column("copy"), "key": [text_key(x) for x in words], "fp": fps, "bands": [bands(shingles(x, shingle)) for x in words]}

    return arrow_map(numbered(docs), run, "doc long, copy long, key long, fp long, bands array<long>")


def groups(distinct: DataFrame, size: int = GROUP) -> DataFrame:
    """grp, lines (keys) and hot, as lines.grouped gives them."""
    parts = parts_for(distinct, distinct.count() * BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS).T
                yield packed_runs(batch.column("key").to_numpy(), np.ascontiguousarray(found).view(np.uint64), parts)

    prepare(distinct.sparkSession)
    return grouped(distinct.select("key", "bands").mapInArrow(run, "part int, run binary"), parts, size)


def fingerprint_groups(distinct: DataFrame, size: int = GROUP) -> DataFrame:
    """The classes of the SimHash operator with two texts and more, as groups() gives its groups."""
    found = components(simhash.links(distinct.select("fp").distinct()))
    named = distinct.join(found, distinct.fp == found.node, "left").select(F.coalesce("component", "fp").alias("class"), "key")
    named = named.join(named.groupBy("class").count().where("count > 1"), "class").withColumn("grp", F.encode(F.concat(F.lit("class "), F.col("class").cast("string")), "utf-8"))
    few = named.where(F.col("count") <= size).groupBy("grp").agg(F.collect_list("key").alias("lines")).withColumn("hot", F.lit(False))
    return few.unionByName(named.where(F.col("count") > size).select("grp", F.array("key").alias("lines"), F.lit(True).alias("hot")))


def links(docs: DataFrame, distinct: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, size: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """a, b: links between distinct texts; every two of a group at the similarity are connected through them."""
    found = stored(fingerprint_groups(distinct, size).unionByName(groups(distinct, size)), "near-groups")
    free_shuffles(docs.sparkSession)
    members = found.where("not hot").groupBy("grp").agg(F.first("lines").alias("lines")).select("grp", F.explode("lines").alias("line"))
    hot = found.where("hot").select("grp", F.col("lines")[0].alias("line"))
    wanted = distinct.withColumnRenamed("key", "line").join(found.select(F.explode("lines").alias("line")).distinct(), "line", "left_semi")
    wanted = wanted.select("line", "least.doc", "least.copy").hint("shuffle_hash")
    held_texts = stored(numbered(docs).join(wanted, ["doc", "copy"]).select("line", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["line"]), "near-texts")
    free_shuffles(docs.sparkSession)

    def sets_of(found: list[str]) -> list[np.ndarray]:
        return [shingles(words_of(x), shingle) for x in found]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, keys, sets = None, [], []

        def close() -> list[tuple[int, int]]:
            return [(keys[i], keys[j]) for i, j in _linked(sets, similarity)] if len(sets) > 1 else []

        def rows(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

        for batch in batches:
            out = []
            for g, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if g != grp:
                    out += close()
                    grp, keys, sets = g, [], []
                keys.append(key)
                sets += sets_of([text])
            if out:
                yield rows(out)
        if out := close():
            yield rows(out)

    met = members.join(held_texts, "line").select("grp", "line", "text").repartition("grp").sortWithinPartitions("grp")
    edges = stored(met.mapInArrow(verify, "a long, b long").distinct(), "near-links")
    if not hot.isEmpty():
        edges = hot_links(hot.distinct(), held_texts, edges, sets_of, similarity, size, pivots)
    discard(found)
    discard(held_texts)
    return edges


def classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, size: int = GROUP, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The rows (doc, copy, key) and, for each key, its class's first row (first, a struct of doc and copy)."""
    prints = stored(signatures(docs, shingle), "signatures")
    distinct = stored(prints.groupBy("key").agg(F.min(F.struct("doc", "copy")).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct-texts")
    edges = links(docs, distinct, similarity, shingle, size, pivots)
    found = components(edges)
    discard(edges)
    named = distinct.join(found, distinct.key == found.node, "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    firsts = named.groupBy("component").agg(F.min("least").alias("first"))
    return prints.select("doc", "copy", "key"), stored(named.join(firsts, "component").select("key", "first"), "classes")


def near_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, size: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links of at least the similarity, for every row."""
    prints, named = classes(docs, similarity, shingle, size, pivots)
    whole = lambda c: F.when(c != F.lit(2**63 - 1), c)
    return prints.join(named, "key").select(whole(F.col("doc")).alias("doc_id"), whole(F.col("first.doc")).alias("component_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, size: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """The first row (by doc_id, then text hash) of each class, with all columns of docs; of equal rows one."""
    prints, named = classes(docs, similarity, shingle, size, pivots)
    stays = named.select("first.doc", "first.copy").distinct().withColumnsRenamed({"doc": "_doc", "copy": "_copy"}).hint("shuffle_hash")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)) == stays["_doc"]) & (F.xxhash64(docs["text"].cast("string")) == stays["_copy"])
    out = docs.join(stays, same, "left_semi")
    if prints.groupBy("doc", "copy").count().where("count > 1").isEmpty():
        return out
    names = docs.columns
    marked = out.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    return marked.dropDuplicates(["doc_id", "_text_hash"]).select(*[f"`{c}`" for c in names])
