"""SimHash near-duplicates (6): segment-popcount embedding, grid range-join under Manhattan distance, exact check.

A fingerprint's 64 bits are read as 32 segments of two bits, each mapped to its number of ones. The Manhattan distance of
two such vectors never exceeds the Hamming distance, so fingerprints within Hamming distance k are within Manhattan
distance k. Cutting the vector into k + g blocks leaves at least g blocks where the two agree wholly; so joining on the
grid cells of every choice of g blocks finds every pair in range. Inside a cell the Manhattan bound, then the exact
distance decide. Only a spanning forest of a cell's links is emitted, never all its pairs, and components are found by
distributed rounds over distinct fingerprints, so exact copies cost one row.

A cell holds distinct fingerprints only. Those of one tight group all lie near one another, so their number is bounded by
the number of 64-bit values in that ball, whatever the number of documents; larger cells are cut by exact sub-keys.

Null or empty texts have fingerprint zero, linked like any other. Texts with fewer words than a shingle give one shingle
of them all. Long texts are read whole; repeated rows and ids are each returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.llm.common import arrow_map, discard, prepare, stored, table, texts
from logfold.llm.components import components

SEED = 42
SHINGLE = 4
MAX_DISTANCE = 4
#: Blocks that must agree in a cell.
AGREE = 3
#: A cell beyond this many fingerprints is cut by exact sub-keys.
CELL_ROWS = 2048

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[last : last + n].tolist())), np.uint64, n)
    octets = h.astype("<u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    return arrow_map(texts(docs), run, "doc_id long, fp long")


def popcounts(fps: np.ndarray) -> np.ndarray:
    """The embedding, packed: each two-bit segment of a fingerprint replaced by its number of ones."""
    odd = np.uint64(0x5555555555555555)
    return (fps & odd) + ((fps >> np.uint64(1)) & odd)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: segments hold 0, 1 or 2, so a borrow-free difference needs two lanes."""
    low = np.uint64(0x3333333333333333)
    total = 0
    for shift in (np.uint64(0), np.uint64(2)):
        x, y = (a >> shift) & low, (b >> shift) & low
        diff = (x | np.uint64(0x4444444444444444)) - y  # each lane 4 + x - y, from 2 to 6
        up = (diff >> np.uint64(2)) & np.uint64(0x1111111111111111)  # x >= y
        size = diff & low  # x - y where up, else 4 + x - y
        two = (size >> np.uint64(1)) & np.uint64(0x1111111111111111)
        one = size & np.uint64(0x1111111111111111)
        down = up ^ np.uint64(0x1111111111111111)
        ones = one & up | one & down
        total = total + np.bitwise_count(ones).astype(np.int64) + 2 * np.bitwise_count(two & (up | (down & ~one))).astype(np.int64)
    return total


def _masks(distance: int, agree: int) -> list[int]:
    """Bit masks of every choice of agree blocks out of distance + agree."""
    cuts = [round(32 * k / (distance + agree)) * 2 for k in range(distance + agree + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(len(block)), agree)]


def cells(fps: DataFrame, distance: int, agree: int) -> DataFrame:
    """cell, fp: a row for every grid cell that a distinct fingerprint falls into."""
    masks = _masks(distance, agree)

    def run(batch: pa.RecordBatch) -> dict:
        fp = batch.column("fp").to_numpy()
        packed = popcounts(fp.view(np.uint64))
        keys = [_mix((packed & np.uint64(m)) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) for k, m in enumerate(masks)]
        return {"cell": np.concatenate(keys).view(np.int64), "fp": np.tile(fp, len(masks))}

    return arrow_map(fps.select("fp"), run, "cell long, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words, to spread keys; cells that it might merge would only be checked together."""
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among distinct fingerprints, searched breadth first."""
    packed = popcounts(fps)
    left = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = left[manhattan(packed[left], packed[here]) <= distance] if len(left) > 64 else left
            near = near[np.bitwise_count(fps[near] ^ fps[here]) <= distance]
            if len(near):
                edges += [(here, int(k)) for k in near]
                queue += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return edges


def _links(fps: np.ndarray, distance: int) -> np.ndarray:
    """Pairs of fingerprints of one cell that connect what is linked there."""
    groups = [fps]
    if len(fps) > CELL_ROWS:  # of distance + 1 parts of the bits, one at least agrees
        groups = []
        cuts = [round(64 * k / (distance + 1)) for k in range(distance + 2)]
        for a, b in zip(cuts, cuts[1:]):
            part = (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            order = np.argsort(part, kind="stable")
            groups += [g for g in np.split(fps[order], np.flatnonzero(np.diff(part[order])) + 1) if len(g) > 1]
    found = [fps[:0].reshape(0, 2)]
    for g in groups:
        if e := forest(g, distance):
            found.append(g[np.array(e)])
    return np.concatenate(found)


def links(fps: DataFrame, distance: int = MAX_DISTANCE, agree: int = AGREE) -> DataFrame:
    """a, b: links between distinct fingerprints; every two within the distance are connected through them."""
    prepare(fps.sparkSession)
    spread = cells(fps, distance, agree).repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        cell = None

        def close() -> np.ndarray:
            got = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            return _links(got, distance) if len(got) > 1 else np.zeros((0, 2), np.uint64)

        for batch in batches:
            keys, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            out = []
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a == b:
                    continue
                if keys[a] != cell:
                    if len(held) > 1 or held and len(held[0]) > 1:
                        out.append(close())
                    held, cell = [], keys[a]
                held.append(fp[a:b])
            if out and len(e := np.concatenate(out)):
                yield _edges(e)
        if len(e := close()):
            yield _edges(e)

    return spread.mapInArrow(run, "a long, b long")


def _edges(e: np.ndarray) -> pa.RecordBatch:
    e = np.unique(np.sort(e, axis=1), axis=0).view(np.int64)
    return pa.RecordBatch.from_pydict({"a": np.ascontiguousarray(e[:, 0]), "b": np.ascontiguousarray(e[:, 1])})


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = MAX_DISTANCE, agree: int = AGREE) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id reachable over links of at most distance bits."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct, distance, agree))
    named = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "classes")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
