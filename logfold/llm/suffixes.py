"""Suffix-array dedup (4): merged Burrows-Wheeler transforms by iterative interleave refinement.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or another, is removed.
Three steps bring every such string together without sorting the corpus's suffixes in one place:

1. Anchors. The least hash among a window's k-mers fixes an anchor in it; windows of equal content have equal anchors at
   equal places. Each run of windows with one anchor is a segment, a short stretch of text that contains them all; so a
   window that repeats does so among the segments of one anchor. About one segment per hundred bytes.
2. Segments of equal anchor and content occur twice or more: all their windows repeat. Counting them needs two hashes per
   segment and no text. Segments whose anchor has one content once only are done, too.
3. The distinct segments of the remaining anchors are shards. Their transforms are merged: from the order of all suffixes
   by their first t symbols, the symbols before them give, stably sorted, the order by t + 1; a bit where neighbours differ
   marks the common prefix's end. Intervals left when the depth is the length asked for are the repeats, compared byte by
   byte. Suffixes that stand alone, or lead to no window whose rolling hash is met twice, drop out; suffixes are never
   compared or sorted as strings.
   A symbol is eight bytes, so the depth is reached in a few dozen rounds.

A common anchor costs one row per task when counted, and a run of equal segments (a text that repeats one character, say)
one row. Anchors with more than GROUP distinct segments aren't merged in one task: their windows, at most 169 a segment, are
counted by anchor and two 64-bit hashes over all tasks, which grows with the segments, not with their pairs.

Null texts are empty; texts shorter than the length lose nothing. Very long texts are read whole. Repeated rows are
repeats of one another; rows that share a doc_id (or have none) are told apart by their texts' hash. Columns beside doc_id
and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.llm.common import arrow_map, discard, free_shuffles, packed_texts, prepare, stored, table, unpacked

LENGTH = 200
#: Bytes of a k-mer (a power of two) and of a symbol of the transform; a length must be a multiple of the symbol.
KMER = 32
SYMBOL = 8
#: Distinct segments of an anchor that one task merges, and bytes that a task merges at a time.
GROUP = 4096
LOT = 1_000_000


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all k-mers, by doubling."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15F39CC060)
    h ^= h >> np.uint64(29)
    step, by = 1, 0xBF58476D1CE4E5B9
    while step < KMER:
        h = h[:-step] * np.uint64(by) + h[step:]
        by, step = by * by % 2**64, 2 * step
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def segments(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """anchor, and first and last window start, of every segment of a text; None if it is too short."""
    if len(raw) < length:
        return None
    h, w = _hashes(np.frombuffer(raw, np.uint8)), length - KMER + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties to the first
    blocks = np.concatenate((key, np.full(-len(h) % w, 2**64 - 1, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    at = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [n - 1]))
    return h[at[first]], first, last


def _candidates(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Those starts whose window's rolling hash occurs twice: all repeats, and perhaps others."""
    by = 0x9E3779B97F4A7C15
    powers = np.cumprod(np.full(len(data), by, np.uint64))
    powers *= data + np.uint64(1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(powers)))
    del powers
    h = sums[starts + length] - sums[starts]
    del sums
    h *= np.cumprod(np.full(len(data), pow(by, -1, 2**64), np.uint64))[starts]
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    del order
    if not len(twice):
        return starts[:0]
    at = np.searchsorted(twice, h)
    at[at == len(twice)] = 0
    return starts[twice[at] == h]


def repeated(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string the starts, in order, of its windows that occur elsewhere among the strings or in itself.

    Only suffixes that lead to a candidate window are interleaved: at depth t those that begin length - t after one.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64)
    starts = np.flatnonzero(np.repeat(ends, sizes) - np.arange(len(data)) >= length)
    starts = _candidates(data, starts, length)
    if not len(starts):
        return [starts] * len(strings)
    word, have = data, 1
    while have < SYMBOL:
        word = word[:-have] | (word[have:] << np.uint64(8 * have))
        have *= 2
    read = np.zeros(len(word), bool)
    for d in range(0, length, SYMBOL):
        read[starts + d] = True
    symbol = np.zeros(len(word), np.uint32)
    symbol[read] = np.unique(word[read], return_inverse=True)[1]
    order, block = starts + length, np.zeros(len(starts), np.int64)  # the empty suffixes: one interval
    for _ in range(length // SYMBOL):
        order = order - SYMBOL  # the interleave so far, read by the symbol before each suffix
        now = symbol[order]
        sort = _stable(now)
        order, block, now = order[sort], block[sort], now[sort]
        order, block = _shared(order, np.concatenate(([True], (now[1:] != now[:-1]) | (block[1:] != block[:-1]))))
        if not len(order):
            break
    order.sort()
    cuts = np.searchsorted(order, ends)
    return [order[a:b] - s for a, b, s in zip([0, *cuts[:-1].tolist()], cuts.tolist(), (ends - sizes).tolist())]


def _stable(symbols: np.ndarray) -> np.ndarray:
    """A stable order of symbols below 2**32, by 16 bits at a time."""
    sort = np.argsort(symbols.astype(np.uint16), kind="stable")
    high = (symbols >> np.uint32(16)).astype(np.uint16)
    return sort[np.argsort(high[sort], kind="stable")] if len(high) and high.max() else sort


def _shared(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of intervals of two or more, and the number of the interval that each is in."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    keep = ~alone
    return order[keep], np.cumsum(new[keep])


def _numbered(docs: DataFrame) -> DataFrame:
    """doc (the least long for a null id), copy (its text's hash) and text: rows equal in the first two are copies."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """anchor, content (hash of the segment), doc, copy, first and last of every segment; equal segments one after another
    are one row, n of them, from the first's first to the last's last. size is one segment's bytes."""

    def run(batch: pa.RecordBatch) -> dict | None:
        out: dict[str, list] = {k: [] for k in ("anchor", "content", "doc", "copy", "first", "last", "size", "n")}
        for doc, copy, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "copy", "text"))):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if (found := segments(raw, length)) is not None:
                anchor, first, last = found
                view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
                content = np.fromiter((digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(anchor))
                size = last - first + length
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (size[1:] != size[:-1])))
                at = np.flatnonzero(new)
                end = np.append(at[1:], len(new)) - 1
                k = len(at)
                for name, v in zip(out, (anchor[at].view(np.int64), content[at].view(np.int64), np.full(k, doc), np.full(k, copy), first[at].astype(np.int32), last[end].astype(np.int32), size[at].astype(np.int32), (end - at + 1).astype(np.int32))):
                    out[name].append(v)
        return {k: np.concatenate(v) for k, v in out.items()} if out["doc"] else None

    return arrow_map(_numbered(docs).drop("doc_id"), run, "anchor long, content long, doc long, copy long, first int, last int, size int, n int")


def _hot_windows(met: DataFrame, length: int) -> DataFrame:
    """doc, copy, start and stop of the windows that repeat among the distinct segments of one anchor, by counted hashes."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("anchor", "a", "b", "doc", "copy", "start")}
        for anchor, doc, copy, first, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "copy", "first", "bytes"))):
            for k in range(len(raw) - length + 1):
                digest = xxhash.xxh3_128_digest(raw[k : k + length])
                for name, v in zip(out, (anchor, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc, copy, first + k)):
                    out[name].append(v)
        return out

    windows = stored(arrow_map(met, run, "anchor long, a long, b long, doc long, copy long, start int"), "hot-windows")
    often = windows.groupBy("anchor", "a", "b").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    return windows.join(often, ["anchor", "a", "b"], "left_semi").select("doc", "copy", "start", (F.col("start") + length).alias("stop"))


def covered(docs: DataFrame, length: int = LENGTH, group: int = GROUP, lot: int = LOT) -> DataFrame:
    """doc, copy, start and stop of byte ranges to remove; ranges may overlap."""
    spark = docs.sparkSession
    anchors = stored(_anchors(docs, length), "anchors")
    counts = anchors.groupBy("anchor", "content").agg(F.sum("n").alias("times"))
    kinds = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    wanted = counts.join(kinds, "anchor").where("times > 1 or kinds > 1")
    found = stored(anchors.join(wanted, ["anchor", "content"]), "segments")
    discard(anchors)
    free_shuffles(spark)
    full = found.where("times > 1").select("doc", "copy", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    shards = found.where("kinds > 1").groupBy("anchor", "content").agg(*[F.first(c).alias(c) for c in ("kinds", "times", "doc", "copy", "first", "size")])
    by_doc = shards.groupBy("doc", "copy").agg(F.collect_list(F.struct("anchor", "kinds", "times", "first", "size")).alias("cuts")).hint("shuffle_hash")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("anchor", "kinds", "times", "doc", "copy", "first", "bytes")}
        for doc, copy, pressed, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc", "copy", "text", "cuts"))):
            raw = unpacked(pressed).encode("utf-8", "surrogatepass")
            for c in cuts:
                for name, v in zip(out, (c["anchor"], c["kinds"], c["times"], doc, copy, c["first"], raw[c["first"] : c["first"] + c["size"]])):
                    out[name].append(v)
        return out

    met = arrow_map(packed_texts(_numbered(docs.where("text is not null")).drop("doc_id")).join(by_doc, ["doc", "copy"]).select("doc", "copy", "text", "cuts"), cut, "anchor long, kinds long, times long, doc long, copy long, first int, bytes binary")
    prepare(spark)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            out: dict[str, list] = {k: [] for k in ("doc", "copy", "start", "stop")}
            for (_, times, doc, copy, first, _), at in zip(rows, repeated([r[-1] for r in rows], length)):
                if times == 1 and len(at):
                    runs = np.flatnonzero(np.diff(at) != 1) + 1
                    for a, b in zip(at[np.concatenate(([0], runs))].tolist(), at[np.concatenate((runs - 1, [len(at) - 1]))].tolist()):
                        for name, v in zip(out, (doc, copy, first + a, first + b + length)):
                            out[name].append(v)
            if out["doc"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["doc"], pa.int64()), pa.array(out["copy"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["stop"], pa.int32())], names=list(out))

        for batch in batches:
            new = list(zip(*(c.to_pylist() for c in batch.columns)))
            held += new
            size += sum(len(r[-1]) for r in new)
            if size >= lot:
                k = len(held) - 1
                while k and held[k - 1][0] == held[-1][0]:
                    k -= 1
                if k:
                    yield from close(held[:k])
                    held = held[k:]
                    size = sum(len(r[-1]) for r in held)
        if held:
            yield from close(held)

    cold = met.where(F.col("kinds") <= group).drop("kinds").repartition("anchor").sortWithinPartitions("anchor")
    parts = full.unionByName(cold.mapInArrow(merge, "doc long, copy long, start int, stop int"))
    if not found.where(F.col("kinds") > group).isEmpty():
        parts = parts.unionByName(_hot_windows(met.where(F.col("kinds") > group), length))
    ranges = stored(parts, "ranges")
    discard(found)
    free_shuffles(spark)
    return ranges


def dedup(docs: DataFrame, length: int = LENGTH, group: int = GROUP, lot: int = LOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    by_doc = covered(docs, length, group, lot).distinct().groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")).hint("shuffle_hash")
    pressed = packed_texts(_numbered(docs))
    joined = pressed.join(by_doc, ["doc", "copy"], "left").select("doc_id", "text", "ranges")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
        for pressed, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            raw = (unpacked(pressed) or "").encode("utf-8", "surrogatepass")
            kept, last, spans = [], 0, 0
            if ranges:
                for a, b in sorted((r["start"], r["stop"]) for r in ranges):
                    if a > last or not spans:
                        kept.append(raw[last:a])
                        spans += 1
                        last = b
                    else:
                        last = max(last, b)
            kept.append(raw[last:])
            rest = b"".join(kept)
            for name, v in zip(out, (len(raw), len(raw) - len(rest), spans, rest)):
                out[name].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    return arrow_map(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
