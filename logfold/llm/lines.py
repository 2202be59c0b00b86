"""Line dedup (3): exact and fuzzy lines by MinHash, one line kept per component.

A line is a part of a text between line breaks; lines of white space only are never removed. A line's key is a 128-bit
hash of the line with white space trimmed. Lines of the same key are one line. Character-shingle signatures (one
permutation dealt into bins, empty bins filled from others, which has MinHash's collision odds) are cut into bands that find
pairs at the threshold with high recall (above 0.998 each); lines that share a band form a group, the same group found by
many bands is taken once, and each group's links are verified by the exact Jaccard similarity of the shingle sets. Only a
spanning forest of the links is emitted. Components are found by distributed rounds over lines; the first line (by doc_id,
text hash, place) of each component stays, all others go.

Hot groups. A bucket that more than GROUP distinct lines share isn't compared in one task. It is dealt into blocks; in a
first pass each block's lines meet one another and PIVOTS lines of the bucket, so that near copies in any number come
together. In a second one those that aren't in the bucket's largest component so far meet all others, lot by lot. Both passes
are one job whatever the number of lines apart, and no link is lost.

Null texts stay null and count no lines. Empty texts stay. A text that loses all its lines becomes empty. Lines shorter
than a shingle are one shingle. Whole texts are read. Rows that repeat a doc_id (or have none) are told apart by their text's
hash, and rows equal in both are copies whose lines go together. Columns beside doc_id and text are passed through. An empty
table gives no rows. Beyond the exact step a line is known by 64 bits of its key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logfold.llm.common import arrow_map, arrow_schema, discard, free_shuffles, prepare, stored, table
from logfold.llm.components import components

SHINGLE = 8
SIMILARITY = 0.8
BANDS = 12
ROWS = 4
#: Distinct lines of a bucket that one task compares; lines of a hot bucket that all its blocks meet.
GROUP = 4096
PIVOTS = 64
#: Characters hashed at a time, so that the arrays stay in a core's cache.
BLOCK = 100_000
#: Cells (lines times shingles) of a group that are met in one matrix.
CELLS = 4_000_000
#: Shingles of a group that are indexed at once, and words of bits that its lines' sets may take.
FLAT = 6_000_000
BIT_WORDS = 6_000_000
#: Keys a task remembers so that a line it has met is not banded again.
SEEN = 200_000
#: Bytes of band rows in a partition, and of a run of them that a task holds before it sets hot buckets apart.
PART_BYTES = 16_000_000
HELD_BYTES = 64_000_000

_BINS = BANDS * ROWS
_NONE = np.uint32(0xFFFFFFFF)
#: Where an empty bin looks for a value, attempt by attempt.
_DONORS = np.random.default_rng(7).integers(0, _BINS, (6 * _BINS, _BINS))


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.strip().encode("utf-8", "surrogatepass"))


def _shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the character shingles of all lines, one after another, and where each line's begin."""
    parts = [x.strip() for x in lines]
    parts = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in parts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    h = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    step, by = 1, 0x9E3779B97F4A7C15
    while step < SHINGLE:  # a polynomial by doubling
        h = h[:-step] * np.uint64(by) + h[step:]
        step, by = 2 * step, by * by % 2**64
    for shift, mul in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mul)
    h ^= h >> np.uint64(32)
    ends = np.cumsum(sizes)
    keep = np.ones(len(h), bool)
    for k in range(1, SHINGLE):  # shingles that run over a line's end
        keep[ends[:-1] - k] = False
    begins = np.concatenate(([0], np.cumsum(sizes - SHINGLE + 1)[:-1])).astype(np.int64)
    return h[keep], begins


def bands(lines: list[str]) -> np.ndarray:
    """The band hashes of each line, a row for each band."""
    h, begins = _shingles(lines)
    n = len(lines)
    cell = np.repeat(np.arange(0, n * _BINS, _BINS), np.diff(np.append(begins, len(h))))
    cell += (((h >> np.uint64(32)) * np.uint64(_BINS)) >> np.uint64(32)).view(np.int64)
    least = np.full(n * _BINS, _NONE)
    np.minimum.at(least, cell, h.astype(np.uint32))
    least = least.reshape(n, _BINS)
    short = np.flatnonzero((least == _NONE).any(axis=1))
    own = least[short]
    full = own.copy()
    for donor in _DONORS:
        empty = full == _NONE
        if not empty.any():
            break
        np.copyto(full, own[:, donor], where=empty)
    np.copyto(full, own.min(axis=1, keepdims=True), where=full == _NONE)
    least[short] = full
    acc = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
    for k in range(ROWS):
        acc = (acc ^ least[:, k::ROWS]) * np.uint64(0xC4CEB9FE1A85EC53)
        acc ^= acc >> np.uint64(31)
    return np.ascontiguousarray(acc.T)


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _chunked(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in lots of bounded size."""
    lot, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                lot.append(text)
                size += len(text)
                if size >= chars:
                    yield lot
                    lot, size = [], 0
    if lot:
        yield lot


def packed_runs(ids: np.ndarray, found: np.ndarray, parts: int) -> pa.RecordBatch:
    """part and run: packed rows of bucket and id for each range of buckets, from the band hashes (a row for each band) of
    the ids. Packing spares a row for each of an id's bands."""
    rows = np.empty(found.size, np.dtype([("bucket", "<u8"), ("line", "<i8")]))
    rows["bucket"], rows["line"] = found.ravel(), np.tile(ids, len(found))
    part = (rows["bucket"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(part.astype(np.uint32), kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    starts = np.concatenate(([0], cuts))
    return pa.RecordBatch.from_pydict({"part": part[starts].astype(np.int32), "run": pa.array([x.tobytes() for x in np.split(rows, cuts)], pa.binary())})


def parts_for(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows of bucket and id."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * 16 // PART_BYTES))


def _band_runs(docs: DataFrame, parts: int) -> DataFrame:
    """The packed rows of bucket and line (the first 64 bits of the key), each line once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for lot in _chunked(batches):
            new: dict[bytes, str] = {}
            for text in lot:
                for line in text.split("\n"):
                    if line and not line.isspace():
                        key = line_key(line)
                        if key not in seen:
                            new[key] = line
                            seen.add(key)
            if len(seen) > SEEN:
                seen.clear()
            keys, lines = list(new), list(new.values())
            met, a = [], 0
            while a < len(lines):
                b, size = a, 0
                while b < len(lines) and (size < BLOCK or b == a):
                    size += len(lines[b])
                    b += 1
                met.append(bands(lines[a:b]))
                a = b
            if met:
                ids = np.fromiter(map(_short, keys), np.int64, len(keys))
                yield packed_runs(ids, np.concatenate(met, axis=1), parts)

    return docs.select("text").mapInArrow(run, "part int, run binary")


def grouped(runs: DataFrame, parts: int, size: int) -> DataFrame:
    """grp and lines: two to ``size`` ids that share a band, or one id of a hot bucket (hot is true); the same group may come
    from many bands.

    A task's run of rows is bounded by the number of partitions, which grows with the rows; a hot bucket's rows go out as
    soon as the run is too long.
    """
    spread = runs.repartition(parts, "part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, room = None, [], 0
        hot: set[int] = set()

        def hot_rows(buckets: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
            n = len(lines)
            ids = pa.array([int(x).to_bytes(8, "little") for x in buckets], pa.binary())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(lines))
            return pa.RecordBatch.from_arrays([ids, flat, pa.array(np.ones(n, bool))], names=["grp", "lines", "hot"])

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            """The groups of the rows held; unless last, only those of hot buckets, and the others stay held."""
            nonlocal held, room
            rows = np.frombuffer(b"".join(held), "<u8").reshape(-1, 2)
            order = np.argsort(rows[:, 0], kind="stable") if last else np.lexsort((rows[:, 1], rows[:, 0]))
            bucket, line = rows[order, 0], rows[order, 1].view(np.int64)
            if last and hot:
                more = np.isin(bucket, np.fromiter(hot, np.uint64, len(hot)))
                if more.any():
                    yield hot_rows(bucket[more], line[more])
                    bucket, line = bucket[~more], line[~more]
            if not last:
                new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (line[1:] != line[:-1])))
                bucket, line = bucket[new], line[new]
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
            if last:
                wide = ends - starts > 1
                found = []
                for a, b in zip(starts[wide].tolist(), ends[wide].tolist()):
                    got = np.unique(line[a:b])
                    if len(got) > size:
                        yield hot_rows(np.full(len(got), bucket[a]), got)
                    elif len(got) > 1:
                        found.append(got)
                if found:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), lists, pa.array(np.zeros(len(found), bool))], names=["grp", "lines", "hot"])
                held, room = [], 0
                return
            much = ends - starts > size
            hot.update(bucket[starts[much]].tolist())
            out = np.repeat(np.isin(bucket[starts], np.fromiter(hot, np.uint64, len(hot))), ends - starts)
            if out.any():
                yield hot_rows(bucket[out], line[out])
            held = [np.stack((bucket[~out], line[~out].view(np.uint64)), axis=1).tobytes()]
            room = len(held[0])

        for batch in batches:
            for p, run_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part:
                    if held:
                        yield from close(True)
                    part, hot = p, set()
                held.append(run_)
                room += len(run_)
                if room > HELD_BYTES:
                    yield from close(False)
        if held:
            yield from close(True)

    return spread.mapInArrow(run, "grp binary, lines array<long>, hot boolean")


def _numbered(docs: DataFrame) -> DataFrame:
    """doc (the least long for a null id), copy (its text's hash) and text: rows equal in the first two are copies."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """key, line (its first 64 bits) and position (doc, copy, place) of every line that is not white space."""

    def run(batch: pa.RecordBatch) -> dict:
        keys, at, place = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            if text:
                for k, line in enumerate(text.split("\n")):
                    if line and not line.isspace():
                        keys.append(line_key(line))
                        at.append(row)
                        place.append(k)
        return {"key": keys, "line": list(map(_short, keys)), "doc": batch.column("doc").take(at), "copy": batch.column("copy").take(at), "place": place}

    return arrow_map(_numbered(docs), run, "key binary, line long, doc long, copy long, place int").select("key", "line", F.struct("doc", "copy", "place").alias("position"))


def _sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each line."""
    h, begins = _shingles(lines)
    out = []
    for x in np.split(h, begins[1:]):
        x.sort()
        new = np.empty(len(x), bool)
        new[0] = True
        np.not_equal(x[1:], x[:-1], out=new[1:])
        out.append(x[new])
    return out


def _forest(lines: list[str], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among the lines of a group: all at once where their shingles fit a matrix."""
    n = len(lines)
    if n * sum(map(len, lines)) > CELLS:
        return _linked(_sets(lines), similarity)
    h, begins = _shingles(lines)
    kinds, kind = np.unique(h, return_inverse=True)
    has = np.zeros((n, len(kinds)), np.float32)
    has[np.repeat(np.arange(n), np.diff(np.append(begins, len(h)))), kind] = 1
    both = has @ has.T  # whole numbers below 2**24
    size = both.diagonal()
    near = both >= similarity * (size[:, None] + size - both) - 1e-4
    new, edges = np.ones(n, bool), []
    for k in range(n):
        if new[k]:
            new[k], queue = False, [k]
            while queue:
                j = queue.pop()
                more = np.flatnonzero(near[j] & new)
                new[more] = False
                edges += [(j, int(x)) for x in more]
                queue += more.tolist()
    return edges


def _linked(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among lines. Lines with too many shingles of their own have no link. Of the others,
    two that link share one of each one's rarest shingles, one more than a link lets it miss; those that do are met in
    full, as rows of bits where these are fewer words than shingles. The search begins with the lines of the most common
    shingles, so that a group's centre takes it up at once."""
    size = np.array([len(x) for x in sets])
    if size.sum() > FLAT:
        return _linked_one_by_one(sets, size, similarity)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    lines = np.arange(len(sets))
    while len(lines):
        seen = np.bincount(ids)
        own = np.add.reduceat(seen[ids] == 1, np.cumsum(size) - size, dtype=np.int64)
        may = own <= (1 - similarity) * size + 1e-6
        if may.all():
            break
        ids, lines, size = ids[np.repeat(may, size)], lines[may], size[may]
    if len(lines) < 2:
        return []
    first, row = np.cumsum(size) - size, np.repeat(np.arange(len(lines)), size)
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(seen))
    ids = np.sort(row * len(seen) + rank[ids]) - row * len(seen)  # rarest first
    centre = np.add.reduceat(np.sort(seen)[ids], first) / size
    leads = np.floor((1 - similarity) * size + 1e-6).astype(np.int64) + 1
    lead = np.arange(len(ids)) - first[row] < leads[row]
    order = np.argsort(ids[lead], kind="stable")
    kind, at = ids[lead][order], row[lead][order]
    new, mark = np.ones(len(lines), bool), np.zeros(len(seen), bool)
    bits = _bit_rows(ids, first, size, int(np.count_nonzero(seen < 2)), len(seen))
    left, indexed = len(lines), 0
    edges: list[tuple[int, int]] = []
    for start in np.argsort(-centre, kind="stable").tolist():
        if not new[start]:
            continue
        new[start], queue, left = False, [start], left - 1
        while queue and left:
            if not indexed or left < 0.8 * indexed:
                kind, at = kind[new[at]], at[new[at]]
                begins, indexed = np.searchsorted(kind, np.arange(len(seen) + 1)), left
            k = queue.pop()
            mine = ids[first[k] : first[k] + size[k]]
            lead, met = mine[: leads[k]], np.zeros(len(lines), bool)
            met[at[_ranges(begins[lead], begins[lead + 1] - begins[lead])]] = True
            near = np.flatnonzero(met & new)
            near = near[(size[near] >= similarity * size[k] - 1e-9) & (similarity * size[near] <= size[k] + 1e-9)]
            if not len(near):
                continue
            if bits is not None:
                both = np.bitwise_count(bits[near] & bits[k]).sum(axis=1, dtype=np.int64)
            else:
                mark[mine] = True
                both = np.add.reduceat(mark[ids[_ranges(first[near], size[near])]], np.cumsum(size[near]) - size[near], dtype=np.int64)
                mark[mine] = False
            near = near[both >= similarity * (size[k] + size[near] - both) - 1e-9]
            new[near], left = False, left - len(near)
            edges += [(int(lines[k]), int(lines[j])) for j in near]
            queue += near[np.argsort(centre[near], kind="stable")].tolist()
    return edges


def _bit_rows(ids: np.ndarray, first: np.ndarray, size: np.ndarray, low: int, kinds: int) -> np.ndarray | None:
    """Each line's shingles from number ``low`` on (those below have one line each) as a row of bits; none where the rows
    would be longer than the sets or too many."""
    words = -(-(kinds - low) // 64)
    if not words or words > ids.size / len(first) or words * len(first) > BIT_WORDS:
        return None
    out = np.empty((len(first), words), np.uint64)
    step = max(1, CELLS // (64 * words))
    for a in range(0, len(first), step):
        b = min(a + step, len(first))
        mine = ids[first[a] : first[b - 1] + size[b - 1]] - low
        rows = np.repeat(np.arange(b - a), size[a:b])
        flags = np.zeros((b - a, 64 * words), bool)
        flags[rows[mine >= 0], mine[mine >= 0]] = True
        out[a:b] = np.packbits(flags, axis=1).view(np.uint64)
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _linked_one_by_one(sets: list[np.ndarray], size: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """The same without an index, breadth first; sizes bound the similarity before sets are met."""
    left = np.argsort(size, kind="stable")
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = _near(sets, size, k, left, similarity)
            edges += [(k, int(j)) for j in near]
            queue += near.tolist()
            left = left[~np.isin(left, near, assume_unique=True)]
    return edges


def _near(sets: list[np.ndarray], size: np.ndarray, k: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Those of the others that line k links to."""
    n = size[k]
    near = others[(size[others] >= similarity * n - 1e-9) & (similarity * size[others] <= n + 1e-9)]
    if not len(near):
        return near
    flat = np.concatenate([sets[j] for j in near]) if len(near) > 1 else sets[near[0]]
    at = np.searchsorted(sets[k], flat)
    at[at == n] = 0
    hit = sets[k][at] == flat
    both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(size[near])[:-1])), dtype=np.int64)
    return near[both >= similarity * (n + size[near] - both) - 1e-9]


def _star(lines: list[str], begins: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of every line with the first line of its group; groups begin at ``begins``. All groups at
    once: a group's number stands in front of its shingles, which are sorted and met in one array."""
    h, first = _shingles(lines)
    n = len(lines)
    bits = np.uint64(64 - n.bit_length())
    keys = (np.repeat(np.arange(n, dtype=np.uint64), np.diff(np.append(first, len(h)))) << bits) | (h >> (np.uint64(64) - bits))
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    size = np.bincount((keys >> bits).view(np.int64), minlength=n)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    group = np.zeros(n, np.int64)
    group[begins[1:]] = 1
    head = begins[np.cumsum(group)]  # each line's first line
    others = np.flatnonzero(head != np.arange(n))
    out = np.ones(n)
    if len(others):
        mask = (np.uint64(1) << bits) - np.uint64(1)
        parts = []
        for side in (others, head[others]):
            count = size[side]
            at = np.repeat(first[side] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            parts.append((np.repeat(np.arange(len(others), dtype=np.uint64), count) << bits) | (keys[at] & mask))
        met = np.concatenate(parts)
        met.sort()
        both = np.bincount((met[1:][met[1:] == met[:-1]] >> bits).view(np.int64), minlength=len(others))
        out[others] = both / (size[others] + size[head[others]] - both)
    return out


def _verified(rows: list[tuple[bytes, int, str]], similarity: float) -> list[tuple[int, int]]:
    """Links of whole groups (grp, line, text, in order of grp): by stars, and in full where a star leaves a line out."""
    out: list[tuple[int, int]] = []
    a = 0
    while a < len(rows):
        b, size, begins = a, 0, []
        while b < len(rows) and (size < BLOCK or rows[b][0] == rows[b - 1][0]):
            if b == a or rows[b][0] != rows[b - 1][0]:
                begins.append(b - a)
            size += len(rows[b][2])
            b += 1
        lot = rows[a:b]
        near = _star([r[2] for r in lot], np.array(begins)) >= similarity - 1e-9
        for i, j in zip(begins, [*begins[1:], len(lot)]):
            if j - i == 2 or near[i:j].all():
                out += [(lot[i][1], lot[k][1]) for k in range(i + 1, j) if near[k]]
            else:
                out += [(lot[i + x][1], lot[i + y][1]) for x, y in _forest([r[2] for r in lot[i:j]], similarity)]
        a = b
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(docs: DataFrame, firsts: DataFrame, similarity: float = SIMILARITY, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """a, b: lines (64 bits of the key) joined by verified links, in a stored table."""
    spark = docs.sparkSession
    prepare(spark)
    parts = parts_for(docs, firsts.count() * BANDS)
    groups = stored(grouped(_band_runs(docs, parts), parts, group), "line-groups")
    free_shuffles(spark)
    members = groups.where("not hot").groupBy("grp").agg(F.first("lines").alias("lines")).select("grp", F.explode("lines").alias("line"))
    hot = groups.where("hot").select("grp", F.col("lines")[0].alias("line"))
    wanted = firsts.join(groups.select(F.explode("lines").alias("line")).distinct(), "line", "left_semi")
    by_doc = wanted.groupBy("position.doc", "position.copy").agg(F.collect_list("position.place").alias("places")).hint("shuffle_hash")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"line": [], "text": []}
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            parts = text.split("\n")
            for p in places:
                line = parts[p].strip()
                out["line"].append(_short(line_key(line)))
                out["text"].append(line)
        return out

    texts = arrow_map(_numbered(docs.where("text is not null")).join(by_doc, ["doc", "copy"]).select("text", "places"), cut, "line long, text string")
    found = stored(texts.dropDuplicates(["line"]), "line-texts")
    free_shuffles(spark)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups, and the one that may go on
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            last = len(held) - 1
            while last and held[last - 1][0] == held[-1][0]:
                last -= 1
            if last:
                yield _edges(_verified(held[:last], similarity))
                held = held[last:]
        if held:
            yield _edges(_verified(held, similarity))

    met = members.join(found, "line").select("grp", "line", "text").repartition("grp").sortWithinPartitions("grp")
    edges = stored(met.mapInArrow(verify, "a long, b long").distinct(), "line-links")
    if not hot.isEmpty():
        edges = hot_links(hot.distinct(), found, edges, _sets, similarity, group, pivots)
    discard(groups)
    discard(found)
    return edges


Sets = Callable[[list[str]], list[np.ndarray]]


def hot_links(hot: DataFrame, found: DataFrame, edges: DataFrame, sets_of: Sets, similarity: float, group: int, pivots: int) -> DataFrame:
    """edges and the links within hot buckets (grp, line), found in two passes; found has each line's text."""
    spark = hot.sparkSession
    rows = stored(hot, "hot-lines")
    half = max(1, group // 2)
    sizes = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("blocks"))
    spread = rows.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("line"), "blocks").cast("int"))
    members = stored(spread.join(found, "line").select("grp", "blocks", "block", "line", "text"), "hot-members")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sets = None, [], []

        def close() -> list[tuple[int, int]]:
            return [(held[i], held[j]) for i, j in _linked(sets, similarity)] if len(sets) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            for grp, block, other, line, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, block, other) != at:
                    out += close()
                    at, held, sets = (grp, block, other), [], []
                held.append(line)
                sets += sets_of([text])
            if out:
                yield _edges(out)
        if out := close():
            yield _edges(out)

    def with_met(tasks: DataFrame) -> DataFrame:
        """edges with the links in each task (grp, block, other), stored."""
        met = tasks.select("grp", "block", "other", "line", "text").repartition("grp", "block", "other").sortWithinPartitions("grp", "block", "other")
        after = stored(edges.unionByName(met.mapInArrow(meet, "a long, b long")).distinct(), "line-links")
        discard(edges)
        free_shuffles(spark)
        return after

    heads = members.withColumn("nth", F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("line", F.lit(1)), "line"))).where(F.col("nth") <= pivots)
    heads = heads.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block").withColumn("block", F.col("to"))
    own = members.select("grp", "block", "line", "text").unionByName(heads.select("grp", "block", "line", "text"))
    edges = with_met(own.withColumn("other", F.col("block")))

    placed = members.join(components(edges).withColumnRenamed("node", "line"), "line", "left").select("grp", "line", F.coalesce("component", "line").alias("component"))
    placed = stored(placed, "hot-placed")
    most = placed.groupBy("grp", "component").count().groupBy("grp").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("component", F.struct("count", "component")).alias("largest"))
    in_blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / half)).cast("int")
    most = most.select("grp", "largest", in_blocks(F.col("n") - F.col("most")).alias("apart"), in_blocks(F.col("most")).alias("blocks"))
    salt, apart = F.xxhash64("line", F.lit(2)), F.col("component") != F.col("largest")
    deal = F.when(apart, F.pmod(salt, "apart")).otherwise(F.col("apart") + F.pmod(salt, "blocks")).cast("int")
    dealt = stored(members.select("grp", "line", "text").join(placed.join(most, "grp").select("grp", "line", "apart", "blocks", deal.alias("deal")), ["grp", "line"]), "hot-dealt")
    # A task for each lot of lines apart and each lot from it on.
    asked = dealt.where("deal < apart").withColumn("block", F.col("deal")).withColumn("other", F.explode(F.sequence("deal", F.col("apart") + F.col("blocks") - 1)))
    answer = dealt.where("deal > 0").withColumn("other", F.col("deal")).withColumn("block", F.explode(F.sequence(F.lit(0), F.least("deal", "apart") - 1)))
    answer = answer.join(asked.select("grp").distinct(), "grp", "left_semi")
    edges = with_met(asked.select("grp", "block", "other", "line", "text").unionByName(answer.select("grp", "block", "other", "line", "text")))
    for t in (rows, members, placed, dealt):
        discard(t)
    return edges


def kept_places(docs: DataFrame, similarity: float = SIMILARITY, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """doc, copy and the places of the lines that stay, for documents with any."""
    firsts = stored(occurrences(docs).groupBy("line", "key").agg(F.min("position").alias("position")).select("line", "position"), "line-firsts")
    free_shuffles(docs.sparkSession)
    edges = links(docs, firsts, similarity, group, pivots)
    found = components(edges)
    discard(edges)
    lines = firsts.join(found, F.col("line") == F.col("node")).select("component", "line", "position")
    stays = lines.groupBy("component").agg(F.min_by("line", "position").alias("line"))
    gone = lines.join(stays, ["component", "line"], "left_anti").select("line")
    left = firsts.join(gone, "line", "left_anti")
    return left.groupBy("position.doc", "position.copy").agg(F.collect_list("position.place").alias("places"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """docs with only the kept lines (and the white-space lines) in its text, and n_lines_removed at the end."""
    names = list(docs.columns)
    at = names.index("text")
    kept = kept_places(docs, similarity, group, pivots).select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), F.col("places").alias("_places")).hint("shuffle_hash")
    free_shuffles(docs.sparkSession)
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))) == kept["_doc"]) & (F.xxhash64(docs["text"].cast("string")) == kept["_copy"])
    joined = docs.join(kept, same, "left").select(*[docs[f"`{c}`"] for c in names], "_places")
    kind = arrow_schema(docs).field(at).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new, removed = [], []
            for text, places in zip(batch.column(at).to_pylist(), batch.column("_places").to_pylist()):
                gone = 0
                if text:
                    stay = set(places or ())
                    parts = text.split("\n")
                    left = [x for k, x in enumerate(parts) if k in stay or not x or x.isspace()]
                    gone = len(parts) - len(left)
                    if gone:
                        text = "\n".join(left) if any(x and not x.isspace() for x in left) else ""
                new.append(text)
                removed.append(gone)
            columns = batch.select(names).columns
            columns[at] = pa.array(new, kind)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=[*names, "n_lines_removed"])

    prepare(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{schema}, n_lines_removed long")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines_removed and kept_text of every document."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines_removed", F.col("text").alias("kept_text"))
