"""Best-fit packing (2): a configuration linear program over the length histogram.

Documents become token ids and one end id; a document longer than a sequence is cut so that its last pieces are full.
Only the histogram of piece lengths (as many rows as a sequence has tokens, whatever the corpus) goes to the driver. There
the configuration program (least number of patterns that cover the histogram) is solved by multiplicative weights. Every
length has a price, at first its share of a sequence, and every pattern of a pool a weight, which is an exponential of its
price. A knapsack dynamic program bounded by the pieces there are fills the first patterns; the unbounded one prices each
length's best pattern in every round and adds it to the pool, and its value of a sequence makes the prices a lower bound.
Between two pricings the weights are multiplied by what each length lacks. Rounds end when the bound proves the plan best.
The fractional solution is rounded, the few pieces left over are filled by the bounded knapsack (or best-fit decreasing
where that takes fewer sequences), and wasteful sequences are taken apart and filled anew if that saves any.

Pieces then find their places without any join by pattern: the pieces of a length are ranked (by salted groups whose sizes
are summed first, so a length with a third of all rows is spread over many tasks), and the rank gives pattern, sequence
and offset by arithmetic on the pattern table, whose size depends on the sequence length only.

A null or empty text is the end id alone. Long texts are read whole. Repeated rows are packed once each; ties in the order
are between equal rows. An empty table gives no rows. Columns beside the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logfold.llm import tokens
from logfold.llm.common import arrow_map, prepare, stored, table, texts

CAPACITY = 2048
END_ID = 0
#: Pricings, multiplications of the weights after each, and how sharply weights follow prices (from, to).
ROUNDS = 40
STEPS = 25
SHARP = (100.0, 1000.0)
#: Pieces of one length that a task ranks at least; beyond this squared, the square root of their number.
GROUP = 64

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of a document's pieces."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, total, capacity))]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit words) of every piece."""
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = memoryview(tokens.encode(text or "", path) + end)
            for k, (a, n) in enumerate(_cuts(len(ids) // 4, capacity)):
                part = ids[4 * a : 4 * (a + n)]
                for name, v in zip(out, (doc, k, a, n, zlib.crc32(part), bytes(part))):
                    out[name].append(v)
        return out

    return arrow_map(texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def _price(sizes: np.ndarray, y: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the most value within each capacity, and the index of the size taken last there (-1: leave one free)."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1, np.int64)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, c, side="right"))
        best[c] = best[c - 1]
        if k:
            value = best[c - sizes[:k]] + y[:k]
            j = int(value.argmax())
            if value[j] > best[c] + 1e-12:
                best[c], take[c] = value[j], j
    return best, take


def _priced(sizes: np.ndarray, take: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the best pattern that holds it: indexes of its sizes, in order, and their copies."""
    m = len(sizes)
    last = np.maximum.accumulate(np.where(take >= 0, np.arange(capacity + 1), 0))
    seed, room = np.arange(m), capacity - sizes
    cells = [seed * m + seed]
    while True:
        at = last[room]
        seed, at = seed[at > 0], at[at > 0]
        if not len(seed):
            break
        cells.append(seed * m + take[at])
        room = at - sizes[take[at]]
    cell, copies = np.unique(np.concatenate(cells), return_counts=True)
    cuts = np.searchsorted(cell, np.arange(1, m) * m)
    return list(zip(np.split(cell % m, cuts), np.split(copies, cuts)))


def fill(left: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Fills sequences one kind after another, each with the longest piece left and, by the knapsack program bounded by the
    pieces left, at the price of a piece's length, the most tokens beside it. Sets of sums are the bits of a number."""
    left = {n: c for n, c in left.items() if c > 0}
    sizes, out = sorted(left, reverse=True), {}
    while sizes:
        longest = sizes[0]
        room = capacity - longest
        left[longest] -= 1
        sums, mask, reach, items = 1, (1 << (room + 1)) - 1, [], []
        for n in sizes:
            many, step = min(left[n], room // n), 1
            while many > 0 and not sums >> room & 1:
                copies = min(step, many)
                many, step = many - copies, 2 * step
                more = sums | sums << n * copies & mask
                if more != sums:
                    reach.append(sums)
                    items.append((n, copies))
                    sums = more
        left[longest] += 1
        held, at = {longest: 1}, sums.bit_length() - 1
        for (n, copies), before in zip(reversed(items), reversed(reach)):
            if not before >> at & 1:
                held[n] = held.get(n, 0) + copies
                at -= n * copies
        times = min(left[n] // c for n, c in held.items())
        for n, c in held.items():
            left[n] -= c * times
        pattern = tuple(sorted(held.items(), reverse=True))
        out[pattern] = out.get(pattern, 0) + times
        sizes = [n for n in sizes if left[n]]
    return out


@dataclass
class Mix:
    """A fractional solution: cells (pattern, index of a size, copies), a weight for each pattern, and the lower bound."""

    sizes: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    copies: np.ndarray
    weight: np.ndarray
    bound: float

    def covered(self) -> np.ndarray:
        return np.bincount(self.cols, self.weight[self.rows] * self.copies, len(self.sizes))


def fractional(sizes: np.ndarray, need: np.ndarray, capacity: int, start: dict[Pattern, int], rounds: int = ROUNDS, steps: int = STEPS) -> Mix:
    """Weights of patterns that cover the need, and the dual bound of the configuration program, by multiplicative weights."""
    m, at = len(sizes), {int(n): k for k, n in enumerate(sizes)}
    share = sizes / capacity
    volume = float((need * share).sum())
    y, bound = share.copy(), volume
    known: set[tuple[bytes, bytes]] = set()
    cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(cols: np.ndarray, copies: np.ndarray) -> bool:
        name = (cols.tobytes(), copies.tobytes())
        if name in known:
            return False
        cells.append((np.full(len(cols), len(known)), cols, copies))
        known.add(name)
        return True

    base = np.array([times for p, times in start.items() if add(*np.array(sorted((at[n], c) for n, c in p)).T.copy())], float)
    rows, cols, copies, weight = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), base
    for t in range(rounds):
        best, take = _price(sizes, y, capacity)
        bound = max(bound, float((need * y).sum() / best[capacity]))
        for pattern in _priced(sizes, take, capacity):
            add(*pattern)
        fresh = [np.concatenate(x) for x in zip(*cells)] if cells else [rows[:0], cols[:0], copies[:0]]
        cells.clear()
        rows, cols, copies = np.concatenate((rows, fresh[0])), np.concatenate((cols, fresh[1])), np.concatenate((copies, fresh[2]))
        base = np.concatenate((base, np.full(len(known) - len(base), volume / m / 10)))
        sharp = SHARP[0] * (SHARP[1] / SHARP[0]) ** (t / max(rounds - 1, 1))
        for step in range(steps + 1):
            weight = base * np.exp(np.clip(sharp * (np.bincount(rows, copies * y[cols], len(base)) - 1), -60, 20))
            if step < steps:
                z = np.bincount(cols, weight[rows] * copies, m) + 1e-300
                y = np.maximum(y + share * np.log(need / z).clip(-3, 3) / sharp, 0)
    return Mix(sizes, rows, cols, copies, weight, bound)


def _rounded(mix: Mix, need: np.ndarray) -> tuple[dict[Pattern, int], dict[int, int]]:
    """Whole patterns of a fractional solution that hold no more than there is, and the pieces left over."""
    left = need.astype(np.int64)
    order = np.argsort(mix.rows, kind="stable")
    cols, copies = mix.cols[order], mix.copies[order].astype(np.int64)
    starts = np.searchsorted(mix.rows[order], np.arange(len(mix.weight) + 1))
    full = np.bincount(mix.rows, mix.copies * mix.sizes[mix.cols], len(mix.weight))
    out: dict[Pattern, int] = {}
    for up in (1e-6, 1.0):
        for p in np.lexsort((-full, -mix.weight)).tolist():
            if mix.weight[p] < 1e-3:
                break
            a, b = starts[p], starts[p + 1]
            pattern = tuple((int(mix.sizes[k]), int(c)) for k, c in zip(cols[a:b][::-1], copies[a:b][::-1]))
            times = min(int((left[cols[a:b]] // copies[a:b]).min()), int(mix.weight[p] + up) - out.get(pattern, 0))
            if times > 0:
                left[cols[a:b]] -= times * copies[a:b]
                out[pattern] = out.get(pattern, 0) + times
    return out, {int(n): int(c) for n, c in zip(mix.sizes, left) if c}


def _placed(left: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Pieces left over, in as few sequences as the knapsack or best-fit takes."""
    a, b = fill(left, capacity), dict(best_fit(left, capacity))
    return a if sum(a.values()) <= sum(b.values()) else b


def _joined(a: dict[Pattern, int], b: dict[Pattern, int]) -> dict[Pattern, int]:
    return a | {p: a.get(p, 0) + times for p, times in b.items()}


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: equal bins are handled together."""
    bins: dict[int, list[tuple[list[int], int]]] = {}  # room left: contents and number of bins
    for size in sorted(left, reverse=True):
        n = left[size]
        while n > 0:
            room = next((r for r in sorted(bins) if r >= size), None)
            if room is None:
                held, count, room = [], -(-n // (capacity // size)), capacity
            else:
                held, count = bins[room].pop()
                if not bins[room]:
                    del bins[room]
            fits = room // size
            full = min(count, n // fits)
            if full:
                bins.setdefault(room - fits * size, []).append((held + [size] * fits, full))
                n -= full * fits
            rest = count - full
            if rest and n:
                bins.setdefault(room - n * size if n < fits else room - fits * size, []).append((held + [size] * min(n, fits), 1))
                n -= min(n, fits)
                rest -= 1
            if rest and held:
                bins.setdefault(room, []).append((held, rest))
    found: dict[Pattern, int] = {}
    for group in bins.values():
        for held, count in group:
            if held:
                pattern = tuple(sorted(Counter(held).items(), reverse=True))
                found[pattern] = found.get(pattern, 0) + count
    return list(found.items())


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns with whole multiplicities that hold each length exactly as often as the histogram says."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    n = left.pop(capacity, 0)
    whole = {((capacity, 1),): n} if n else {}
    if not left:
        return list(whole.items())
    sizes = np.array(sorted(left))
    need = np.array([left[int(s)] for s in sizes], float)
    plan = fill(left, capacity)
    if sum(plan.values()) > np.ceil((need * sizes).sum() / capacity - 1e-9):
        mix = fractional(sizes, need, capacity, plan)
        placed, rest = _rounded(mix, need)
        plans = [plan, _joined(placed, _placed(rest, capacity)), _placed(left, capacity)]
        for limit in (1.0, 0.999, 0.99, 0.95):  # wasteful sequences taken apart
            held = min(plans, key=lambda p: sum(p.values()))
            if sum(held.values()) <= np.ceil(mix.bound - 1e-6):
                break
            keep = {p: times for p, times in held.items() if sum(a * c for a, c in p) >= limit * capacity}
            loose: dict[int, int] = {}
            for p, times in held.items():
                if p not in keep:
                    for a, c in p:
                        loose[a] = loose.get(a, 0) + c * times
            plans.append(_joined(keep, _placed(loose, capacity)))
        plan = min(plans, key=lambda p: sum(p.values()))
    return list((whole | plan).items())


@dataclass
class Places:
    """For each length, its slots: first rank, copies, first sequence and offset of every pattern that holds it."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, plan: list[tuple[Pattern, int]]) -> Places:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        free: dict[int, int] = {}
        base = 0
        for pattern, times in plan:
            offset = 0
            for n, copies in pattern:
                rows.setdefault(n, []).append((free.get(n, 0), copies, base, offset))
                free[n] = free.get(n, 0) + copies * times
                offset += n * copies
            base += times
        return cls({n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in rows.items()})

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of the pieces of a length with these ranks."""
        first, copies, base, offset = self.by_length[length]
        k = np.searchsorted(first, rank, side="right") - 1
        d = rank - first[k]
        return base[k] + d // copies[k], offset[k] + d % copies[k] * length


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, start, length, ... in a stored table) with sequence_id and offset."""
    spark, names = parts.sparkSession, list(parts.columns)
    prepare(spark)
    histogram = {r.length: r["count"] for r in parts.groupBy("length").count().collect()}
    places = Places.of(solve(histogram, capacity))
    salts = spark.createDataFrame([(int(n), max(1, int(c / max(GROUP, c**0.5)))) for n, c in histogram.items()], "length long, salts long")
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]
    salted = parts.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(*order), "salts")).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy(*order)
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("nth")).select(*names, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = length == n
                seq[at], off[at] = places.find(int(n), rank[at])
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the whole sequences, where packed carries the pieces' ids. A sequence is at most the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    parts = pieces(docs, vocabulary, capacity)
    return pack(stored(parts if keep_ids else parts.drop("ids"), "pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
