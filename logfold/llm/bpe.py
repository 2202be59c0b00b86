"""Byte-level BPE encoding and decoding (1).

Two forms with equal results. ``encode_native`` is the method as named: higher-order functions fold ranked merges over the
bytes of the corpus's distinct words, looking pairs up in a literal rank map, and the ids go back to the documents by a
join. ``encode`` runs the same vocabulary's library in Arrow batches, without a shuffle; the query uses it, because the
native form's join of every document's words exceeds the disk and time allowed (figures in the README). ``decode``
concatenates the ids' binary pieces; ``decode_native`` does so with higher-order functions over a literal array of pieces.

A text is cut by the public split pattern; each match is encoded on its own: a match that is a token is its id, else
neighbours of least rank (the first among equals) are merged until none has a rank. <|endoftext|> is ordinary text. Null
texts are empty: no ids. Whole texts are read; repeated rows are each returned; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.llm import tokens
from logfold.llm.common import arrow_map, stored, table, texts

#: The literal rank map: slots, buckets and multipliers of its perfect hash.
SLOTS, BUCKETS, BY, SHIFT = 2**20, 131071, 40503, 7919


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def java_pattern() -> str:
    """The public split pattern for Java's engine, with Unicode white space as the tokenizer library has it."""
    import public_tokenizers

    spaces = r"\t-\r \x85\xA0  -     　"  # the characters with White_Space
    return public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{spaces}").replace(r"\s+(?!\S)", rf"[{spaces}]+(?![^{spaces}])").replace(r"|\s+", rf"|[{spaces}]+")


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left * 65536 + right to the rank of both together, for every way to cut a token in two tokens."""
    found = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                found[a * 65536 + b] = rank
    return found


def rank_map(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Displacements by bucket, and slots holding pair * 65536 + rank: a pair is in one slot or nowhere."""
    groups: dict[int, list[int]] = {}
    for k in pairs:
        groups.setdefault(k % BUCKETS, []).append(k)
    moves, slots = [0] * BUCKETS, [0] * SLOTS
    for b, keys in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        move = 0
        while True:
            at = [(k * BY + move * SHIFT) % SLOTS for k in keys]
            if len(set(at)) == len(at) and not any(slots[x] for x in at):
                break
            move += 1
        moves[b] = move
        for x, k in zip(at, keys):
            slots[x] = k * 65536 + pairs[k]
    return moves, slots


def _literal(values: list[int], kind: str) -> str:
    """SQL of a literal array: a text that the optimizer folds once."""
    return f"from_json('[{','.join(map(str, values))}]', 'array<{kind}>')"


def encode_words(words: DataFrame, path: str | None = None) -> DataFrame:
    """word and ids of the distinct words in column word, by DataFrame and SQL functions alone."""
    spark = words.sparkSession
    ranks = tokens.ranks(path or default_vocabulary())
    moves, slots = rank_map(pair_ranks(ranks))
    single = _literal([ranks[bytes([b])] for b in range(256)], "int")
    known = spark.createDataFrame(pa.table({"piece": pa.array(list(ranks), pa.binary()), "whole": pa.array(list(ranks.values()), pa.int32())}))
    key = "(l * 65536L + r)"
    slot = f"element_at({_literal(slots, 'bigint')}, cast(({key} * {BY} + element_at({_literal(moves, 'int')}, cast({key} % {BUCKETS} AS int) + 1) * {SHIFT}L) % {SLOTS} AS int) + 1)"
    found = f"transform(array({slot}), e -> CASE WHEN shiftright(e, 16) = {key} THEN cast(e & 65535 AS int) END)[0]"
    ranked = f"zip_with(slice(a, 1, size(a) - 1), slice(a, 2, size(a) - 1), (l, r) -> {found})"
    merged = "concat(slice(a, 1, p - 1), array(m), slice(a, p + 2, size(a)))"
    step = f"transform(array({ranked}), s -> transform(array(array_min(s)), m -> CASE WHEN m IS NULL THEN a ELSE transform(array(cast(array_position(s, m) AS int)), p -> {merged})[0] END)[0])[0]"
    first = f"transform(sequence(1, cast(length(bytes) AS int)), i -> element_at({single}, cast(conv(hex(substring(bytes, i, 1)), 16, 10) AS int) + 1))"
    fold = f"CASE WHEN whole IS NOT NULL THEN array(whole) WHEN length(bytes) = 1 THEN {first} ELSE aggregate(sequence(2, cast(length(bytes) AS int)), {first}, (a, n) -> IF(size(a) < 2, a, {step})) END"
    return words.withColumn("bytes", F.col("word").cast("binary")).join(F.broadcast(known), F.col("bytes") == F.col("piece"), "left").select("word", F.expr(fold).alias("ids"))


def encode_native(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every document, by DataFrame and SQL functions alone."""
    cut = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(java_pattern()), F.lit(0))
    cuts = stored(texts(docs).select("doc_id", cut.alias("words")).withColumn("row", F.monotonically_increasing_id()), "words")
    own = cuts.select("row", F.explode(F.array_distinct("words")).alias("word"))
    known = stored(encode_words(own.select("word").distinct(), path), "word-ids")
    maps = own.join(known, "word").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "ids"))).alias("known"))
    ids = F.flatten(F.transform("words", lambda w: F.col("known")[w]))
    return cuts.join(maps, "row", "left").select("doc_id", F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def decode_native(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded, the bytes of its ids, by SQL functions alone."""
    import base64
    import json

    pieces = sorted(tokens.ranks(path or default_vocabulary()).items(), key=lambda x: x[1])
    literal = f"from_json('{json.dumps([base64.b64encode(p).decode() for p, _ in pieces])}', 'array<binary>')"
    return encoded.withColumn("decoded", F.expr(f"unhex(array_join(transform(ids, i -> hex(element_at({literal}, i + 1))), ''))"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every document."""
    path = path or default_vocabulary()

    def run(batch: pa.RecordBatch) -> dict:
        ids = [np.frombuffer(tokens.encode(x or "", path, end=False), "<u4").astype(np.int32) for x in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": _lists(ids)}

    return arrow_map(texts(docs), run, "doc_id long, ids array<int>")


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded bytes."""
    path = path or default_vocabulary()

    def run(batch: pa.RecordBatch) -> dict:
        pieces, numbers = _tables(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded": []}
        for x in batch.column("ids"):
            ids = x.values.to_pylist() if x.is_valid else []
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
            out["decoded"].append(b"".join(map(pieces.__getitem__, ids)))
        return out | {"doc_id": batch.column("doc_id")}

    return arrow_map(encoded, run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")


_read: dict[str, tuple[list[bytes], list[str]]] = {}


def _tables(path: str) -> tuple[list[bytes], list[str]]:
    if path not in _read:
        pieces = [b""] * (1 + max((known := tokens.ranks(path)).values()))
        for p, k in known.items():
            pieces[k] = p
        _read[path] = pieces, [str(k) for k in range(len(pieces))]
    return _read[path]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by the native form."""
    out = decode_native(encode_native(table(spark, sf_dir, "documents")))
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
