"""Vector best-fit packing of token pieces into sequences.

A sequence has three residual capacities: tokens, documents and attention cost (sum of squared
lengths). Pieces of one length need the same vector, so the packer works on the histogram of
lengths: longest first, each goes to the kind of open sequence that fits under every capacity
with the best score (weighted dot product of need and residual, or the norm of what is left).
Sequences with equal residuals are one kind with a count, so the packer's work and memory depend
on the token capacity, never on the number of documents. Its output, runs of equal lengths by
kind of sequence, is laid over the pieces by their rank within their length.

Scale: texts are tokenized once, batch by batch, and never shuffled; the pieces (a few numbers
each) are written to the shared folder. What reaches the driver is the histogram, at most
`capacity` rows. Ranks come from counts by (length, bucket) and a window inside each of those, so
a length that holds a third of all pieces is spread over `BUCKETS` groups.

Defined results: null text is empty, one token (the end id). Repeated rows are packed as often as
they come. An empty table gives no rows. Extra columns are ignored. Which of several pieces of
one length goes where follows from their ids.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, materialize, table

CAPACITY, END_ID = 2048, 0
BUCKETS = 1024
#: Beyond Latin letters and marks the libraries' character tables may differ.
UNCOMMON = re.compile("[^\x00-\u024f]")


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer's file, and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _fast(ranks: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    `path` defines the ids. Where `ranks` gives the same vocabulary as byte-pair ranks, texts whose
    characters are all common ones are encoded from those, with the same ids in less time; texts
    with other characters or a special token's name, where the two libraries could differ, are not.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path, self.ranks = path, ranks

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        slow = []
        for k, t in enumerate(texts):
            if self.ranks and "<|" not in t and (t.isascii() or not UNCOMMON.search(t)):
                out[k] = np.array(_fast(self.ranks).encode_ordinary(t), "<u4").tobytes()
            else:
                slow.append(k)
        if slow:
            for k, e in zip(slow, _tokenizer(self.path).encode_batch_fast([texts[k] for k in slow], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: tuple[str, str | None] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document, with their ids: only documents over `capacity` are cut; the first piece takes the remainder."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(*path)
        for b in batches:
            got = defaultdict(list)
            encoded: list[bytes] = []
            texts, start, size = list(b["text"]), 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size > 1_000_000 or k == len(texts) - 1:
                    encoded += encode([x if isinstance(x, str) else "" for x in texts[start : k + 1]])
                    start, size = k + 1, 0
            for i, ids in zip(b["doc_id"], encoded, strict=True):
                ids += END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                count = -(-n // capacity)
                at, end = 0, n - (count - 1) * capacity
                for p in range(count):
                    part = ids[4 * at : 4 * end]
                    for c, v in zip(("doc_id", "piece", "start", "length", "ids_crc32"), (i, p, at, end - at, zlib.crc32(part)), strict=True):
                        got[c].append(v)
                    at, end = end, end + capacity
            if got:
                yield pd.DataFrame(got).astype({"doc_id": "Int64"})

    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_histogram(counts: dict[int, int], tokens: int, documents: int, attention: int, rule: str = "dot", weights=(1.0, 0.05, 0.2)) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences: (how many, [(length, pieces of it per sequence), ...]).

    Best fit, longest lengths first. `rule`: "dot" takes the kind with the least weighted dot
    product of need and residual among those that fit (the fullest), "norm" the one whose residual
    has the least norm after placing.
    """
    cap = np.array([tokens, documents, attention], float)
    w = np.array(weights, float)
    if any(n > tokens or n * n > attention for n in counts) or documents < 1:
        raise ValueError("a piece exceeds a sequence")
    kinds: dict[tuple[int, int, int], list[tuple[int, tuple]]] = {}  # residual -> [(count, contents)]
    for length in sorted(counts, reverse=True):
        left, need = counts[length], np.array([length, 1, length * length], float)

        def score(r) -> float:
            rest = (np.array(r) - need) / cap
            return float((w * (need / cap) * (np.array(r) / cap)).sum()) if rule == "dot" else float((w * rest * rest).sum())

        def per(r) -> int:
            return min(r[0] // length, r[1], r[2] // (length * length))

        open_ = sorted((r for r in kinds if per(r) >= 1), key=lambda r: (score(r), r))
        for r in open_:
            while left and kinds.get(r):
                n, inside = kinds[r].pop()
                k = min(per(r), left)
                many = min(n, left // k)  # sequences that take k pieces each
                if many < n:
                    kinds[r].append((n - many, inside))
                to = (r[0] - k * length, r[1] - k, r[2] - k * length * length)
                kinds.setdefault(to, []).append((many, (*inside, (length, k))))
                left -= many * k
            if not kinds.get(r):
                kinds.pop(r, None)
        if left:
            full = (tokens, documents, attention)
            k = per(full)
            for many, each in ((left // k, k), (1, left % k)):
                if many and each:
                    to = (tokens - each * length, documents - each, attention - each * length * length)
                    kinds.setdefault(to, []).append((many, ((length, each),)))
    return [(n, list(inside)) for r in sorted(kinds) for n, inside in kinds[r]]


def slots(kinds) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces per sequence, first sequence, offset of the first piece)."""
    used, sequence, out = defaultdict(int), 0, []
    for many, inside in kinds:
        offset = 0
        for length, k in inside:
            out.append((length, used[length], many * k, k, sequence, offset))
            used[length] += many * k
            offset += length * k
        sequence += many
    return out


def pack(items: DataFrame, order: list[str], tokens: int = CAPACITY, documents: int = CAPACITY, attention: int = CAPACITY * CAPACITY, rule: str = "dot") -> DataFrame:
    """`items` (length, the `order` columns that tell pieces apart, more) with sequence_id and offset appended."""
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length: at most `tokens`
    placed = slots(pack_histogram(histogram, tokens, documents, attention, rule))
    length, first, _, each, sequence, offset = (np.array(x, np.int64) for x in zip(*sorted(placed), strict=True)) if placed else [np.zeros(0, np.int64)] * 6
    key = (length << 40) + first  # a length has fewer than 2**40 pieces

    keyed = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    base = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    base = base.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)).cast("long"))
    ranked = ranked.join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base") - 1).drop("_base", "_bucket")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mine, rank = b["length"].to_numpy(np.int64), b["_rank"].to_numpy(np.int64)
            s = np.searchsorted(key, (mine << 40) + rank, "right") - 1
            i = rank - first[s]
            yield b.drop(columns="_rank").assign(sequence_id=sequence[s] + i // each[s], offset=offset[s] + i % each[s] * mine)

    kept = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_rank") + ", sequence_id long, offset long"
    return mapped(ranked.select(*kept, "_rank"), place, schema)


def pack_documents(docs: DataFrame, tokenizer: tuple[str, str | None] | None = None, capacity: int = CAPACITY) -> DataFrame:
    got = materialize(pieces(docs, capacity, tokenizer))
    return pack(got, ["doc_id", "piece", "ids_crc32"], capacity, capacity, capacity * capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
