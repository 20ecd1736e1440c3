"""Best-fit packing by exact-complement hashing over the histogram of lengths.

A sequence holds `capacity` tokens, so however large the corpus is, a packing is decided by at most `capacity` counts.
The plan is made from those counts alone: combinations of one, two or three lengths that fill a gap exactly are
consumed as often as counts allow, then what is left goes best-fit into the smallest gap that holds it. Pieces get
their place by rank among the pieces of their length, without meeting in one task.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, shuffle_width

PIECES = "doc_id {0}, piece int, start long, length long, ids_crc32 long"
_tokenizers: dict = {}


def encoder(path: str, ranks: str | None = None):
    """text -> ids by `tokenizers`. With the rank file of the same vocabulary, texts in Latin-1 without special tokens
    take a faster library that gives the same ids; the others, and texts with very long words, never do."""
    if (path, ranks) not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(text: str) -> list[int]:
            if fast is not None and not any(s in text for s in special):
                try:
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    pass
                else:
                    if len(text) < 2000 or len(max(text.split(), key=len, default="")) < 2000 and "  " * 500 not in text:
                        return fast.encode_ordinary(text)
            return slow.encode(text, add_special_tokens=False).ids

        _tokenizers[path, ranks] = encode
    return _tokenizers[path, ranks]


def pieces(docs: DataFrame, path: str, ranks: str | None, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of each document: its ids then end_id, cut from the back into pieces of `capacity`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, ranks)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                at, piece = 0, 0
                step = len(ids) % capacity or capacity
                while at < len(ids):
                    rows.append((key, piece, at, step, zlib.crc32(ids[at : at + step].tobytes())))
                    at, piece, step = at + step, piece + 1, capacity
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype(batch["doc_id"].dtype)
            yield out

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Nulls would turn 64 bit ids into floats in pandas: such ids travel as text.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = rows.mapInPandas(run, PIECES.format("string"))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


class Complements:
    """What fills a gap exactly: an index from sums to one, two or three available lengths, by hash of the sum.

    An entry is the combination that counts allow most often when it is made. Counts only fall, so an entry is good for
    as long as its lengths are left, and a sum that no lengths make any more is never looked up again.
    """

    def __init__(self, have: np.ndarray):
        self.have = have
        self.pairs: dict[int, tuple[int, ...] | None] = {}
        self.triples: dict[int, tuple[int, ...] | None] = {}

    def left(self, parts: tuple[int, ...]) -> bool:
        return all(self.have[x] >= parts.count(x) for x in parts)

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.have[total] else None

    def _pair(self, total: int) -> tuple[int, ...] | None:
        if total < 2:
            return None
        a = np.arange(total - 1, (total - 1) // 2, -1)
        n = np.minimum(self.have[a], self.have[total - a])
        if total % 2 == 0:
            n[-1] //= 2
        at = int(n.argmax())
        return (int(a[at]), int(total - a[at])) if n[at] > 0 else None

    def _triple(self, total: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.have[: max(0, total - 1)])[::-1].tolist():
            if 3 * a < total:
                break
            self.have[a] -= 1
            rest = self._pair(total - a)
            self.have[a] += 1
            if rest:
                return (a, *rest)
        return None

    def pair(self, total: int) -> tuple[int, ...] | None:
        return self._entry(self.pairs, total, self._pair)

    def triple(self, total: int) -> tuple[int, ...] | None:
        return self._entry(self.triples, total, self._triple)

    def _entry(self, entries: dict, total: int, find) -> tuple[int, ...] | None:
        if total not in entries or (entries[total] and not self.left(entries[total])):
            entries[total] = find(total)
        return entries[total]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(lengths of a sequence, how many such sequences), using every piece exactly once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[Counter, int]] = []
    index = Complements(have)

    # From the longest length down: pieces of it that one, two or three others complete, as often as counts allow.
    for length in range(capacity, 0, -1):
        gap = capacity - length
        while have[length]:  # each step exhausts a length
            found = None
            for parts in [()] if not gap else (index.single(gap), index.pair(gap), index.triple(gap)):
                if parts is not None and index.left((length, *parts)):
                    found = Counter((length, *parts))
                    break
            if found is None:
                break
            n = min(int(have[x]) // k for x, k in found.items())
            for x, k in found.items():
                have[x] -= n * k
            out.append((found, n))

    # Best fit of the rest, many equal sequences at a time: open sequences by the gap they still have.
    gaps: dict[int, list[tuple[Counter, int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(have[length])
        while n:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                fits = capacity // length
                full, rest = divmod(n, fits)
                for k, m in ((fits, full), (rest, 1)):
                    if k and m:
                        gaps.setdefault(capacity - k * length, []).append((Counter({length: k}), m))
                break
            parts, m = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            if m > n:
                gaps.setdefault(gap, []).append((parts, m - n))
                m = n
            gaps.setdefault(gap - length, []).append((parts + Counter([length]), m))
            n -= m
    return out + [x for group in gaps.values() for x in group]


def slots(packing: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks for each length, sorted: from which rank on, in which sequences, how many in each, from which offset."""
    used: Counter = Counter()
    rows, base = [], 0
    for parts, n in packing:
        offset = 0
        for length in sorted(parts, reverse=True):
            k = parts[length]
            rows.append((length, used[length], base, k, offset))
            used[length] += n * k
            offset += k * length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) | table[:, 1], "rank": table[:, 1], "base": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


def pack(docs: DataFrame, path: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: its document, place in it, digest of its ids, sequence and offset there.

    A null text is empty and packs as its end token alone. Repeated rows are packed one by one; null ids are kept.
    An empty table gives no rows. Only id and text are read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    made = cut(pieces(docs, path, ranks, id_col, text_col, capacity, end_id))
    width = shuffle_width(spark)
    made = made.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width)).cast("int"))
    by_bucket = made.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    # At most `capacity` rows reach the driver.
    counts = {int(r["length"]): int(r["n"]) for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = slots(plan(counts, capacity))
    in_bucket = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("_r", F.row_number().over(in_bucket)).join(base, ["length", "_b"]).withColumn("_rank", F.col("_r") + F.col("_before") - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b.pop("_rank").to_numpy(np.int64)
            i = np.searchsorted(at["key"], (length << 44) | rank, "right") - 1
            rest = rank - at["rank"][i]
            yield b.assign(sequence_id=at["base"][i] + rest // at["each"][i], offset=at["offset"][i] + rest % at["each"][i] * length)

    out = ranked.select(F.col("doc_id").cast("string"), "piece", "start", "length", "ids_crc32", "_rank")
    out = out.mapInPandas(place, PIECES.format("string") + ", sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", id_col)
