"""LM scoring: stupid-backoff scores computed relationally.

Texts become n-grams of word hashes. A task deals its documents, as they come, into batches of about `batch_bytes`;
neither ids nor lengths decide where a document goes, so repeated rows and null ids make no batch larger than others.
A batch explodes into its distinct n-grams with their counts, which go to buckets of the hash space: the n-gram count
tables, partitioned by hash. A bucket adds the counts of all batches and answers each with the totals of the n-grams it
sent; the answers are joined to the n-grams of the batch's documents and summed per document. An n-gram travels once
per batch, not once per occurrence, so frequent n-grams weigh no more than rare ones. Keys travel as sorted
hashes, delta-coded and compressed, many to a row: one row for each n-gram would take several times the disk. Hashes are
`SPARE_BITS` longer than the number of n-grams needs, so at any size of the corpus fewer than one n-gram in a million
shares its key with another.

A document is scored leave-one-out: counts exclude its own occurrences. With c the remaining counts and N the number
of words of the corpus, a word w after v scores c(v w) / c(v) if c(v w) > 0, else alpha times its score after the
shorter context, down to c(w) / N, or 0.5 / N for words that no other document has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, mix64, release, shuffle_width, word_hashes

_NEXT = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a key beyond those that number all n-grams of the corpus, and the least bits of a key.
SPARE_BITS, LEAST_BITS = 20, 48
#: Bits of a word's hash.
WORD_BITS = 56


def _pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as compressed byte planes, no wider than the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _shrink(keys: np.ndarray) -> bytes:
    """Sorted 64 bit keys as compressed differences."""
    return _pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def _expand(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def key_bits(grams: int) -> int:
    """The length of keys for so many n-grams."""
    return min(64, max(LEAST_BITS, SPARE_BITS + grams.bit_length()))


def number(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary, words): words numbered by falling frequency, so that they pack well, and then by hash."""
    code, distinct = pd.factorize(hashes >> np.uint64(64 - WORD_BITS))
    order = np.lexsort((distinct, -np.bincount(code, minlength=len(distinct))))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[code]


def _shrink_vocabulary(vocabulary: np.ndarray) -> bytes:
    """Differences modulo 2**WORD_BITS: hashes rise within a frequency, and most words are of few."""
    return _pack(np.diff(vocabulary, prepend=np.zeros(1, np.uint64)) & np.uint64((1 << WORD_BITS) - 1))


def _expand_vocabulary(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64) & np.uint64((1 << WORD_BITS) - 1)


class Grams:
    """The n-grams of a batch for n = 1..order. Words are runs without white space, lower-cased; n-grams do not cross
    texts. `words` number the batch's vocabulary of word hashes, `sizes` are the words of each text."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, sizes: np.ndarray, order: int, bits: int):
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.start = [np.arange(len(words))]  # of each order: where its n-grams start
        self.code = [words]  # and the number of each among the distinct ones
        self.counts = [np.bincount(words, minlength=len(vocabulary))]
        hashes = vocabulary
        keys = [mix64(hashes ^ np.uint64(1))]
        for n in range(2, order + 1):
            inside = self.doc[self.start[-1][: len(self.doc)]] == self.doc[np.minimum(self.start[-1] + n - 1, len(self.doc) - 1)]
            inside &= self.start[-1] + n - 1 < len(self.doc)
            start = self.start[-1][inside]
            code, distinct = pd.factorize(self.code[-1][inside] * np.int64(max(1, len(vocabulary))) + words[start + n - 1])
            hashes = mix64(hashes[distinct // max(1, len(vocabulary))] * _NEXT + vocabulary[distinct % max(1, len(vocabulary))])
            keys.append(mix64(hashes ^ np.uint64(n)))
            self.start.append(start)
            self.code.append(code)
            self.counts.append(np.bincount(code, minlength=len(distinct)))
        keys = np.concatenate(keys) >> np.uint64(64 - bits)
        #: The distinct n-grams of all orders in the order of their keys.
        self.sorted = np.argsort(keys)
        self.keys = keys[self.sorted]

    def in_others(self, totals: np.ndarray) -> list[np.ndarray]:
        """For each order and place where an n-gram starts: its occurrences in other documents (0 where none fits).
        totals: the corpus counts of all distinct n-grams, in the order of their keys."""
        by_code = np.empty(len(totals), np.int64)
        by_code[self.sorted] = totals
        out, at = [], 0
        for start, code, counts in zip(self.start, self.code, self.counts, strict=True):
            total = by_code[at : at + len(counts)]
            at += len(counts)
            own = np.ones(len(code), np.int64)
            again = np.flatnonzero(counts[code] > 1)
            pair, _ = pd.factorize(self.doc[start[again]] * np.int64(max(1, len(counts))) + code[again])
            own[again] = np.bincount(pair)[pair] if len(pair) else 0
            left = np.zeros(len(self.doc), np.int64)
            left[start] = total[code] - own
            out.append(left)
        return out


def _scored(grams: Grams, totals: np.ndarray, n_docs: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: words scored by a shorter n-gram than the longest possible, words scored by a unigram, and the
    sum of logarithms, without that of N, which is added once for each word that a unigram scores."""
    others, doc = grams.in_others(totals), grams.doc
    logs = np.log(np.maximum(others[0], 0.5))
    by_unigram, backed = np.ones(len(doc), bool), np.zeros(len(doc), np.int64)
    for n in range(2, len(others) + 1):
        start = grams.start[n - 1]
        word, c = start + n - 1, others[n - 1][start]
        hit = c > 0
        miss = word[~hit]
        logs[miss] += np.log(alpha)
        backed[miss] = 1
        found = word[hit]
        logs[found] = np.log(c[hit] / np.maximum(others[n - 2][start[hit]], 1))
        by_unigram[found], backed[found] = False, 0
    return np.bincount(doc, backed, n_docs), np.bincount(doc, by_unigram, n_docs), np.bincount(doc, logs, n_docs)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, batch_bytes: int = 4_000_000) -> DataFrame:
    """One row per row of docs: n_words, n_backoff (words scored by a shorter n-gram than the longest possible) and
    score, the mean natural logarithm of the words' scores (null for a text without words, as for a null text).

    Repeated rows are documents of their own, so they are not left out of each other's counts; null ids are kept. An
    empty table gives no rows. A text of any length is one document of one batch, and a longer one than `batch_bytes`
    a batch of its own. Only id and text are read, whatever other columns are called; counts cover all rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 24
        ids: list[str | None] = []
        hashes: list[np.ndarray] = []
        held = 0

        def batch() -> pd.DataFrame:
            vocabulary, words = number(np.concatenate(hashes))
            sizes = np.array([len(x) for x in hashes], np.int64)
            return pd.DataFrame({"batch": [at], "ids": [list(ids)], "n": [len(words)], "sizes": [_pack(sizes)], "vocabulary": [_shrink_vocabulary(vocabulary)], "words": [_pack(words)]})

        for b in batches:
            for key, text in zip(b["id"], b["text"], strict=True):
                ids.append(key)
                hashes.append(word_hashes(text))
                held += len(text)
                if held >= batch_bytes:
                    yield batch()
                    ids.clear(), hashes.clear()
                    at, held = at + 1, 0
        if ids:
            yield batch()

    def grams(sizes: bytes, vocabulary: bytes, words: bytes) -> Grams:
        return Grams(_expand_vocabulary(vocabulary), _unpack(words).astype(np.int64), _unpack(sizes).astype(np.int64), order, bits)

    # Batches follow from how rows come, so they are written down before anything refers to them.
    dealt = cut(rows.mapInPandas(deal, "batch long, ids array<string>, n long, sizes binary, vocabulary binary, words binary"))
    size = dealt.agg(F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    bits = key_bits(size["words"] * order)
    buckets = max(shuffle_width(spark), size["batches"] // 4)
    edges = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**bits).astype(np.uint64)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for batch, sizes, vocabulary, words in zip(b["batch"], b["sizes"], b["vocabulary"], b["words"], strict=True):
                g = grams(sizes, vocabulary, words)
                counts = np.concatenate(g.counts)[g.sorted]
                parts = zip(np.split(g.keys, at := np.searchsorted(g.keys, edges)), np.split(counts, at), strict=True)
                yield pd.DataFrame([(batch, i, _shrink(k), _pack(n)) for i, (k, n) in enumerate(parts) if len(k)], columns=["batch", "bucket", "keys", "counts"])

    def add(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        lists = [_expand(x) for x in b.pop("keys")]
        code, distinct = pd.factorize(np.concatenate(lists))
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, code, np.concatenate([_unpack(x) for x in b.pop("counts")]).astype(np.int64))
        sent = np.split(total[code], np.cumsum([len(x) for x in lists])[:-1])
        return pd.DataFrame({"batch": b["batch"], "bucket": b["bucket"], "totals": [_pack(x) for x in sent]})

    def join(key: tuple, b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, sizes, vocabulary, words in zip(b["ids"], b["sizes"], b["vocabulary"], b["words"], strict=True):
            n_words = _unpack(sizes).astype(np.int64)
            totals = np.concatenate([np.zeros(0, np.uint64), *map(_unpack, answers.sort_values("bucket")["totals"])]).astype(np.int64)
            backed, by_unigram, logs = _scored(grams(sizes, vocabulary, words), totals, len(n_words), alpha)
            out.append(pd.DataFrame({"id": ids, "n_words": n_words, "n_backoff": backed.astype(np.int64), "n_unigram": by_unigram.astype(np.int64), "logs": logs}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["id", "n_words", "n_backoff", "n_unigram", "logs"])

    sent = dealt.select("batch", "sizes", "vocabulary", "words").mapInPandas(explode, "batch long, bucket int, keys binary, counts binary")
    # Written down, so that the tables of counts, the largest data here, are given up before the next shuffle.
    answered = cut(sent.groupBy("bucket").applyInPandas(add, "batch long, bucket int, totals binary"))
    del sent
    release(spark)
    scored = dealt.groupBy("batch").cogroup(answered.groupBy("batch")).applyInPandas(join, "id string, n_words long, n_backoff long, n_unigram long, logs double")
    value = (F.col("logs") - F.col("n_unigram") * float(np.log(size["words"] or 1))) / F.col("n_words")
    return scored.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_backoff", F.when(F.col("n_words") > 0, value).alias("score"))
