"""Suffix-array dedup: removes each byte covered by a `span`-byte string that also starts earlier in the corpus.

Every span of `span` bytes holds an anchor: a `core`-byte string whose hash is least in a window of span - core + 1
places, so equal spans hold the same anchor at the same offset. Documents are dealt by a hash into batches. A batch
sends its anchors, each with a digest of its context (the bytes of all spans that hold it) and first place, to buckets
of the hash space. Anchors that occur once are done, and where all contexts of an anchor are equal, all but the first
are copies. Only where contexts differ, one of each kind is sent on, and a suffix array over them decides which of
their spans are equal, and which of those is first. Copies meet once per batch, however many they are.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASE_INVERSE, mix64, powers, prefix_hash, shuffle_width, span_hash
from tessera.llm.suffix_array import suffix_array

_LAST = np.iinfo(np.int64).max


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


#: Places within a stretch of a text are kept in the low bits beside the high bits of a hash.
_PLACE = np.uint64((1 << 24) - 1)
_STRETCH = 1 << 23
#: Bytes of texts that are hashed in one go.
_BLOCK = 1 << 17


def anchors(prefix: np.ndarray, bounds: np.ndarray, span: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the core strings that are least, and of equals the first, in some window.

    prefix is that of several texts one after another, bounds where they begin and end; no window crosses from one
    to the next.
    """
    width = span - core + 1
    n = len(prefix) - core
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = prefix[core:] - prefix[:n]
    h *= powers(BASE_INVERSE, n)
    h *= np.uint64(0x9E3779B97F4A7C15)
    inside = np.ones(n - width + 1, bool)
    for end in bounds[1:-1].tolist():
        inside[max(0, end - span + 1) : end] = False
    found = []
    for begin in range(0, n - width + 1, _STRETCH):
        key = h[begin : begin + _STRETCH + width - 1] & ~_PLACE
        key |= np.arange(len(key), dtype=np.uint64)
        least = _slide(key, width, np.minimum)[inside[begin : begin + _STRETCH]] & _PLACE
        # The first of the least places never moves back as the window moves on.
        if len(least):
            found.append(least[np.flatnonzero(np.diff(least, prepend=_PLACE))].astype(np.int64) + begin)
    chosen = np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)
    # Least hashes are all small: mixed, they fill the hash space evenly.
    return chosen, mix64(h[chosen])


class _Batch:
    """A batch's documents, their anchors, and its distinct (anchor, context) entries in the order they are sent."""

    def __init__(self, ids: pd.Series, texts: pd.Series, span: int, core: int):
        self.span, self.core = span, core
        doc = np.array([_LAST if i is None or i != i else int(i) for i in ids], np.int64)
        #: Documents in the order of their ids; `source` has the row that each came from.
        self.source = np.argsort(doc, kind="stable")
        self.doc = doc[self.source]
        texts = texts.to_numpy(object)
        self.data = [np.frombuffer((texts[i] or "").encode("utf-8", "surrogatepass"), np.uint8) for i in self.source]
        parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        block, held = [], 0
        for k, data in enumerate(self.data):
            if len(data) >= span:
                block.append(k)
                held += len(data)
            if block and (held >= _BLOCK or k + 1 == len(self.data)):
                parts.append(self._entries(block))
                block, held = [], 0
        anchor, context, row, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((context, anchor))  # stable: members stay in the order of document and place
        self.anchor, self.context, self.row, self.place = anchor[order], context[order], row[order], place[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.context[1:] != self.context[:-1])
        self.entry = np.cumsum(new) - 1  # of each member
        self.first = np.flatnonzero(new)  # the member that comes first, of each entry
        self.copies = np.diff(np.append(self.first, len(order))) > 1

    def _entries(self, block: list[int]) -> tuple[np.ndarray, ...]:
        """(anchor, context, row, place) of some texts, hashed in one go."""
        span, core = self.span, self.core
        bounds = np.cumsum([0, *(len(self.data[k]) for k in block)])
        prefix = prefix_hash(np.concatenate([self.data[k] for k in block]))
        p, h = anchors(prefix, bounds, span, core)
        text = np.searchsorted(bounds, p, "right") - 1
        low, high = np.maximum(p - (span - core), bounds[text]), np.minimum(p + span, bounds[text + 1])
        context = mix64(span_hash(prefix, low, p) * np.uint64(0x9E3779B97F4A7C15) ^ span_hash(prefix, p, high))
        return h, context, np.array(block, np.int64)[text], p - bounds[text]

    def bounds(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in self.data], np.int64)
        place = self.place[member]
        return np.maximum(place - (self.span - self.core), 0), np.minimum(place + self.span, size[self.row[member]])


def _plane(x: np.ndarray, kind: str) -> bytes:
    """An array's byte planes, compressed."""
    return zlib.compress(x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def _unplane(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T.tobytes(), kind)


def _delta(x: np.ndarray) -> bytes:
    return _plane(np.diff(x, prepend=np.zeros(1, np.uint64)), "<u8")


def _undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplane(raw, "<u8"), dtype=np.uint64)


#: What a bucket answers for an entry.
ALONE, FIRST, COPY, OPEN = 0, 1, 2, 3


def verdicts(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray, place: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For entries of all batches: ALONE; FIRST, all others are copies of it; COPY of an earlier entry with the same
    context; or OPEN, first of its context among several of the anchor."""
    n = len(anchor)
    order = np.lexsort((place, doc, context, anchor))
    a, c = anchor[order], context[order]
    same_a = np.zeros(n, bool)
    same_a[1:] = a[1:] == a[:-1]
    same_c = same_a.copy()
    same_c[1:] &= c[1:] == c[:-1]
    group = np.cumsum(~same_a) - 1
    kinds = np.bincount(group, ~same_c)[group] if n else np.zeros(0)
    total = np.bincount(group, 1 + copies[order])[group] if n else np.zeros(0)
    # Ties in place are one document given twice: each is as first as the other.
    head = np.maximum.accumulate(np.where(~same_c, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    d, p = doc[order], place[order]
    first = ~same_c | ((d == d[head]) & (p == p[head]))
    out = np.where(~first, COPY, np.where(kinds > 1, OPEN, np.where(total > 1, FIRST, ALONE)))
    result = np.empty(n, np.uint8)
    result[order] = out
    return result


def _starts(text: np.ndarray, low: np.ndarray, high: np.ndarray, every: bool) -> np.ndarray:
    """Places where a symbol starts: a byte up to the space, unless `every` about half of them, chosen by the two bytes
    after it, so equal bytes give equal symbols. The two must lie in the same context."""
    at = np.flatnonzero(text[:-2] <= 32)
    if not every:
        at = at[(((text[at + 1] >> 1) ^ text[at + 2]) & 1) == 0]
    k = np.searchsorted(low, at, "right") - 1
    return at[at + 2 < high[k]]


def decide(context: list[bytes], left: np.ndarray, anchor: np.ndarray, doc: np.ndarray, place: np.ndarray, span: int, core: int) -> np.ndarray:
    """For distinct contexts of each anchor, the first of their kind: bit d is set if the span that starts d bytes
    before the anchor also starts earlier in another of the contexts."""
    if span - core >= 64:
        raise ValueError("span - core must be below 64")
    out = np.zeros(len(context), np.uint64)
    if not len(context):
        return out
    size = np.array([len(x) for x in context], np.int64)
    high = np.cumsum(size)
    low = high - size
    text = np.concatenate([np.frombuffer(b"".join(context), np.uint8), np.zeros(span, np.uint8)])
    # All spans of all contexts.
    count = np.maximum(size - span + 1, 0)
    owner = np.repeat(np.arange(len(context)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]
    # Symbols of about two words, or of one, or of a byte, for anchors one of whose spans would hold no symbol start.
    rest = np.ones(len(context), bool)
    for symbols in (_starts(text, low, high, False), _starts(text, low, high, True), None):
        if symbols is None:
            mine = rest
        else:
            nxt = np.searchsorted(symbols, start)
            gap = np.where(nxt < len(symbols), symbols[np.minimum(nxt, max(0, len(symbols) - 1))] - start if len(symbols) else span, span)
            mine = rest & ~np.isin(anchor, np.unique(anchor[owner[gap > span - 3]]))
        take = mine[owner]
        if take.any():
            _classes(text, low[mine], high[mine], np.arange(len(text)) if symbols is None else symbols, symbols is None, owner[take], start[take], low, left, doc, place, span, out)
        rest = rest & ~mine
    return out


def _classes(text, low, high, symbols, bytewise, owner, start, all_low, left, doc, place, span, out) -> None:
    """Sets the bits of spans that are equal to an earlier one, from the suffix array over the given contexts."""
    k = np.searchsorted(low, symbols, "right") - 1
    inside = (k >= 0) & (symbols < high[np.maximum(k, 0)])
    symbols, k = symbols[inside], k[inside]
    if bytewise:
        rank = text[symbols].astype(np.int64) + 1
    else:
        # A symbol's value is its bytes and the three that chose its end, so values sort as the bytes do.
        end = high[k]
        follow = np.append(symbols[1:], len(text))
        stop = np.minimum(np.minimum(follow + 3, end), len(text))
        raw = text.tobytes()
        values = [raw[a:b] for a, b in zip(symbols.tolist(), stop.tolist(), strict=True)]
        number = {v: i + 1 for i, v in enumerate(sorted(set(values)))}
        rank = np.array([number[v] for v in values], np.int64)
    # The sequence of all contexts, with the least value after each.
    ends = np.flatnonzero(np.append(k[1:] != k[:-1], True)) if len(k) else np.zeros(0, np.int64)
    spot = np.arange(len(k)) + np.searchsorted(ends, np.arange(len(k)))
    sequence = np.zeros(len(k) + len(ends), np.int64)
    sequence[spot] = rank
    back = np.full(len(sequence), -1, np.int64)
    back[spot] = np.arange(len(k))
    order = back[np.array(suffix_array(sequence.tolist()), np.int64)]
    order = order[order >= 0]
    # Common bytes of neighbours, up to span and to the ends of their contexts.
    common = np.zeros(len(order), np.int64)
    at, rest = symbols[order], high[k[order]] - symbols[order]
    step = np.arange(span)
    for i in range(1, len(order), 4_000):
        j = min(len(order), i + 4_000)
        rows = text[np.minimum(at[i - 1 : j, None] + step, len(text) - 1)]
        differs = rows[1:] != rows[:-1]
        same = np.where(differs.any(1), differs.argmax(1), span)
        common[i:j] = np.minimum(same, np.minimum(rest[i:j], rest[i - 1 : j - 1]))
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    b = np.searchsorted(symbols, start)  # the first symbol start of each span
    before = symbols[b] - start
    prefix = prefix_hash(text)
    d = left[owner] - (start - all_low[owner])  # bytes before the anchor
    began = place[owner] - d
    _, rank_doc = np.unique(doc[owner], return_inverse=True)
    by_gap = np.argsort(before, kind="stable")
    for part in np.split(by_gap, np.flatnonzero(np.diff(before[by_gap])) + 1):
        if not len(part):
            continue
        gap = int(before[part[0]])
        run = np.cumsum(common < span - gap)
        key = mix64(run[position[b[part]]].astype(np.uint64) ^ mix64(span_hash(prefix, start[part], start[part] + gap)))
        sort = np.lexsort((began[part], rank_doc[part], key))
        key, who = key[sort], part[sort]
        new = np.append(True, key[1:] != key[:-1])
        head = who[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
        later = (rank_doc[who] != rank_doc[head]) | (began[who] != began[head])
        np.bitwise_or.at(out, owner[who[later]], np.uint64(1) << d[who[later]].astype(np.uint64))


def _chunks(anchor: np.ndarray, size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of sorted entries of about `most` bytes that don't split an anchor."""
    out, begin, held = [], 0, 0
    edges = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], True)) + 1 if len(anchor) else []
    total = np.cumsum(size)
    for e in edges:
        held = total[e - 1] - (total[begin - 1] if begin else 0)
        if held >= most or e == len(anchor):
            out.append((begin, int(e)))
            begin = int(e)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 100, core: int = 50, batch_bytes: int = 4_000_000, chunk_bytes: int = 200_000, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: n_bytes, n_removed, n_spans, kept_sha256; with keep_text also text_key, the digest of the
    text, and kept, the remaining text without characters that lost some of their bytes.

    Ids are integers and order documents; a null id comes last. Null texts are empty, and texts under `span` bytes
    lose nothing. Rows that repeat id and text are one document and stay or go together; rows that share an id but not
    the text are compared by their places. An empty table gives no rows. Only id and text are read, whatever other
    columns are called. Texts are dealt by digests of id and text into batches of about `batch_bytes`; a longer text is
    a batch of its own, and the rows of one document, however often it is repeated, meet in one.

    Equal anchors with equal contexts are told by two digests of 64 bits each, which an accident meets less than once
    in 10**18 pairs of contexts of an anchor.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    batches = max(1, -(-size // batch_bytes))
    buckets = max(shuffle_width(spark), batches // 8)
    edges = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int"))

    def of(b: pd.DataFrame) -> _Batch:
        return _Batch(b["id"], b["text"], span, core)

    def codes(batch: _Batch, answers: pd.DataFrame) -> np.ndarray:
        mine = answers[answers["kind"] == 1].sort_values("bucket")
        return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(zlib.decompress(x), np.uint8) for x in mine["answer"])])

    def announce(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x = of(b)
        a = x.anchor[x.first]
        out = []
        for i, e in enumerate(np.split(np.arange(len(a)), np.searchsorted(a, edges))):
            if len(e):
                m = x.first[e]
                out.append((key[0], i, _delta(a[e]), x.context[m].astype("<u8").tobytes(), _plane(x.doc[x.row[m]], "<i8"), _plane(x.place[m], "<i8"), zlib.compress(x.copies[e].tobytes(), 1)))
        return pd.DataFrame(out, columns=["batch", "bucket", "anchor", "context", "doc", "place", "copies"])

    def compare(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        a = [_undelta(x) for x in b["anchor"]]
        context = np.concatenate([np.frombuffer(x, "<u8") for x in b["context"]])
        doc = np.concatenate([_unplane(x, "<i8") for x in b["doc"]])
        place = np.concatenate([_unplane(x, "<i8") for x in b["place"]])
        copies = np.concatenate([np.frombuffer(zlib.decompress(x), bool) for x in b["copies"]])
        out = verdicts(np.concatenate(a), context, doc, place, copies)
        parts = np.split(out, np.cumsum([len(x) for x in a])[:-1])
        return pd.DataFrame({"batch": b["batch"], "bucket": b["bucket"], "kind": 1, "answer": [zlib.compress(x.tobytes(), 1) for x in parts]})

    def show(key: tuple, b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["batch", "bucket", "anchor", "left", "size", "text", "doc", "place"]
        if not len(b) or not len(answers):
            return pd.DataFrame([], columns=columns)
        x = of(b)
        opened = np.flatnonzero(codes(x, answers) == OPEN)
        a = x.anchor[x.first[opened]]
        out = []
        for i, e in enumerate(np.split(opened, np.searchsorted(a, edges))):
            if len(e):
                m = x.first[e]
                low, high = x.bounds(m)
                text = b"".join(x.data[r][s:t].tobytes() for r, s, t in zip(x.row[m].tolist(), low.tolist(), high.tolist(), strict=True))
                out.append((key[0], i, _delta(x.anchor[m]), _plane(x.place[m] - low, "<i8"), _plane(high - low, "<i8"), zlib.compress(text, 1), _plane(x.doc[x.row[m]], "<i8"), _plane(x.place[m], "<i8")))
        return pd.DataFrame(out, columns=columns)

    def sort_out(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        a = [_undelta(x) for x in b["anchor"]]
        anchor = np.concatenate(a)
        left, size, doc, place = (np.concatenate([_unplane(x, "<i8") for x in b[c]]) for c in ("left", "size", "doc", "place"))
        text = b"".join(zlib.decompress(x) for x in b["text"])
        high = np.cumsum(size)
        order = np.argsort(anchor, kind="stable")
        bits = np.zeros(len(anchor), np.uint64)
        for i, j in _chunks(anchor[order], size[order], chunk_bytes):
            m = order[i:j]
            bits[m] = decide([text[h - s : h] for h, s in zip(high[m].tolist(), size[m].tolist(), strict=True)], left[m], anchor[m], doc[m], place[m], span, core)
        parts = np.split(bits, np.cumsum([len(x) for x in a])[:-1])
        return pd.DataFrame({"batch": b["batch"], "bucket": b["bucket"], "kind": 2, "answer": [_plane(x, "<u8") for x in parts]})

    def finish(key: tuple, b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        x = of(b)
        code = codes(x, answers)
        bits = np.zeros(len(code), np.uint64)
        opened = answers[answers["kind"] == 2].sort_values("bucket")
        if len(opened):
            bits[code == OPEN] = np.concatenate([_unplane(v, "<u8") for v in opened["answer"]])
        by_row = np.argsort(x.row, kind="stable")
        cuts = np.searchsorted(x.row[by_row], np.arange(len(b) + 1))
        member_first = np.zeros(len(x.row), bool)
        if len(x.first):
            head = x.first[x.entry]
            member_first = (x.doc[x.row] == x.doc[x.row[head]]) & (x.place == x.place[head])
        out = []
        for k, data in enumerate(x.data):
            m = by_row[cuts[k] : cuts[k + 1]]
            c = code[x.entry[m]] if len(m) else np.zeros(0, np.uint8)
            m, c = m[c != ALONE], c[c != ALONE]
            covered = None
            if len(m):
                change = np.zeros(len(data) + 1, np.int64)
                whole = m[(c == COPY) | ~member_first[m]]
                low = np.maximum(x.place[whole] - (span - core), 0)
                top = np.minimum(x.place[whole], len(data) - span)
                np.add.at(change, low, 1)
                np.add.at(change, top + span, -1)
                some = m[(c == OPEN) & member_first[m]]
                some = some[bits[x.entry[some]] != 0]
                if len(some):
                    on = (bits[x.entry[some]][:, None] >> np.arange(span - core + 1, dtype=np.uint64)) & np.uint64(1)
                    i, d = np.nonzero(on)
                    begin = x.place[some[i]] - d
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + span, -1)
                covered = np.cumsum(change[:-1]) > 0
            if covered is None or not covered.any():
                kept, removed, spans = data.tobytes(), 0, 0
            else:
                kept = data[~covered].tobytes()
                removed, spans = int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            out.append((b["id"].iloc[x.source[k]], len(data), removed, spans, hashlib.sha256(kept).hexdigest(), *([hashlib.md5(data.tobytes()).digest(), kept.decode("utf-8", "ignore")] if keep_text else [])))
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text_key", "kept"] if keep_text else [])]
        return pd.DataFrame(out, columns=names)

    answer = "batch int, bucket int, kind int, answer binary"
    told = dealt.groupBy("batch").applyInPandas(announce, "batch int, bucket int, anchor binary, context binary, doc binary, place binary, copies binary")
    first = told.groupBy("bucket").applyInPandas(compare, answer)
    by_batch = dealt.groupBy("batch")
    shown = by_batch.cogroup(first.groupBy("batch")).applyInPandas(show, "batch int, bucket int, anchor binary, left binary, size binary, text binary, doc binary, place binary")
    second = shown.groupBy("bucket").applyInPandas(sort_out, answer)
    result = by_batch.cogroup(first.unionAll(second).groupBy("batch")).applyInPandas(finish, "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text_key binary, kept string" if keep_text else ""))
    return result.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
