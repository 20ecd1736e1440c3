"""N-gram Jaccard join by chosen paths.

Documents with the same set of word shingles are one class and take part once. Each position of a class's signature
samples one shingle of its set (the one of least hash), so two sets sample the same with a probability that is their
similarity. A run walks a tree: at a node two positions are chosen by a hash of the path, and a set goes to the child
of each with the shingle it sampled there, so sets that share sampled shingles stay together. Nodes with few sets are
compared by brute force; larger ones are split for as long as that leaves fewer pairs to compare than they hold, and
runs are repeated until the recall meets its target. What cannot be split is a crowd of mostly similar sets: it is
compared in blocks, as each of its links must be counted anyway. A pair that meets in several leaves belongs to the
least of them; sketches rule out dissimilar pairs, and exact Jaccard of the shingle sets decides on the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_rows, broadcast_if, cut, mix64, shuffle_width, text_key, word_hashes

#: Positions of a signature.
POSITIONS = 64
_ODD = mix64(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_XOR = mix64(np.arange(1001, POSITIONS + 1001, dtype=np.uint64))
#: Class digests up to this count (about 20 bytes each) are broadcast to find their texts; beyond it both sides shuffle.
BROADCAST_ROWS = 300_000


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of all words together if there are fewer; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(n, len(words))
    out = words[: len(words) - size + 1]
    for k in range(1, size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes (len(sets) x POSITIONS, 32 bit) of sets that are not empty."""
    out = np.zeros((len(sets), POSITIONS), np.uint32)
    if sets:
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        for i in range(POSITIONS):
            out[:, i] = np.minimum.reduceat(((flat ^ _XOR[i]) * _ODD[i]) >> np.uint64(32), starts)
    return out


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair of this similarity has shared a leaf with the wanted probability, however deep its leaves
    are: p, the chance to stay together in a node, follows from that in its two children. Similarity is over a half.

    Runs begin at positions of their own but go on over the same signature, so that this holds for independent runs is
    measured, not proved."""
    p = 1.0
    for _ in range(1000):
        p = 1 - (1 - similarity * p) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def children(node: np.ndarray, signature: np.ndarray, first: tuple[int, int] | None = None) -> np.ndarray:
    """The two children (n x 2) of each row's node; the positions follow from the node, or are given for the root."""
    if first is None:
        a = (mix64(node) % np.uint64(POSITIONS)).astype(np.int64)
        b = (a + 1 + (mix64(node ^ np.uint64(0x5555)) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
    else:
        a, b = (np.full(len(node), x, np.int64) for x in first)
    rows = np.arange(len(node))
    return np.stack([mix64(node * np.uint64(0x9E3779B97F4A7C15) ^ mix64((p.astype(np.uint64) << np.uint64(32)) | signature[rows, p])) for p in (a, b)], 1)


#: How often a node's positions are chosen anew before its sets count as a crowd: a position of its own path splits none.
TRIES = 3


def _salted(node: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """Nodes by which other positions are chosen."""
    return np.where(tries > 0, mix64(node ^ (tries.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), node)


def _matrix(column: pd.Series, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, width)


def _lists(column: pd.Series) -> np.ndarray:
    """Lists of 64 bit keys as rows of a matrix, padded with zeros."""
    parts = [np.frombuffer(x, "<u8") for x in column]
    out = np.zeros((len(parts), max(map(len, parts), default=0)), np.uint64)
    for i, x in enumerate(parts):
        out[i, : len(x)] = x
    return out


def candidates(bucket: np.ndarray, leaf: np.ndarray, block: np.ndarray, crossing: np.ndarray, sketch: np.ndarray, keys: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by bucket) that agree in `least` sketch bytes and belong to their bucket's leaf.

    crossing: of a bucket of two blocks, only pairs across them count.
    """

    def checked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found_i, found_j = [], []
        for at in range(0, len(i), 50_000):
            x, y = i[at : at + 50_000], j[at : at + 50_000]
            ok = (sketch[x] == sketch[y]).sum(1) >= least
            ok &= ~crossing[x] | (block[x] != block[y])
            x, y = x[ok], y[ok]
            step = max(1, 8_000_000 // max(1, keys.shape[1] ** 2))
            for part in range(0, len(x), step):
                u, v = x[part : part + step], y[part : part + step]
                shared = (keys[u][:, :, None] == keys[v][:, None, :]).any(2) & (keys[u] != 0)
                own = np.where(shared, keys[u], np.uint64(np.iinfo(np.uint64).max)).min(1) == leaf[u]
                found_i.append(u[own])
                found_j.append(v[own])
        return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (x[:0], y[:0]) if len(i) else (i, j)

    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(edges, len(bucket)))
    for size in np.unique(sizes[sizes > 1]):
        begin = edges[sizes == size]
        if size <= 32:
            a, b = np.triu_indices(size, 1)
            per = max(1, 400_000 // len(a))
            for at in range(0, len(begin), per):
                base = begin[at : at + per, None]
                yield checked((base + a).ravel(), (base + b).ravel())
        else:
            for base in begin:
                for i in range(base, base + size - 1):
                    j = np.arange(i + 1, base + size)
                    # Most pairs fall out here, before any pair of rows is copied.
                    j = j[(sketch[i + 1 : base + size] == sketch[i]).sum(1) >= least]
                    if len(j):
                        yield checked(np.full(len(j), i), j)


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs have at least this Jaccard similarity, exactly."""
    out = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        if not len(part):
            continue
        mine = sets[i[part[0]]]
        theirs = [sets[k] for k in j[part]]
        sizes = np.array(list(map(len, theirs)))
        flat = np.concatenate(theirs)
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(np.append(0, sizes[:-1])))
        # In whole numbers of 1/1000, so that no rounding decides.
        out[part] = both * 1000 >= round(similarity * 1000) * (len(mine) + sizes - both)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge (u, v); root is the least node of its component.

    Alternates large and small stars until edges no longer change; every round is materialised in the shared folder.
    """
    edges = cut(edges.where("u <> v").select("u", "v").distinct())
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
        joined = down.join(least, "u")
        edges = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = now


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.99999, bucket: int = 200, block: int = 1000, worth: float = 0.9, local: int = 20_000, with_keys: bool = False) -> DataFrame:
    """One row per row of docs: class_id, the least id among documents linked to it directly or not; copy_of, the
    least id among those with its shingle set; n_links, the number of other documents with similarity or more to it.
    With with_keys also text_key, the digest of the text, and class_key, which tells classes apart if ids do not.

    Links are found with at least the wanted recall and none is false. Null and empty texts have no shingles: they are
    copies of each other and of nothing else. Null ids are kept, and are never a class id unless all of the class are
    null. Repeated rows count as copies. Texts of any length take part whole. An empty table gives no rows. Only id
    and text are read, whatever other columns are called.

    A node of over `bucket` classes is split unless its children would hold over `worth` times its pairs; below a node
    of at most `local` classes one task does it.
    """
    spark = docs.sparkSession
    runs = runs_for(recall, similarity)
    # A sketch of a pair at the threshold agrees in fewer bytes once in a million.
    least = math.floor(POSITIONS * similarity - 4.75 * math.sqrt(POSITIONS * similarity * (1 - similarity)))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                sets = [shingles(t, shingle) for t in part["text"]]
                some = [i for i, s in enumerate(sets) if len(s)]
                signature = np.full(len(sets), b"", object)
                for i, row in zip(some, signatures([sets[i] for i in some]), strict=True):
                    signature[i] = row.astype("<u4").tobytes()
                yield pd.DataFrame({"id": part["id"], "text_key": part["text_key"], "digest": [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() for s in sets], "signature": signature})

    kind = dict(docs.dtypes)[id_col]
    keyed = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("text_key"))
    with arrow_rows(spark, 1000):
        rows = cut(keyed.mapInPandas(signed, "id string, text_key binary, digest binary, signature binary").withColumn("id", F.col("id").cast(kind)))
    classes = cut(rows.groupBy("digest").agg(F.min("id").alias("copy_of"), F.count("*").alias("weight"), F.min("text_key").alias("text_key"), F.first("signature").alias("signature")))

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = _matrix(b["signature"], "<u4", POSITIONS)
                keys = np.concatenate([children(np.full(len(b), 977 + r, np.uint64), s, (2 * r % POSITIONS, (2 * r + 1) % POSITIONS)) for r in range(runs)], 1)
                yield pd.DataFrame({"digest": np.repeat(b["digest"].to_numpy(object), 2 * runs), "leaf": keys.ravel().view(np.int64)})

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                keys = children(_salted(b["leaf"].to_numpy(np.int64).view(np.uint64), b["tries"].to_numpy(np.int64)), _matrix(b["signature"], "<u4", POSITIONS))
                yield pd.DataFrame({"digest": np.repeat(b["digest"].to_numpy(object), 2), "node": np.repeat(b["leaf"].to_numpy(), 2), "leaf": keys.ravel().view(np.int64)})

    full = classes.where(F.length("signature") > 0).select("digest", "signature")
    def settle(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """The leaves below a node that one task can hold."""
        s, digest = _matrix(b["signature"], "<u4", POSITIONS), b["digest"].to_numpy(object)
        out, stack = [], [(int(b["leaf"].iloc[0]), np.arange(len(b)))]
        while stack:
            node, rows = stack.pop()
            parts = None
            for tries in range(TRIES if len(rows) > bucket else 0):
                keys = children(_salted(np.full(len(rows), node, np.int64).view(np.uint64), np.full(len(rows), tries)), s[rows])
                found, at, n = np.unique(keys.ravel(), return_inverse=True, return_counts=True)
                if (n.astype(float) * (n - 1)).sum() <= worth * len(rows) * (len(rows) - 1):
                    # A class goes to a child once, even if both its positions lead there.
                    pair = np.unique(at * np.int64(len(rows)) + np.repeat(np.arange(len(rows)), 2))
                    parts = np.split(pair, np.flatnonzero(np.diff(pair // len(rows))) + 1)
                    stack += [(int(found[c[0] // len(rows)].view(np.int64)), rows[c % len(rows)]) for c in parts if len(c) > 1]
                    break
            if parts is not None:
                continue
            out.append(pd.DataFrame({"digest": digest[rows], "leaf": np.int64(node), "n": np.int64(len(rows))}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["digest", "leaf", "n"])

    nodes = cut(full.mapInPandas(roots, "digest binary, leaf long").distinct())
    counts = cut(nodes.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").withColumn("tries", F.lit(0)))
    leaves = nodes.join(counts.where(F.col("n") <= bucket), "leaf").select("digest", "leaf", "n")
    while True:
        medium = nodes.join(counts.where((F.col("n") > bucket) & (F.col("n") <= local)).select("leaf"), "leaf").join(full, "digest")
        leaves = leaves.unionAll(medium.groupBy("leaf").applyInPandas(settle, "digest binary, leaf long, n long"))
        large = counts.where(F.col("n") > local)
        if not large.take(1):
            break
        # Nodes beyond one task are split a level at a time.
        nodes = cut(nodes.join(large, "leaf"))
        split = cut(nodes.join(full, "digest").mapInPandas(deeper, "digest binary, node long, leaf long").distinct())
        below = cut(split.groupBy("node", "leaf").agg(F.count("*").alias("n")).where("n > 1"))
        pairs = below.groupBy(F.col("node").alias("leaf")).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("below"))
        crowd = F.coalesce("below", F.lit(0.0)) > worth * F.col("n") * (F.col("n") - 1)
        judged = cut(large.join(pairs, "leaf", "left").withColumn("crowd", crowd).drop("below"))
        again = judged.where(F.col("crowd") & (F.col("tries") < TRIES - 1)).select("leaf", "n", (F.col("tries") + 1).alias("tries"))
        stay = nodes.join(judged.where(F.col("crowd") & (F.col("tries") == TRIES - 1)), "leaf", "left_semi").select("digest", "leaf", "n")
        fresh = below.join(judged.where(~F.col("crowd")).select(F.col("leaf").alias("node")), "node", "left_semi").select("leaf", "n", F.lit(0).alias("tries"))
        nodes = split.select("digest", "leaf").unionAll(nodes.join(again, "leaf", "left_semi").select("digest", "leaf"))
        counts = cut(fresh.unionAll(again))
        leaves = cut(leaves.unionAll(stay).unionAll(nodes.join(counts.where(F.col("n") <= bucket), "leaf").select("digest", "leaf", "n")))
    leaves = cut(leaves)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Keys of a class as sorted unsigned numbers, and the low bytes of its signature as a sketch."""
        for b in batches:
            keys = [np.sort(np.asarray(x, np.int64).view(np.uint64)).astype("<u8").tobytes() for x in b["keys"]]
            sketch = [np.frombuffer(x, "<u4").astype(np.uint8).tobytes() for x in b["signature"]]
            yield pd.DataFrame({"digest": b["digest"], "keys": keys, "sketch": sketch})

    lists = leaves.groupBy("digest").agg(F.collect_set("leaf").alias("keys")).join(full, "digest")
    lists = lists.mapInPandas(packed, "digest binary, keys binary, sketch binary")
    # A leaf of more than `block` classes is compared by pairs of blocks, each a bucket of its own.
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("digest", "leaf", "block", (F.col("block") != F.col("other")).alias("two"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    placed = placed.withColumn("bucket", F.xxhash64("leaf", "low", "high")).join(lists, "digest")
    # Rows of the bucket of a block with itself and with others.
    placed = placed.withColumn("two", F.col("low") != F.col("high")).drop("low", "high")
    groups = max(shuffle_width(spark), leaves.count() // 20_000)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(groups)).cast("int"))

    def arrays(b: pd.DataFrame) -> tuple:
        return b["bucket"].to_numpy(np.int64), b["leaf"].to_numpy(np.int64).view(np.uint64), b["block"].to_numpy(), b["two"].to_numpy(bool), _matrix(b["sketch"], np.uint8, POSITIONS), _lists(b["keys"])

    def wanted(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["bucket", "digest"], ignore_index=True)
        used = np.zeros(len(b), bool)
        for i, j in candidates(*arrays(b), least):
            used[i] = used[j] = True
        return b[used]

    schema = "digest binary, leaf long, block int, two boolean, bucket long, keys binary, sketch binary, part int"
    needed = cut(placed.groupBy("part").applyInPandas(wanted, schema))
    keys_of = needed.select("digest").distinct().join(classes.select("digest", "text_key", "weight"), "digest")
    keys_of = cut(keys_of)
    texts = keyed.select("text_key", "text").join(broadcast_if(keys_of.select("text_key"), BROADCAST_ROWS), "text_key", "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text")).join(keys_of, "text_key").select("digest", "weight", "text")

    def linked(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["bucket", "digest"], ignore_index=True)
        made: dict[bytes, np.ndarray] = {}
        sets = [made[d] if d in made else made.setdefault(d, shingles(t, shingle)) for d, t in zip(b["digest"], b["text"], strict=True)]
        weight, degree, parent = b["weight"].to_numpy(np.int64), np.zeros(len(b), np.int64), list(range(len(b)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in candidates(*arrays(b), least):
            ok = similar(sets, i, j, similarity) if len(i) else np.zeros(0, bool)
            i, j = i[ok], j[ok]
            np.add.at(degree, i, weight[j])
            np.add.at(degree, j, weight[i])
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        digest = b["digest"].to_numpy(object)
        root = np.array([find(x) for x in range(len(b))], np.int64)
        some = degree > 0
        return pd.DataFrame({"digest": digest[some], "root": digest[root[some]], "degree": degree[some]})

    links = cut(needed.join(texts, "digest").groupBy("part").applyInPandas(linked, "digest binary, root binary, degree long"))
    degrees = links.groupBy("digest").agg(F.sum("degree").alias("degree"))
    roots_of = components(links.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    known = classes.select("digest", "copy_of", "weight").join(degrees, "digest", "left").join(roots_of.withColumnRenamed("node", "digest"), "digest", "left")
    known = known.select("digest", "copy_of", (F.col("weight") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("root", "digest").alias("root"))
    known = cut(known)
    heads = cut(known.groupBy("root").agg(F.min("copy_of").alias("class_id")))
    known = cut(known.join(heads, "root").select("digest", "copy_of", "n_links", "class_id", F.col("root").alias("class_key")))
    found = rows.select(F.col("id").alias(id_col), "digest", "text_key").join(known, "digest")
    return found.select(id_col, "class_id", "copy_of", "n_links", *(["text_key", "class_key"] if with_keys else []))
