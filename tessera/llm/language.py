"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes in both directions, labels every position, and a document's
probabilities are the mean over all its positions. Trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a window at prediction; windows cover every byte.
WINDOW = 128


@dataclass
class Network:
    """Parameters of both directions; `labels` are the learned languages."""

    labels: list[str]
    inputs: list[np.ndarray]  # per direction: 256 x 3H, rows of bytes; gates z, r and candidate
    gates: list[np.ndarray]  # H x 2H
    candidate: list[np.ndarray]  # H x H
    output: list[np.ndarray]  # H x L
    bias: np.ndarray  # L

    @property
    def hidden(self) -> int:
        return len(self.candidate[0])

    def all(self) -> list[np.ndarray]:
        return [*self.inputs, *self.gates, *self.candidate, *self.output, self.bias]


def fresh(labels: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *s, by=0.3: (rng.normal(size=s) * by).astype(np.float32)
    return Network(labels, [draw(256, 3 * hidden) for _ in "fb"], [draw(hidden, 2 * hidden) for _ in "fb"], [draw(hidden, hidden) for _ in "fb"], [draw(hidden, len(labels)) for _ in "fb"], np.zeros(len(labels), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _read(net: Network, way: int, data: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (T, N, H) of one direction for bytes (T, N), in the order of data; keep: what BPTT needs."""
    steps, n = data.shape
    size = net.hidden
    states, kept = np.empty((steps, n, size), np.float32), []
    h = np.zeros((n, size), np.float32)
    table, gates, candidate = net.inputs[way], net.gates[way], net.candidate[way]
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        x = table[data[t]]
        zr = _sigmoid(x[:, : 2 * size] + h @ gates)
        z, r = zr[:, :size], zr[:, size:]
        c = np.tanh(x[:, 2 * size :] + (r * h) @ candidate)
        if keep:
            kept.append((t, h, z, r, c))
        h = h + z * (c - h)
        states[t] = h
    return states, kept


def probabilities(net: Network, data: np.ndarray) -> np.ndarray:
    """Class probabilities of every position: (T, N, L) for bytes (T, N)."""
    x = _read(net, 0, data, False)[0] @ net.output[0]
    x += _read(net, 1, data, False)[0] @ net.output[1]
    x += net.bias
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions of bytes x (T, N) with labels y (N), and its gradient for each of net.all(),
    by backpropagation through time."""
    window, n = x.shape
    hidden = net.hidden
    read = [_read(net, way, x, True) for way in (0, 1)]
    p = read[0][0] @ net.output[0] + read[1][0] @ net.output[1] + net.bias
    p = np.exp(p - p.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    loss = -float(np.log(p[:, np.arange(n), y] + 1e-12).mean())
    p[:, np.arange(n), y] -= 1
    p /= np.float32(n * window)
    grads: list[list[np.ndarray]] = [[], [], [], []]
    for way in (0, 1):
        states, kept = read[way]
        d_out = np.einsum("tnh,tnl->hl", states, p)
        d_in, d_gates, d_cand = np.zeros_like(net.inputs[way]), np.zeros_like(net.gates[way]), np.zeros_like(net.candidate[way])
        above, carry = p @ net.output[way].T, np.zeros((n, hidden), np.float32)
        for t, h, z, r, c in reversed(kept):
            dh = carry + above[t]
            dc = dh * z * (1 - c * c)
            d_reset = dc @ net.candidate[way].T
            dzr = np.concatenate([dh * (c - h) * z * (1 - z), d_reset * h * r * (1 - r)], 1)
            carry = dh * (1 - z) + d_reset * r + dzr @ net.gates[way].T
            d_gates += h.T @ dzr
            d_cand += (r * h).T @ dc
            np.add.at(d_in, x[t], np.concatenate([dzr, dc], 1))
        for g, d in zip(grads, (d_in, d_gates, d_cand, d_out), strict=True):
            g.append(d)
    return loss, [*grads[0], *grads[1], *grads[2], *grads[3], p.sum((0, 1))]


def train(samples: list[tuple[bytes, int]], labels: list[str], hidden: int = 8, window: int = 64, steps: int = 260, batch: int = 256, rate: float = 0.03, seed: int = 7) -> Network:
    """Adam on the cross-entropy of every position, by backpropagation through time over windows."""
    net, rng = fresh(labels, hidden, seed), np.random.default_rng(seed)
    windows, targets = [], []
    for raw, y in samples:
        for at in range(0, max(1, len(raw) - window // 2), window):
            windows.append(np.frombuffer(raw[at : at + window].ljust(window, b" "), np.uint8))
            targets.append(y)
    data, targets = np.array(windows), np.array(targets)
    by_class = [np.flatnonzero(targets == k) for k in range(len(labels))]
    by_class = [x for x in by_class if len(x)]
    params = net.all()
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        take = np.concatenate([rng.choice(x, -(-batch // len(by_class))) for x in by_class])
        _, flat = gradients(net, data[take].T, targets[take])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, (w, g) in enumerate(zip(params, flat, strict=True)):
            mean[i] += 0.1 * (g - mean[i])
            square[i] += 0.01 * (g * g - square[i])
            w -= (now * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[str], windows: int = 2048) -> np.ndarray:
    """Mean position probabilities of each whole text; a row of zeros for a text without bytes. Memory is bounded by
    `windows`, however long a text is."""
    out = np.zeros((len(texts), len(net.labels)))
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    queue, owner, left = [], [], []

    def flush() -> None:
        if queue:
            data = np.stack(queue, 1)
            p = probabilities(net, data)
            p *= (np.arange(WINDOW)[:, None] < np.array(left)[None, :])[:, :, None]
            np.add.at(out, np.array(owner), p.sum(0, dtype=np.float64))
            queue.clear(), owner.clear(), left.clear()

    for i, data in enumerate(raw):
        for at in range(0, len(data), WINDOW):
            part = data[at : at + WINDOW]
            left.append(len(part))
            queue.append(part if len(part) == WINDOW else np.concatenate([part, np.full(WINDOW - len(part), 32, np.uint8)]))
            owner.append(i)
            if len(queue) == windows:
                flush()
    flush()
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=out, where=total > 0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 400, languages: int = 200, chars: int = 256, **options) -> Network | None:
    """Trains on a bounded sample: about rows_per_language distinct texts of each of the `languages` most frequent
    languages, chosen by hash, at most twice as many in all, and of each text two stretches of `chars` characters at
    places anywhere in it, chosen by hash as well; None if there is nothing to learn from."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    # At most `languages` rows reach the driver.
    counts = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(languages).collect()
    if not counts:
        return None
    share = docs.sparkSession.createDataFrame([(r["l"], min(1.0, rows_per_language / r["n"])) for r in counts], "l string, share double")
    unit = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(share), "l").withColumn("u", unit).where("u < share")  # at most `languages` rows
    place = lambda salt: F.pmod(F.xxhash64("t", F.lit(salt)), F.greatest(F.length("t") - chars + 1, F.lit(1))).cast("int") + 1
    stretch = lambda salt: F.substring(F.col("t"), place(salt), F.lit(chars))
    picked = picked.select("u", "i", "l", stretch(1).alias("a"), stretch(2).alias("b")).distinct()
    picked = picked.orderBy("u", "i", "l", "a", "b").limit(2 * rows_per_language * len(counts))
    labels = sorted(r["l"] for r in counts)
    samples = []
    for r in sorted(picked.collect(), key=lambda r: (r["i"], r["l"], r["a"])):
        samples += [(x.encode("utf-8", "surrogatepass"), labels.index(r["l"])) for x in (r["a"], r["b"]) if x]
    return train(samples, labels, **options) if samples else None


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to all columns of docs, replacing columns of these names; `und` with score 0 for null
    texts and texts without letters, and for all if nothing was learned."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            label, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
            for at in range(0, len(some), 512):
                part = some[at : at + 512]
                p = pooled(net, [texts.iloc[i] for i in part])
                label[part] = np.array(net.labels, object)[p.argmax(1)]
                score[part] = p.max(1)
            yield pd.DataFrame({"lang_pred": label, "score": np.clip(score, 0, 1)})

    return docs.withColumn("_p", run(F.coalesce(F.col(text_col), F.lit("")))).withColumn("lang_pred", F.col("_p.lang_pred")).withColumn("score", F.col("_p.score")).drop("_p")


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_fold: int = 0, **options) -> DataFrame:
    """id, held_out, lang_pred, score of every row. Learned from rows whose crc32(id as text) mod folds differs from
    held_fold and whose language is known; a null id is neither learned from nor held out. Repeated rows agree. Texts
    of any length are read whole. An empty table gives no rows. Only id, text and language are read."""
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    net = learn(docs.where(fold != held_fold), id_col, text_col, lang_col, **options)
    out = identify(docs.select(F.col(id_col), F.col(text_col)), net, text_col)
    return out.select(id_col, F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
