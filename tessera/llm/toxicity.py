"""Toxicity: a weighted lexicon of word stems matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and digits to letters and turns the rest into spaces; accents stay, as they tell
words apart. An entry is a word start, or a whole word if it ends in a space. Hits inside an exception phrase do not count; the sum of weights is normalised by the text's length.
The lexicon and its weights are learned from labelled rows, at most `toxic_rows` + `clean_rows` of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Letters of other scripts and digits that stand for Latin letters (fixed values).
LOOKALIKES = "а:a е:e о:o р:p с:c х:x у:y і:i ѕ:s ј:j һ:h ԁ:d ԛ:q ԝ:w к:k м:m т:t в:b н:h α:a ε:e ο:o ρ:p ι:i ν:v τ:t υ:u κ:k ı:i ł:l ø:o đ:d ß:s 0:o 1:i 3:e 4:a 5:s 7:t 8:b @:a $:s"
#: Phrases in which a listed word is harmless (fixed values).
EXCEPTIONS = ("pond scum", "trash can", "trash bin", "clown fish", "class clown", "white trash bag", "stupid mistake on my part")
#: Known words, used beside what labelled rows teach (fixed values).
DEFAULT_LEXICON = {w: 4.0 for w in ("idiot", "moron", "scum", "stupid", "loser", "worthless", "pathetic", "disgusting", "trash", "clown")}

_TABLE = {ord(a): b for a, b in (x.split(":") for x in LOOKALIKES.split())}
_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words between single spaces, with one at either end."""
    return " " + _GAP.sub(" ", text.lower().translate(_TABLE)).strip() + " "


def stems(folded: str, shortest: int = 4, longest: int = 10) -> set[str]:
    """What a lexicon entry can be: prefixes of each distinct word, and the whole word with a space."""
    out = set()
    for w in set(folded.split()):
        if not w.isdigit() and len(w) >= shortest:
            out.update(w[:n] for n in range(shortest, min(longest, len(w)) + 1))
            out.add(w + " ")
    return out


@dataclass(frozen=True)
class Lexicon:
    """Stem weights, exception phrases, and the logistic curve from weight per length to a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slope: float = 4.0
    smoothing: float = 50.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for stem, w in self.weights.items():
            a.add_word(" " + stem, (len(stem), w, False))
        for phrase in self.exceptions:
            p = fold(phrase).rstrip()
            a.add_word(p + " ", (len(p), 0.0, True))
        a.make_automaton()
        return a


def weigh(folded: str, automaton) -> float:
    """The weights of all hits, one (the longest) per word start, without those inside exception phrases."""
    hits: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, w, exception) in automaton.iter(folded):
        if exception:
            spared.append((end - size, end))
        else:
            start = end - size
            if start not in hits or hits[start][0] < size:
                hits[start] = (size, w)
    if not spared:
        return sum(w for _, w in hits.values())
    spared.sort()
    total, reach, k = 0.0, -1, 0
    for at in sorted(hits):
        while k < len(spared) and spared[k][0] <= at:
            reach = max(reach, spared[k][1])
            k += 1
        if at >= reach:
            total += hits[at][1]
    return total


def density(weight: float, n_words: int, smoothing: float) -> float:
    return math.log1p(100.0 * weight / (n_words + smoothing))


def _sketch(words: list[str]) -> int:
    """The least of five-word shingles by three hashes: near copies mostly agree on all, texts that only share a passage
    hardly ever do."""
    import zlib

    shingles = [zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))]
    least = [min((x ^ flip) * odd & 0xFFFFFFFF for x in shingles) for flip, odd in ((0, 1), (0x5BD1E995, 0x85EBCA6B), (0x27D4EB2F, 0xC2B2AE35))]
    return least[0] << 31 ^ least[1] << 13 ^ least[2]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = 3000, clean_rows: int = 9000) -> Lexicon:
    """A lexicon from at most toxic_rows + clean_rows labelled rows, chosen by the hash of their ids.

    Stems frequent in toxic and rare in clean rows are chosen greedily until every toxic row that can be explained is,
    twice over; near copies among the rows (equal sketches) count once, so that no copied text outvotes others. Without
    rows of either label the known words alone make the lexicon.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    pick = lambda y, n: ids.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = pick(1, toxic_rows).unionAll(pick(0, clean_rows))  # bounded by the two parameters

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = [fold(x) for x in b["t"]]
            yield pd.DataFrame({"y": b["_y"], "folded": t, "sketch": [_sketch(x.split()) for x in t]})

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), id_col).select("_y", "t")
    rows = rows.mapInPandas(folded, "y int, folded string, sketch long").groupBy("y", "sketch").agg(F.min("folded").alias("folded"))
    rows = cut(rows.repartition(16, "sketch"))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(DEFAULT_LEXICON)
    support = max(3, round(0.005 * n_toxic))

    def counted(wanted: frozenset | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n: Counter = Counter()
            for b in batches:
                for f in b["folded"]:
                    s = stems(f)
                    n.update(s if wanted is None else s & wanted)
            if n:
                yield pd.DataFrame({"stem": list(n), "n": list(n.values())})

        return run

    toxic, clean = rows.where("y = 1").select("folded"), rows.where("y = 0").select("folded")
    often = toxic.mapInPandas(counted(None), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    # Stems in at least 0.4 % of so many rows are bounded by their words.
    in_toxic = {r["stem"]: r["n"] for r in often.collect()}
    wanted = frozenset(in_toxic)
    in_clean = {r["stem"]: r["n"] for r in clean.mapInPandas(counted(wanted), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).collect()}
    weight = {s: math.log((a + 0.5) / (n_toxic + 1)) - math.log((in_clean.get(s, 0) + 0.5) / (n_clean + 1)) for s, a in in_toxic.items()}
    strong = frozenset(s for s, w in weight.items() if w >= 2.5 and in_clean.get(s, 0) <= 0.0005 * n_clean)

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"found": [sorted(stems(f) & strong) for f in b["folded"]]})

    found = [r["found"] for r in toxic.mapInPandas(shown, "found array<string>").collect()]
    where: dict[str, set[int]] = {}
    for i, stems_of in enumerate(found):
        for s in stems_of:
            where.setdefault(s, set()).add(i)
    need = np.full(len(found), 2)
    lexicon: dict[str, float] = {}
    while where:
        gain = {s: sum(1 for i in at if need[i] > 0) for s, at in where.items()}
        # A longer stem says more than its own prefix when both explain the same rows.
        best = max(gain, key=lambda s: (gain[s], -in_clean.get(s, 0), len(s), s))
        if gain[best] < support:
            break
        lexicon[best] = min(6.0, weight[best])
        for i in where.pop(best):
            need[i] -= 1
        where = {s: at for s, at in where.items() if gain[s] >= support and not s.startswith(best) and not best.startswith(s)}
    for word, w in DEFAULT_LEXICON.items():  # known words that the sample is too small to teach, unless it clears them
        if not any((word + " ").startswith(x) for x in lexicon) and in_clean.get(word + " ", 0) <= 0.002 * n_clean:
            lexicon[word + " "] = w
    return _calibrated(Lexicon(lexicon), rows)


def _calibrated(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Fits the logistic curve by Newton steps on the sample's densities, classes weighted alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lexicon.automaton()
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [density(weigh(f, a), f.count(" ") - 1, lexicon.smoothing) for f in b["folded"]]})

    sample = rows.mapInPandas(run, "y int, x double").toPandas().sort_values(["y", "x"])
    y, x = sample["y"].to_numpy(float), sample["x"].to_numpy(float)
    weights = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    theta, design, ridge = np.array([-2.0, 1.0]), np.stack([np.ones_like(x), x], 1), 1e-5

    def loss(t: np.ndarray) -> float:
        z = design @ t
        return float((weights * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * t @ t)

    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ theta))
        grad = design.T @ (weights * (p - y)) + ridge * theta
        hess = (design * (weights * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-9:
            step /= 2
        theta = theta - step
    return Lexicon(lexicon.weights, lexicon.exceptions, float(theta[0]), float(max(theta[1], 0.0)), lexicon.smoothing)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score of every whole text to all columns of docs; a null text is empty and gets the curve's floor."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for texts in batches:
            out = []
            for t in texts:
                f = fold(t or "")
                out.append(1 / (1 + math.exp(-(lexicon.bias + lexicon.slope * density(weigh(f, a), max(0, f.count(" ") - 1), lexicon.smoothing)))))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(score_col, scored(F.coalesce(F.col(text_col), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """All rows and columns of docs with held_out, score and predicted; columns of these names are replaced.

    Rows whose crc32(id as text) mod folds equals held_fold are held out of learning; a null id is never learned from
    and never held out. Repeated rows score alike. Null and empty texts get the least score. Texts of any length are
    read whole. An empty table gives no rows; without labels the known words decide.
    """
    fold_of = F.crc32(F.col(id_col).cast("string")) % folds
    lexicon = learn(docs, labels.where(fold_of != held_fold), id_col, text_col, label_col)
    out = score(docs, lexicon, text_col).withColumn("held_out", F.coalesce(fold_of == held_fold, F.lit(False)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
