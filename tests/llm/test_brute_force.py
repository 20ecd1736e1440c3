"""Operators that SQL cannot express against brute force, exact round trips or held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html_text, jaccard, language, lm_score, packing, passage_dedup, toxicity
from tessera.llm.queries import tokenizer_paths
from tessera.llm.suffix_array import suffix_array

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())


def edited(rng, words_, n):
    out = list(words_)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"q{rng.randrange(1000)}"
    return out


def test_jaccard_join(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [(900, None), (901, ""), (902, "one"), (903, "ONE")], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 4)):
            rows.append((n, " ".join(edited(rng, base, rng.randint(0, 2)))))
            n += 1
    base = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(150):  # a group larger than a bucket and a block
        rows.append((n, " ".join(edited(rng, base, 1))))
        n += 1
    sets = {}
    for i, t in rows:
        w = words(t)
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    ids = list(sets)
    parent, degree = {i: i for i in ids}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if (not x and not y) or both * 1000 >= 800 * (len(x) + len(y) - both) and both:
                degree[ids[a]] += 1
                degree[ids[b]] += 1
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for local in (20, 50, 20_000):  # all splits by levels, some, none
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(df, bucket=20, block=64, local=local).collect()}
        assert got == {i: (find(i), degree[i]) for i in ids}


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.9, 0.8) < jaccard.runs_for(0.99999, 0.8) == 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(values):
    assert suffix_array(values) == sorted(range(len(values)), key=lambda i: values[i:])


def removed(rows, span=100):
    """(bytes, removed, runs, digest) per document, span by span."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            if w in seen and seen[w] != (i, s):
                covered[s : s + span] = b"\1" * span
            else:
                seen.setdefault(w, (i, s))
        runs = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out[i] = (len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())
    return out


def test_passage_dedup(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 600))) for _ in range(12)]
    rows = []
    for i in range(60):
        t, u = rng.choice(base), rng.choice(base)
        x = list(t[: rng.randint(0, len(t))] + u[rng.randint(0, len(u)) :])
        for _ in range(rng.randint(0, 3)):
            if x:
                x[rng.randrange(len(x))] = rng.choice("xyz é")
        rows.append((i, "".join(x)))
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "b" + "a" * 300), (104, "ab" * 200), (105, "xyzé" * 80), (106, "xyzé" * 90 + "q"), (107, "日本語テキスト" * 30), (108, "本語テキスト日" * 30), (None, "a" * 120)]
    rows += [(200 + i, "Ha " * (40 + i) + "end.") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in passage_dedup.dedup(df, batch_bytes=3_000, chunk_bytes=3000).collect()}
    assert got == removed(rows)


def test_passage_dedup_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = passage_dedup.dedup(df, batch_bytes=80_000, keep_text=True).collect()
    wanted = removed(rows)
    for r in kept:
        assert tuple(r)[1:5] == wanted[r["doc_id"]]
        if r["n_removed"] == 0:
            assert r["kept"] == dict(rows)[r["doc_id"]]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(spark, order):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(60)
    df = spark.createDataFrame([tuple(r) for r in df.collect()] + [(10_001, None), (10_002, "one"), (None, "a b c")], "doc_id long, text string")
    rows = [(r["doc_id"], words(r["text"])) for r in df.collect()]
    counts = [Counter(tuple(w[i : i + n]) for _, w in rows for i in range(len(w) - n + 1)) for n in range(order + 1)]
    total = sum(len(w) for _, w in rows)
    wanted = {}
    for i, w in rows:
        own = [Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) for n in range(order + 1)]
        c = lambda g: counts[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        s = 0.0
        for j in range(len(w)):
            n = min(order, j + 1)
            while n > 1 and c(tuple(w[j - n + 1 : j + 1])) == 0:
                s += math.log(0.4)
                n -= 1
            g = tuple(w[j - n + 1 : j + 1])
            s += math.log(max(c(g), 0.5) / total) if n == 1 else math.log(c(g) / max(c(g[:-1]), 1))
        wanted[i] = s / len(w) if w else None
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, order=order, batch_bytes=40_000).collect()}
    assert got.keys() == wanted.keys()
    for i, x in wanted.items():
        assert got[i] is None if x is None else abs(got[i] - x) < 1e-9


def test_language_is_learned(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.language(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in out)
    assert right >= 0.97 * len(out) > 100


def test_backpropagation_matches_differences():
    """Gradients of every kind of parameter against central differences of the loss."""
    rng = np.random.default_rng(3)
    net = language.fresh(["a", "b", "c"], 4, 5)
    x, y = rng.integers(97, 101, (9, 6)).astype(np.uint8), rng.integers(0, 3, 6)
    _, grads = language.gradients(net, x, y)
    for w, g in zip(net.all(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = w[at], 1e-2
        w[at] = old + e
        above = language.gradients(net, x, y)[0]
        w[at] = old - e
        below = language.gradients(net, x, y)[0]
        w[at] = old
        assert abs((above - below) / (2 * e) - g[at]) <= 0.02 * abs(g[at]) + 1e-4


def test_toxicity_folding_and_exceptions():
    a = toxicity.Lexicon({"scum": 4.0, "idiot ": 4.0}).automaton()
    weigh = lambda t: toxicity.weigh(toxicity.fold(t), a)
    assert weigh("You ІD1ОT!") == 4.0  # Cyrillic letters and a digit
    assert weigh("scummy $cum") == 8.0
    assert weigh("idiotic discum") == 0.0
    assert weigh("the pond scum grows") == 0.0
    assert weigh("pond scum, scum") == 4.0
    assert weigh("") == 0.0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "abc", "b", "bc", "x", "abcd", "xx", "ab ", " "]), max_size=25))
def test_weigh_against_brute_force(parts):
    lexicon = toxicity.Lexicon({"ab": 1.0, "abc": 2.0, "bc ": 4.0, "x": 8.0}, exceptions=("abc x", "x ab"))
    folded = toxicity.fold("".join(parts) + " " + " ".join(parts))
    spared = [(m.start() + 1, m.end() - 1) for p in lexicon.exceptions for m in re.finditer(f"(?= {p} )", folded) for m in [re.compile(f" {p} ").match(folded, m.start())]]
    wanted = 0.0
    for at in range(1, len(folded)):
        if folded[at - 1] == " " and not any(a <= at < b for a, b in spared):
            fits = [s for s in lexicon.weights if folded.startswith(s, at)]
            wanted += lexicon.weights[max(fits, key=len)] if fits else 0.0
    assert toxicity.weigh(folded, lexicon.automaton()) == wanted


def test_weighing_takes_time_in_proportion():
    import time

    a = toxicity.Lexicon({"scum": 1.0}).automaton()
    begin = time.monotonic()
    assert toxicity.weigh(toxicity.fold("pond scum scum " * 200_000), a) == 200_000.0
    assert time.monotonic() - begin < 10


def test_toxicity_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in out if r["toxic"]], [r for r in out if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.sampled_from(["", "<|endoftext|>", " " * 40, "é" * 9]))
def test_tokens_of_both_libraries(text, more):
    vocabulary, ranks = tokenizer_paths()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    assert packing.encoder(vocabulary, ranks)(text + more) == t.encode(text + more, add_special_tokens=False).ids


def test_tokens_of_documents(spark):
    vocabulary, ranks = tokenizer_paths()
    from tokenizers import Tokenizer

    t, fast = Tokenizer.from_file(vocabulary), packing.encoder(vocabulary, ranks)
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    digests = {}
    for r in rows:
        ids = t.encode(r["text"], add_special_tokens=False).ids
        assert fast(r["text"]) == ids
        digests[r["doc_id"]] = [*ids, 2]
    for p in packing.pack(spark.read.parquet(f"{FOLDER}/documents.parquet"), vocabulary, ranks).collect():
        ids = np.array(digests[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(ids) == p["length"] and zlib.crc32(ids.tobytes()) == p["ids_crc32"]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 30), max_size=10))
def test_plan_uses_every_piece_once(counts):
    plan = packing.plan(counts, 16)
    used = Counter()
    for parts, n in plan:
        assert sum(x * k for x, k in parts.items()) <= 16
        for x, k in parts.items():
            used[x] += k * n
    assert used == Counter(counts)
    sequences, total = sum(n for _, n in plan), sum(x * n for x, n in counts.items())
    assert sequences >= -(-total // 16)


def fewest(pieces, capacity):
    """The least number of sequences, by trying every sequence that holds the largest piece left."""
    best = {(): 0}

    def solve(left):
        if left not in best:
            largest, rest, tried = left[-1], left[:-1], set()

            def fill(at, used, chosen):
                tried.add(tuple(chosen))
                for i in range(at, len(rest)):
                    if used + rest[i] <= capacity:
                        fill(i + 1, used + rest[i], [*chosen, i])

            fill(0, largest, [])
            best[left] = 1 + min(solve(tuple(x for i, x in enumerate(rest) if i not in c)) for c in tried)
        return best[left]

    return solve(tuple(sorted(pieces)))


def test_plan_against_exhaustive_packing():
    rng = random.Random(9)
    over = 0
    for _ in range(150):
        pieces = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        n = sum(k for _, k in packing.plan(Counter(pieces), 12))
        least = fewest(pieces, 12)
        assert least <= n <= least + 1
        over += n - least
    assert over <= 5


def test_complements_are_exact():
    rng = random.Random(2)
    have = np.array([0, *(rng.choice([0, 0, 1, 2]) for _ in range(20))])
    index = packing.Complements(have)
    for _ in range(60):
        total = rng.randint(1, 20)
        pieces = [x for x in range(1, 21) for _ in range(min(3, have[x]))]
        for n, find in ((2, index.pair), (3, index.triple)):
            found, exists = find(total), any(sum(c) == total for c in itertools.combinations(pieces, n))
            assert (found is not None and index.left(found)) == exists and (not found or (sum(found), len(found)) == (total, n))
        have[rng.randint(1, 20)] //= 2


def test_plan_is_close_to_the_bound():
    rng = random.Random(1)
    counts = Counter(min(1024, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000))
    n = sum(k for _, k in packing.plan(counts, 1024))
    assert n <= 1.01 * max(sum(x * k for x, k in counts.items()) / 1024, sum(k for x, k in counts.items() if x > 512))


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<div class='content'><h1>Title</h1><p>" + "long text " * 20 + "<p>Short.</div><div id=comments><p>" + "reader " * 40 + "</div>", ["Title", ("long text " * 20).strip(), "Short."]),
        ("<header><h1>Site</h1></header><main><article><header><h2>Head</h2></header><p>" + "word " * 40 + "</p><aside>" + "other " * 40 + "</aside><ul><li>a</li><li>b</li></ul></article></main><footer>" + "foot " * 40 + "</footer>", ["Head", ("word " * 40).strip(), "a", "b"]),
        ("<nav>" + "<a href=x>link text</a>" * 30 + "</nav><p>Too short</p>", []),
        ("<article><p>Tiny.</article>", ["Tiny."]),
        ("<article>x&lt;y &eacute;&nbsp;z<br>w<script>var a='</p>'</script><!-- <p>no --></article>", ["x<y é z w"]),
        ("<article><section class='legal-theory'><p>" + "law " * 20 + "</section><div class=search-algorithms>tree</div><div class='ad-slot left'>buy</div><div id=relatedPosts>more</div><p role=note>end</article>", [("law " * 20).strip(), "tree", "end"]),
        ("<div class=sidebar-theory><p>" + "prose " * 40 + "</div><div class='sidebar-left'><p>" + "side " * 40 + "</div>", [("prose " * 40).strip()]),
        ("<article><a title='x > y' class=\"open>x</a><p>1 < 2 &#0000065; &#99999999999;</p></article>", ["x", "1 < 2 A �"]),
        ("<body><div class=cookie-notice>" + "We use cookies " * 20 + "</div><article><p><b>" + "open " * 30 + "<br><p>end</article></body>", [("open " * 30).strip(), "end"]),
    ],
)
def test_main_text(page, wanted):
    assert html_text.main_text(page) == "\n".join(wanted)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp \"'=&;!-div", max_size=200))
def test_any_markup_is_read(page):
    assert "\n\n" not in html_text.main_text(page)


@pytest.mark.parametrize("part", ["<a", "<a ", '<a b="', "<![CDATA[", "<!--", "<div>", "<div>text ", "<b>", "<p>", "<td>a<tr>", "</p>", "&", "&#9", "<", "<script", "</script ", "<p class=ad-x ", "<title>x"])
def test_time_grows_with_length(part):
    """No markup, however broken, takes more than its share of time (a second or two a megabyte; ten are allowed)."""
    import time

    begin = time.monotonic()
    html_text.main_text(part * (1_000_000 // len(part)) + ">" + "<li>x</li>" * 10)
    assert time.monotonic() - begin < 10


def test_main_text_of_pages(spark):
    import html

    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(r["html"]) == "\n".join(x for x in blocks if x)


def test_pipeline(spark):
    """The whole pipeline against stage-wise brute force, learning apart: toxicity's own verdicts are taken as given."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    packed = c.run(spark, FOLDER).collect()
    clean = c.drop_toxic(spark, docs, FOLDER)
    assert clean.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    sets = {i: {tuple(words(t)[j : j + 5]) for j in range(max(1, len(words(t)) - 4))} for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i in sorted(sets):
        for j in {j for g in sets[i] for j in holders[g] if j > i}:
            both = len(sets[i] & sets[j])
            if both * 1000 >= 800 * len(sets[i] | sets[j]):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    rows = [(i, t) for i, t in rows if find(i) == i]
    left = []
    seen = {}
    for i, t in sorted(rows):
        b = t.encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                covered[s : s + 100] = b"\1" * 100
            else:
                seen[w] = i
        left.append((i, bytes(x for x, k in zip(b, covered, strict=True) if not k).decode("utf-8", "ignore")))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(x.lower() if x.isascii() else x for x in t))
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = split(r["text"])
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    from tokenizers import Tokenizer

    tokens, pieces = Tokenizer.from_file(tokenizer_paths()[0]), Counter()
    for i, t in left:
        w, hit = split(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            continue
        ids = np.array([*tokens.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at, step = 0, len(ids) % 1024 or 1024
        while at < len(ids):
            pieces[i, at, step, zlib.crc32(ids[at : at + step].tobytes())] += 1
            at, step = at + step, 1024
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces


def links_of(rows, similarity=0.8):
    """The other documents of at least this similarity, for each id divisible by 50, against all rows."""
    sets = {}
    for i, t in rows:
        w = words(t)
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    out = {}
    for i, s in sets.items():
        if i % 50 == 0 and s:
            both = Counter(j for g in s for j in holders[g])
            out[i] = sum(1 for j, n in both.items() if j != i and n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9)
    return out


def test_recall_with_production_parameters(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = links_of([(r["doc_id"], r["text"]) for r in df.collect()])
    got = {r["doc_id"]: r["n_links"] for r in jaccard.join(df).where("doc_id % 50 = 0").collect()}
    assert sum(wanted.values()) > 0
    assert sum(min(got[i], n) for i, n in wanted.items()) >= 0.999 * sum(wanted.values())
    assert all(got[i] <= n for i, n in wanted.items())


def test_pooled_probabilities_against_scalars():
    """Every gate of every position by plain arithmetic, windows and padding included."""
    net = language.fresh(["a", "b", "c"], 3, 11)

    def states(way, data):
        out, h = [None] * len(data), [0.0] * 3
        for t in range(len(data)) if way == 0 else reversed(range(len(data))):
            x = [float(v) for v in net.inputs[way][data[t]]]
            dot = lambda m, v, j: sum(v[i] * float(m[i, j]) for i in range(3))
            z, r = ([1 / (1 + math.exp(-(x[o + j] + dot(net.gates[way], h, o + j)))) for j in range(3)] for o in (0, 3))
            c = [math.tanh(x[6 + j] + dot(net.candidate[way], [a * b for a, b in zip(r, h, strict=True)], j)) for j in range(3)]
            h = [h[j] + z[j] * (c[j] - h[j]) for j in range(3)]
            out[t] = h
        return out

    texts = ["", "abc", "é" * 70, "the quick brown fox " * 20]
    got = language.pooled(net, texts, windows=2)
    for text, row in zip(texts, got, strict=True):
        raw, total = text.encode(), [0.0] * 3
        for at in range(0, len(raw), language.WINDOW):
            part = raw[at : at + language.WINDOW]
            padded = part.ljust(language.WINDOW, b" ")
            ahead, behind = states(0, padded), states(1, padded)
            for t in range(len(part)):
                logits = [float(net.bias[k]) + sum(ahead[t][j] * float(net.output[0][j, k]) + behind[t][j] * float(net.output[1][j, k]) for j in range(3)) for k in range(3)]
                e = [math.exp(v) for v in logits]
                total = [a + b / sum(e) for a, b in zip(total, e, strict=True)]
        wanted = [v / len(raw) for v in total] if raw else [0.0] * 3
        assert np.allclose(row, wanted, atol=1e-5)
