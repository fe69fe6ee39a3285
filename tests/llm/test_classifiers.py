"""The classifiers' queries against plain loops over the model that they trained, on every row."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from barsignals.llm import lang_id, quality, toxicity
from barsignals.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def run(spark, monkeypatch, module, name, folder):
    """(model, rows) of a query."""
    kept, train = [], module.train
    monkeypatch.setattr(module, "train", lambda *a, **k: kept.append(train(*a, **k)) or kept[0])
    got = QUERIES[name](spark, folder).collect()
    return kept[0], got


def table(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def in_fold(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def same(got, want):
    """Multisets of rows; numbers to 1e-5."""
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r[:1]) + tuple(map(str, r[1:-1])) + (r[-1],)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert np.allclose([r[-1] for r in got], [r[-1] for r in want], rtol=0, atol=1e-5)


def letters(text):
    raw = (text or "").encode()
    return bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in raw)


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_language(m, text):
    low, p = letters(text), m.params
    total, n = [0.0] * len(m.languages), 0
    for order in p.orders:
        for g, times in Counter(low[k:k + order] for k in range(len(low) - order + 1)).items():
            if g == b"  " or (order > 2 and 32 in g[1:-1]):
                continue
            h = (int.from_bytes(g, "big") + order * 0x9E3779B1) % (1 << 32)
            h = (h ^ h >> 15) * 0x85EBCA77 % (1 << 32)
            h = (h ^ h >> 13) * 0xC2B2AE3D % (1 << 32)
            total = [t + times * float(x) for t, x in zip(total, m.logits[h >> 32 - p.bits])]
            n += times
    prob = softmax([(t / max(n, 1) + float(b)) / m.temperature for t, b in zip(total, m.bias)])
    return m.languages[prob.index(max(prob))], max(prob)


def has_letter(text):
    return any(c.isalpha() for c in text or "")


@pytest.mark.parametrize("given", [False, True])
def test_language(spark, awkward, monkeypatch, given):
    folder = SF if given else awkward[0]
    m, got = run(spark, monkeypatch, lang_id, "op1_language_id", folder)
    want = []
    for d, t in table(spark, folder):
        name, score = plain_language(m, t) if has_letter(t) else ("und", 0.0)
        want.append((d, in_fold(d, 4, 2), name, score < m.threshold if has_letter(t) else True, score))
    same([(r["doc_id"], r["held_out"], r["lang_pred"], r["rejected"], r["score"]) for r in got], want)


def plain_shape(b):
    c = chr(b)
    if b >= 128 or "a" <= c <= "z":
        return 1
    if "A" <= c <= "Z":
        return 2
    if "0" <= c <= "9":
        return 3
    if c in " \t":
        return 4
    if c in "\r\n":
        return 5
    marks = [k for k in range(33, 127) if not chr(k).isalnum()]
    return 6 + marks.index(b) if b in marks else 0


def plain_quality(m, text):
    raw, p = (text or "").encode(), m.params
    size, shapes = len(raw), [plain_shape(b) for b in raw]
    x = defaultdict(float, Counter(shapes))
    at = quality.N_SHAPES
    for order in p.orders:
        for k in range(size - order + 1):
            g = 0
            for s in shapes[k:k + order]:
                g = g * 64 + s
            x[at + ((g + order) * 0x9E3779B1 % (1 << 32) >> 32 - p.bits)] += 1
        at += 1 << p.bits
    z = float(m.weights[-1]) + sum(math.sqrt(v / max(size, 1)) * m.weights[k] for k, v in x.items())
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))
    n = max(len(words), 1)
    shares = [sum(a == b for a, b in zip(words, words[1:])) / n]
    for k in (1, 2, 4):
        grams = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
        shares.append(1 - len(set(grams)) / len(grams) if grams else 0.0)
    shares += [min(size / n, 40) / 10, math.log1p(size) / 10]
    z += sum(s * w for s, w in zip(shares, m.weights[at:-1]))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


@pytest.mark.parametrize("given", [False, True])
def test_quality(spark, awkward, monkeypatch, given):
    folder = SF if given else awkward[0]
    m, got = run(spark, monkeypatch, quality, "op2_quality_classifier", folder)
    want = [(d, in_fold(d, 5, 0), plain_quality(m, t)) for d, t in table(spark, folder)]
    same([(r["doc_id"], r["held_out"], r["score"]) for r in got], want)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


class PlainKneserNey:
    """Both class models by the recursion's definition."""

    def __init__(self, m):
        self.p = m.params
        order = self.p.order
        self.counts = {int(k).to_bytes(order, "big"): (t, o) for k, t, o in zip(m.keys, m.toxic, m.ordinary)}
        self.left = [Counter(g[-k:] for g in {g[-k - 1:] for g in self.counts}) for k in range(order)]
        self.after = [defaultdict(list) for _ in range(order)]
        for k in range(1, order):
            for g, n in self.left[k].items():
                self.after[k][g[:-1]].append(n)
        self.context = defaultdict(list)
        for g, c in self.counts.items():
            self.context[g[:-1]].append(c)

    def shared(self, g):
        if not g:
            return 1 / 64
        n = self.after[len(g)][g[:-1]]
        return (max(self.left[len(g)][g] - self.p.discount, 0) + self.p.discount * len(n) * self.shared(g[1:])) / sum(n)

    def ratio(self, g):
        rows, logs = self.context.get(g[:-1], []), []
        if not rows:
            return 0.0
        base = self.shared(g[1:]) if g in self.counts else 1.0
        for c in (0, 1):
            total, types = sum(r[c] for r in rows), sum(r[c] > 0 for r in rows)
            own = max(self.counts.get(g, (0, 0))[c] - self.p.discount, 0)
            logs.append(math.log((own + self.p.discount * types * base) / total if total else base))
        return logs[0] - logs[1]


def plain_evidence(lm, text, memory):
    low, order = b" " + letters(text) + b" ", lm.p.order
    v = []
    for k in range(len(low) - order + 1):
        g = low[k:k + order]
        if g not in memory:
            memory[g] = lm.ratio(g)
        v.append(memory[g])
    run = np.concatenate([[0.0], np.cumsum(v)])
    best = [max((run[min(k + w, len(v))] - run[k]) / w for k in range(len(v))) if v else 0.0 for w in lm.p.windows]
    return [sum(v) / max(len(v), 1), *best, math.log1p(len((text or "").encode())) / 10]


@pytest.mark.parametrize("given", [False, True])
def test_toxicity(spark, awkward, monkeypatch, given):
    folder = SF if given else awkward[0]
    m, got = run(spark, monkeypatch, toxicity, "op7_toxicity", folder)
    lm, memory, want = PlainKneserNey(m), {}, []
    for d, t in table(spark, folder):
        z = float(np.dot(plain_evidence(lm, t, memory), m.curve[:-1]) + m.curve[-1])
        want.append((d, in_fold(d, 4, 2), 1 / (1 + math.exp(-max(-30, min(30, z))))))
    same([(r["doc_id"], r["held_out"], r["score"]) for r in got], want)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_toxicity_of_a_text_does_not_depend_on_its_neighbours(spark, awkward, monkeypatch):
    m, _ = run(spark, monkeypatch, toxicity, "op7_toxicity", awkward[0])
    f = m.scorer()
    texts = ["a", "", None, "in the", "stand of heres", "x" * 40] + [t for _, t in table(spark, awkward[0])[:20]]
    alone = [f(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(f(pa.array(texts, pa.string())), alone, rtol=0, atol=1e-9)
    assert np.allclose(f(pa.array(texts[::-1], pa.string()))[::-1], alone, rtol=0, atol=1e-9)


def test_texts_of_several_pieces(spark, awkward, monkeypatch):
    """2.5 MB: the whole text counts, with n-grams across the borders of pieces."""
    rng = np.random.default_rng(4)
    long = " ".join(t for _, t in table(spark, awkward[0]) if t)
    long = (long + " " + "".join(rng.choice(list("abcdefgh  .,\n"), 1000))) * (2_500_000 // len(long) + 1)
    m, _ = run(spark, monkeypatch, lang_id, "op1_language_id", awkward[0])
    best, prob = m.predict(pa.array(["x", long, None]))
    name, score = plain_language(m, long)
    assert m.languages[best[1]] == name and abs(prob[1] - score) < 1e-5
    m, _ = run(spark, monkeypatch, quality, "op2_quality_classifier", awkward[0])
    assert abs(m.score(pa.array(["x", long, None]))[1] - plain_quality(m, long)) < 1e-5
    m, _ = run(spark, monkeypatch, toxicity, "op7_toxicity", awkward[0])
    lm = toxicity.KneserNey(m.keys, m.toxic, m.ordinary, m.params)
    assert np.allclose(lm.evidence(pa.array(["x", long, None]), m.params.windows)[1], plain_evidence(PlainKneserNey(m), long, {}), atol=1e-6)
