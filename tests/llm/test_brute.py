"""Queries against brute-force statements of their contracts on the awkward table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from barsignals.llm import decontamination, repeats, simhash
from barsignals.llm.queries import QUERIES


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_secrets(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    kinds = (("assign", r"""(?:(?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
             ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    want = Counter()
    for doc, text in docs:
        spans = [(m.start(), order, name, m.end()) for order, (name, pattern, group, least) in enumerate(kinds)
                 for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        n = Counter(s[2] for s in spans)
        want[(doc, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))))] += 1
    out = QUERIES["op3_secret_scans"](spark, folder)
    assert rows(out, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert sum(k[1] + k[3] for k in want) > 0


def repeated_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[p:p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        cover = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - length + 1):
            if count[r[p:p + length]] > 1:
                cover[p:p + length] = True
        cover = cover[:len(r)]
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(r), int(cover.sum()), spans, sha(np.frombuffer(r, np.uint8)[~cover].tobytes())))
    return out


def test_suffix_array_dedup(spark, awkward):
    folder, docs = awkward
    want = Counter((d[0], *w) for d, w in zip(docs, repeated_bytes([d[1] for d in docs], 400)))
    assert rows(QUERIES["op4_suffix_array_dedup"](spark, folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("group, common", [(2, 1000), (2, 8), (256, 1)])
def test_hot_anchors_are_split_exactly(spark, group, common):
    """Many texts share a passage in different surroundings, a third are copies; groups beyond the limit are narrowed."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcd "), n))
    passage, other = word(90), word(55)
    texts = [word(int(rng.integers(0, 60))) + passage + word(int(rng.integers(0, 60))) for _ in range(40)]
    texts += [word(20) + other + passage[:30] for _ in range(9)] + [passage * 3, "ab" * 60, ""] + [word(30) + other] * 26
    p = repeats.RepeatParams(length=40, gram=20, group=group, common=common)
    docs = spark.createDataFrame([(k, t, xxhash.xxh64_intdigest(t) >> 2) for k, t in enumerate(texts)], "doc_id long, text string, th long")
    cover = repeats.covered(docs, p).collect()
    want = repeated_bytes(texts, 40)
    for k, t in enumerate(texts):
        marks = np.zeros(len(t), bool)
        for r in cover:
            if r["doc_id"] == k:
                marks[r["start"]:r["end"]] = True
        assert int(marks.sum()) == want[k][1], k


def test_interval_expansion_finds_repeated_windows():
    rng = np.random.default_rng(1)
    for _ in range(30):
        segments = [rng.integers(97, 99 + rng.integers(3), rng.integers(12, 60)).astype(np.uint8) for _ in range(6)]
        segments.append(np.concatenate([segments[0][3:], segments[1][:9]]))
        got = repeats.repeated_windows(segments, 12)
        count = Counter(s[k:k + 12].tobytes() for s in segments for k in range(len(s) - 11))
        assert [[count[s[k:k + 12].tobytes()] > 1 for k in range(len(s) - 11)] for s in segments] == [g.tolist() for g in got]


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", low(text))
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(values, radius=3):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(values))]


def test_simhash(spark, awkward):
    folder, docs = awkward
    fps = [plain_fingerprint(d[1]) for d in docs]
    root = classes_of(fps)
    least = {}
    for r, d in zip(root, docs):
        if d[0] is not None:
            least[r] = min(least.get(r, d[0]), d[0])
    want = Counter((d[0], format(f, "016x"), least.get(r)) for d, f, r in zip(docs, fps, root))
    assert rows(QUERIES["op5_simhash_near_dedup"](spark, folder), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("tile", [3, 1024])
def test_tiled_links_of_hot_blocks(spark, tile):
    rng = np.random.default_rng(2)
    center = int(rng.integers(1 << 62))
    values = [center ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 7))) for _ in range(150)]
    values = sorted({*values, *map(int, rng.integers(1 << 62, size=50)), 0, 1, 7, 15})
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, tile).collect()
    at = {v: k for k, v in enumerate(values)}
    root = list(range(len(values)))
    for e in edges:
        assert bin(e["u"] ^ e["v"]).count("1") <= 64
    changed = True
    while changed:
        changed = False
        for e in edges:
            a, b = root[at[e["u"]]], root[at[e["v"]]]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
                changed = True
    assert root == classes_of(values)


def test_decontamination(spark, awkward):
    import pyarrow.parquet as pq
    folder, docs = awkward
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    bench = pq.read_table(f"{folder}/benchmark.parquet").to_pylist()
    windows = {}
    for b in bench:
        w = word.findall(low(b["text"]))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("" if b["item_id"] is None else str(b["item_id"]))
    want = Counter()
    for d in docs:
        w, hit, items = word.findall(low(d[1])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k:k + n])]
        want[(d[0], len(w), len(hit), len(items), sha(",".join(sorted(items))), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(QUERIES["op6_benchmark_decontamination"](spark, folder), *names) == want
    small = decontamination.DecontaminationParams(block_chars=100)  # several blocks of the query set
    marked = decontamination.mark(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"),
                                  spark.read.parquet(f"{folder}/benchmark.parquet"), small)
    got = Counter((r["doc_id"], r["_n_words"], sum(r["_runs"][1::4]) - sum(r["_runs"][::4]), len(r["_items"])) for r in marked.collect())
    assert got == Counter({k[:4]: 0 for k in want}) + Counter([k[:4] for k in want.elements()])


def test_base_score_and_lattice(spark, awkward):
    from barsignals.llm.lattice import Vocabulary
    from barsignals.llm.lm_scoring import VOCABULARY, piece_model
    folder, docs = awkward
    tokens = [re.findall("[^\x20\x09-\x0d]+", low(d[1])) + ["\0end"] for d in docs]
    train = [d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 != 1 for d in docs]
    count = Counter(t for ts, use in zip(tokens, train) if use for t in ts)
    n, v = sum(count.values()), len(count)
    got = sorted(QUERIES["op9_lm_scoring"](spark, folder).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, len(tokens[k])))
    model, end = piece_model(VOCABULARY)
    vocabulary = Vocabulary.load(VOCABULARY)
    weight = {p: model.weights[i] for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]}
    assert math.isclose(math.exp(end) + sum(map(math.exp, weight.values())) + 256 * math.exp(model.byte_weights[0]), 1, rel_tol=1e-9)
    for k, r in zip(order, got):
        ts = tokens[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(t in count for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel_tol=1e-9)
        text = (docs[k][1] or "").replace("▁", " ")
        if len(text) > 3000:
            continue
        text = " " + text if text else ""
        alpha = [0.0] + [-math.inf] * len(text)
        for a, c in enumerate(text):
            for b in range(a + 1, min(len(text), a + 48) + 1):
                if text[a:b].encode() in weight:
                    alpha[b] = np.logaddexp(alpha[b], alpha[a] + weight[text[a:b].encode()])
            if c.encode() not in weight:
                alpha[a + 1] = np.logaddexp(alpha[a + 1], alpha[a] + len(c.encode()) * model.byte_weights[0])
        assert math.isclose(r["score"], (alpha[-1] + end) / math.log(10), rel_tol=1e-6)


def test_common_words_only_change_the_route(spark, awkward):
    from pyspark.sql import functions as F

    from barsignals.llm import lm_scoring
    folder, _ = awkward
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    few = lm_scoring.score(docs, F.lit(True), lm_scoring.ScoringParams(frequent=5)).toPandas()
    all_ = lm_scoring.score(docs, F.lit(True)).toPandas()
    by = ["doc_id", "n_tokens", "n_known"]
    a, b = few.sort_values(by), all_.sort_values(by)
    assert np.allclose(a["base_score"], b["base_score"], rtol=1e-12) and (a["n_known"].values == b["n_known"].values).all()


def test_edited_texts(spark, awkward):
    folder, docs = awkward
    got = QUERIES["op10_document_fingerprints"](spark, folder).collect()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    sure = {}  # ids whose next document is certain: no ties on either side
    ids = Counter(d[0] for d in docs)
    for k, d in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        if ids[d[0]] == 1 and ids[nxt[0]] == 1 and d[0] is not None:
            text, follow = d[1] or "", nxt[1] or ""
            cut = len(text) // 3
            sure[d[0]] = (len(text), sha(text[:len(text) - cut] + follow[:cut]))
    assert len(sure) > 50
    seen = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] in sure}
    assert seen == sure
    text = dict((d[0], d[1]) for d in docs)
    prints = {}
    for r in got:
        if ids[r["doc_id"]] == 1:
            prints.setdefault(text[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert max(map(len, prints.values())) == 1


def test_syncmers_are_chosen_by_their_own_words(spark):
    from barsignals.llm.syncmers import SyncmerParams, with_anchors
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(200)]
    p = SyncmerParams(k=5, s=2)
    texts = [" ".join(words), " ".join(words[50:150]), "x y " + " ".join(words[20:90])]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    a = {r["id"]: [(x["pos"], x["hash"]) for x in r["a"]] for r in with_anchors(df, "text", "a", p).collect()}
    assert [(q, h) for q, h in a[1]] == [(q - 50, h) for q, h in a[0] if 50 <= q <= 145]
    assert [x for x in a[2] if x[0] >= 2] == [(q - 18, h) for q, h in a[0] if 20 <= q <= 85]
    hs = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    assert len(hs) == 200 and 0.3 < len(a[0]) / 196 < 0.7


def test_aligned_anchors_give_the_shift(spark):
    from barsignals.llm.syncmers import aligned, with_anchors
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(120)]
    rows = [(1, " ".join(words), "in front " + " ".join(words)), (2, " ".join(words[40:]), " ".join(words)), (3, "a b c", "d e f")]
    df = spark.createDataFrame(rows, "id int, x string, y string")
    got = {r["id"]: r for r in aligned(with_anchors(with_anchors(df, "x", "a"), "y", "b"), "id", "a", "b").collect()}
    assert set(got) == {1, 2} and got[1]["shift"] == 2 and got[2]["shift"] == 40 and got[1]["agree"] > 30
