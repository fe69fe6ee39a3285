"""Tokenizer alignment against token-by-token loops over whole texts, and the merge path against a plain merge."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from barsignals.llm import alignment
from barsignals.llm.alignment import AlignParams, Aligner, aligned, diagonals, linked_counts, op12_tokenizer_alignment, overlaps, pair_counts


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    import tokenizers
    one = tokenizers.Tokenizer.from_file(alignment.BYTE_LEVEL)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    ranks[50256] = b"<|endoftext|>"
    return one, two, ranks


def plain(text, coders):
    """(a ids, b ids, links, groups as text) of one text by loops over whole-text encodings."""
    one, two, ranks = coders
    nothing = ([], [], [], "")
    if not text:
        return nothing
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    as_bytes = lambda t: bytes([int(t[3:5], 16)]) if len(t) == 6 and t.startswith("<0x") else t.replace("▁", " ").encode()
    ta, tb = [ranks[i] for i in a], [as_bytes(two.id_to_piece(i)) for i in b]
    if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
        return nothing
    spans = lambda ts: list(zip(np.cumsum([0] + [len(t) for t in ts[:-1]]).tolist(), np.cumsum([len(t) for t in ts]).tolist()))
    sa, sb = spans(ta), spans(tb)
    links, low = [], 0
    for i, (s, e) in enumerate(sa):
        while sb[low][1] <= s:
            low += 1
        j = low
        while j < len(sb) and sb[j][0] < e:
            links.append((a[i], b[j]))
            j += 1
    both = {e for _, e in sa} & {e for _, e in sb}
    groups, left, right = [], [], []
    ends = sorted([(e, 0, i) for i, (_, e) in zip(a, sa)] + [(e, 1, i) for i, (_, e) in zip(b, sb)])
    for k, (e, side, i) in enumerate(ends):
        (left, right)[side].append(str(i))
        if e in both and (k + 1 == len(ends) or ends[k + 1][0] > e):
            groups.append(",".join(left) + "|" + ",".join(right))
            left, right = [], []
    return a, b, links, ";".join(groups)


def expected(docs, coders):
    found = [plain(t, coders) for _, t in docs]
    count = Counter(p for x in found for p in set(x[2]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    return Counter((d, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for (d, _), (a, b, links, g) in zip(docs, found))


def result(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


ODD = ["<|endoftext|> and <s> </s><unk>", "a b c d 　e  f", "  two  leading", "tail ", "x\ty z\n\n w", "mark ▁ inside", "▁",
       "don't won't it's 'S", "é è ñ — « x » …", "日本語 テキスト の 例", "😀 😀😀 a😀 b", "a\x00b c\x1cd \x85 e", "    x ﻿ y", "1234 5 67,890.12 $%& (x) [y]",
       "x" * 5000, " " * 3000, "ab " * 2000, "<0x41> <0x0A>", "́combining é á b", "\r\n\r\nline \r x", "é", " ", "\n"]


def test_query_on_awkward_documents(spark, awkward, coders):
    folder, docs = awkward
    assert result(op12_tokenizer_alignment(spark, folder)) == expected([(d[0], d[1]) for d in docs], coders)


@pytest.mark.parametrize("p", [AlignParams(), AlignParams(work=3, held=4, frequent=5), AlignParams(work=1, frequent=0, batch=2)])
def test_odd_texts(spark, coders, p):
    """Whatever the pieces, the stretches remembered and the pairs sent to tasks: the same rows."""
    rng = random.Random(1)
    docs = list(enumerate(ODD)) + [(100 + k, "".join(rng.choice([" ", " ", "a", "the", "é", " ", "\n", "'s", "<s>", "日", " ", "x1", "."]) for _ in range(60)))
                                   for k in range(120)] + [(5, ODD[0]), (None, ODD[1]), (None, None), (7, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = aligned(df, p).cache()
    out = rows.join(linked_counts(rows, pair_counts(rows, p), p), "rid")
    assert result(out) == expected(docs, coders)


def test_given_documents(spark, coders):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op12_tokenizer_alignment(spark, folder)) == expected(docs, coders)


def test_empty_table(spark, empty):
    assert op12_tokenizer_alignment(spark, empty).count() == 0


def test_merge_path():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(2, 60))
        a = np.unique(np.append(rng.integers(1, n, int(rng.integers(0, n))), n))
        b = np.unique(np.append(rng.integers(1, n, int(rng.integers(0, n))), n))
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        work = int(rng.integers(1, 9))
        i, j = diagonals(a, b, work)
        assert (np.diff(i + j)[:-1] == work).all() and i[-1] == len(a) and j[-1] == len(b)
        assert [sum(s == 0 for _, s in merged[:d]) for d in (i + j)] == i.tolist()
        li, lj, gi, gj = overlaps(a, b, work)
        start = lambda v, k: v[k - 1] if k else 0
        want = [(p, q) for p in range(len(a)) for q in range(len(b)) if max(start(a, p), start(b, q)) < min(a[p], b[q])]
        assert list(zip(li.tolist(), lj.tolist())) == want
        assert a[gi].tolist() == b[gj].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_a_long_text_is_read_whole(spark, coders):
    """Over 2 MiB, with a stretch that has no safe cut for a long way."""
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(380_000)) + "\n" + "q" * 100_000 + " end"
    df = spark.createDataFrame([(1, text), (2, "end")], "doc_id long, text string")
    rows = aligned(df).cache()
    assert len(text.encode()) > 1 << 21
    assert result(rows.join(linked_counts(rows, pair_counts(rows)), "rid")) == expected([(1, text), (2, "end")], coders)


def test_cuts_are_safe():
    assert Aligner(AlignParams()).cuts
