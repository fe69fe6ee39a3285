"""Small document tables with every awkward row: NULLs, empty and long texts, repeats, odd columns."""

import random

import pytest

from tables import prose, write


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    """(folder, rows): 70 documents."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 300)) for _ in range(30)]
    bench = [(k, prose(rng, n)) for k, n in enumerate((40, 30, 13, 12, 5, 1))] + [(6, None), (7, ""), (8, " ;- "), (None, prose(rng, 20))]
    shared = prose(rng, 120)
    docs = [(k, t, ("en", "de", None)[k % 3]) for k, t in enumerate(base)]
    docs += [(30 + k, t, "en") for k, t in enumerate(base[:5])]  # exact copies
    docs += [(40 + k, t + " " + prose(rng, 1), "de") for k, t in enumerate(base[5:10])]  # near copies
    docs += [(50 + k, prose(rng, 40) + " " + shared + " " + prose(rng, 30 + k), "en") for k in range(8)]  # a shared passage
    docs += [(60, bench[0][1], "en"), (61, prose(rng, 9) + ". " + bench[1][1].upper() + "! " + prose(rng, 10), "en"),
             (62, prose(rng, 400) + " " + bench[2][1] + " " + prose(rng, 400), "de"), (63, bench[4][1], "de")]
    docs += [(70, None, None), (71, "", "en"), (72, "  \n\t ", "de"), (73, "a", None), (74, "😀 ünï ▁ côté\r\n\x0b x", "fr"),
             (75, "x" * 3000, None), (76, (prose(rng, 3) + " ") * 300, "en"), (77, prose(rng, 60_000), "de"),
             (None, base[0], "en"), (None, None, None), (78, "only", "en"), (78, "only", "en"), (79, base[11], "en"), (79, base[12], "de")]
    labels = [(d[0], k % 2, (k // 2) % 2) for k, d in enumerate(docs[:60])] + [(0, 1, 1), (None, 1, 1), (3, None, None), (999, 1, 0)]
    folder = tmp_path_factory.mktemp("awkward")
    return write(folder, docs, labels, bench), docs


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [])
