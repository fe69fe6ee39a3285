"""Writes small document tables for the tests."""

import pyarrow as pa
import pyarrow.parquet as pq

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def write(folder, docs, labels=(), bench=()):
    """documents, labels and benchmark tables; documents has extra columns with clashing names."""
    ids, texts, langs = ([d[k] for d in docs] for k in range(3)) if docs else ([], [], [])
    n = len(ids)
    table = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()),
             "source": pa.array([None if k % 5 == 0 else "src0" for k in range(n)], pa.string()),
             "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
    for name in ("score", "fp", "th", "label", "held_out", "_bucket", "word", "u", "key", "lo", "rid", "_runs", "doc", "next"):
        table[name] = pa.array([float(k) for k in range(n)], pa.float64())
    pq.write_table(pa.table(table), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()),
                             "quality": pa.array([x[1] for x in labels], pa.int32()),
                             "toxic": pa.array([x[2] for x in labels], pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([x[0] for x in bench], pa.int64()),
                             "text": pa.array([x[1] for x in bench], pa.string())}), f"{folder}/benchmark.parquet")
    return str(folder)
