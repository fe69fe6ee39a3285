"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary file gives pieces and log scores; the best segmentation is the one of
the greatest summed score, ties going to the longest last piece. A character without a
piece becomes its byte pieces (or the unknown id). Spaces are written with the marker
U+2581, and a text gets one leading space, which decoding takes off again.

NULL and empty texts have no ids and decode to the empty text. A text that holds the
marker itself decodes to a space there (``exact`` is then false), as it must in this
vocabulary. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import buffers, chunks, documents, per_batch
from barsignals.llm.lattice import UNK_PENALTY, PieceModel, Vocabulary, by_size, stretches, take_stretches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 21
BATCH = 1 << 23  # bytes of one Arrow batch of texts
LATTICE = 1 << 17  # bytes of stretches in one lattice


def _parts(group: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """``group`` (stretches) in parts of about ``LATTICE`` bytes; a longer stretch is a part of its own."""
    ends = np.concatenate([[0], np.cumsum(offsets[group + 1] - offsets[group])])
    for s, e in chunks(ends, LATTICE):
        yield group[s:e]


class Codec:
    def __init__(self, model: PieceModel, byte_ids: np.ndarray, piece_bytes: np.ndarray, piece_offsets: np.ndarray):
        self.model, self.byte_ids = model, byte_ids
        self.piece_bytes, self.piece_offsets = piece_bytes, piece_offsets

    @staticmethod
    def load(path: str = VOCABULARY) -> Codec:
        v = Vocabulary.load(path)
        lengths = np.array([len(p) for p in v.pieces])
        return Codec(PieceModel.of(v, v.scores, float(v.scores[v.normal].min()) - UNK_PENALTY), v.byte_ids,
                     np.frombuffer(b"".join(v.pieces), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))

    def _encode_distinct(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for at in (part for group in by_size(offsets) for part in _parts(group, offsets)):
            d, o = take_stretches(data, offsets, at)
            ids, start, by = self.model.best(d, o)
            owner = np.repeat(at, np.diff(by))
            if self.byte_ids[0] >= 0 and (ids == self.model.unknown).any():
                end = np.append(start[1:], len(d))  # pieces tile the bytes
                size = np.where(ids == self.model.unknown, end - start, 1)
                k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                raw = d[np.repeat(start, size) + k]
                unknown = np.repeat(ids == self.model.unknown, size)
                ids = np.where(unknown, self.byte_ids[raw], np.repeat(ids, size))
                owner = np.repeat(owner, size)
            parts.append((owner, ids))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        owner, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        by = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(offsets) - 1)
        return ids[by].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        data, offsets, _ = buffers(column)
        out, sizes = [], []
        for i, j in chunks(offsets, CHUNK):
            coded, counts = stretches(data, offsets[i:j + 1])
            words = coded.dictionary
            d, o, _ = buffers(words)
            ids, at = self._encode_distinct(d, o)
            which = coded.indices.to_numpy(zero_copy_only=False)
            n = at[which + 1] - at[which]
            total = np.concatenate([[0], np.cumsum(n)])
            out.append(ids[np.arange(int(total[-1])) + np.repeat(at[which] - total[:-1], n)])
            sizes.append(np.diff(total[np.concatenate([[0], np.cumsum(counts)])]))
        if not out:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a text's ids, without the leading space."""
        n = self.piece_offsets[ids + 1] - self.piece_offsets[ids]
        total = np.cumsum(n)
        if not len(n) or not total[-1]:
            return b""
        out = self.piece_bytes[np.arange(int(total[-1])) + np.repeat(self.piece_offsets[ids] - total + n, n)].tobytes()
        return out[1:] if out.startswith(b" ") else out

    def is_byte(self) -> np.ndarray:
        out = np.zeros(len(self.piece_offsets) - 1, bool)
        out[self.byte_ids[self.byte_ids >= 0]] = True
        return out


def tokenize(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes (byte pieces), decoded_sha256, exact of every row."""
    per_batch(docs.sparkSession, 1000, BATCH)
    codec = Codec.load(path)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "n_tokens", "n_bytes", "decoded_sha256", "exact"]

    def coded(doc_id, text, byte):
        ids, at = codec.encode(text)
        data, offsets, _ = buffers(text)
        digest, same = [], []
        for s, e, i, j in zip(at[:-1].tolist(), at[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            back = codec.decode(ids[s:e])
            digest.append(hashlib.sha256(back).hexdigest())
            same.append(back == data[i:j].tobytes())
        total = np.concatenate([[0], np.cumsum(byte[ids])])
        return pa.RecordBatch.from_arrays([
            doc_id, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(np.diff(at)),
            pa.array(total[at[1:]] - total[at[:-1]]), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], names)

    def run(batches):
        byte = codec.is_byte()
        for b in batches:
            _, offsets, _ = buffers(b.column("text"))
            for i, j in chunks(offsets, CHUNK):
                yield coded(b.column("doc_id").slice(i, j - i), b.column("text").slice(i, j - i), byte)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, ids array<int>, n_tokens long, n_bytes long, decoded_sha256 string, exact boolean")


def decode_ids(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows of ids."""
    codec = Codec.load(path)
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [codec.decode(np.asarray(v or [], np.int64)).decode("utf-8", "replace") for v in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the check that they decode to it."""
    return tokenize(documents(spark, sf_dir)).select(
        "doc_id", "n_tokens", "n_bytes", "ids", "decoded_sha256", F.col("exact"))
