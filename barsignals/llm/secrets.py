"""Secret scans: base patterns, plus character Markov models compared by log-likelihood ratio.

Base spans come from three patterns (assigned values, access keys, long hexadecimal
runs). The method adds spans of kind ``random``: token-like runs whose characters are
likelier under a first-order Markov model of random strings than under one of ordinary
identifiers. Both models are trained from labelled samples: tokens inside base spans
of a bounded, hash-chosen sample of documents and drawn random strings are labelled
random. Of the other tokens of these documents, those whose parts are words or numbers
(and drawn numbers) are labelled ordinary. The rest has no label, as it holds the very
strings to be found: it enters the ordinary model by its probability of being ordinary
(expectation maximisation that starts from the labelled tokens). A token is random where
its ratio exceeds the log-odds against a stated prior, which no token of the sample moves.

NULL and empty texts have no spans. Offsets are code points, end exclusive. Repeated
rows give repeated results.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import documents, per_batch, rate_filter, sample_key

# Fixed values of the contract: kinds in their order, patterns, least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WORD = re.compile(r"[A-Za-z0-9+/_-]{8,}")
# parts that are a word, words joined by their capitals, or a number
PLAIN = re.compile(r"(?:[+/_-]|(?<![A-Za-z0-9])(?:[0-9]+|(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*)[0-9]{0,4})(?![A-Za-z0-9]))+")
LEAST_MEAN = 0.5  # nats per character that a random token has at least


@dataclass(frozen=True)
class SecretParams:
    sample_docs: int = 4000  # bound on the documents whose tokens are learned from
    tokens_per_doc: int = 200  # and on the ordinary tokens of each, chosen by hash
    drawn: int = 4000  # random strings drawn as labelled samples
    prior: float = 1e-5  # share of random strings among token-like runs
    rounds: int = 6  # of expectation maximisation over the tokens without a label
    seed: int = 13


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, unordered."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Covered:
    """Union of base spans, for overlap tests in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for s, _, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def _labelled_tokens(p: SecretParams):
    def run(batches):
        for b in batches:
            kinds, tokens = [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                kinds += [True] * len(base)
                tokens += [text[s:e].split("=")[-1].split(":")[-1].strip(" \"'") for s, _, e in base]
                covered = Covered(base)
                plain = {m.group() for m in WORD.finditer(text or "") if not covered.meets(m.start(), m.end())}
                plain = sorted(plain, key=lambda w: hashlib.blake2b(w.encode(), digest_size=8).digest())[:p.tokens_per_doc]
                kinds += [False] * len(plain)
                tokens += plain
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.bool_()), pa.array(tokens, pa.string())], ["secret", "token"])
    return run


def _transitions(tokens: list[str], weight: np.ndarray | None = None) -> np.ndarray:
    """Counts of character pairs, by the weights of the tokens; row 0 holds first characters."""
    out = np.zeros((128, 128))
    data = np.frombuffer(("\0" + "\0".join(tokens) + "\0").encode("ascii", "replace"), np.uint8).astype(np.int64)
    of = 1.0 if weight is None else np.append(weight, 0.0)[np.cumsum(data == 0)[:-1] - 1]
    np.add.at(out, (data[:-1], data[1:]), of)
    out[:, 0] = 0
    return out


def _log_chain(counts: np.ndarray, alphabet: np.ndarray, strength: float) -> np.ndarray:
    """Log transition probabilities, each row shrunk to the chain's own character frequencies."""
    marginal = counts[1:].sum(0)[alphabet] + 1
    marginal /= marginal.sum()
    out = np.zeros((128, 128))
    rows = counts[:, alphabet] + strength * marginal
    out[:, alphabet] = np.log(rows / rows.sum(1, keepdims=True))
    return out


def fit(secret: list[str], ordinary: list[str], p: SecretParams) -> tuple[np.ndarray, float]:
    """(log-likelihood ratio of each character pair, log-odds that a random token exceeds)."""
    text = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
    alphabet = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    rng = np.random.default_rng(p.seed)
    sets = ["0123456789abcdef", text[:36 - 10] + "0123456789", text[:62], text[:64], text[:62] + "_-"]
    drawn = ["".join(rng.choice(list(sets[k % len(sets)]), 32)) for k in range(p.drawn)]
    known = _transitions(secret)
    extra = _transitions(drawn)
    scale = max(1.0, known.sum() / max(extra.sum(), 1))  # observed and drawn strings weigh alike
    random = _log_chain(known + scale * extra, alphabet, 5.0)
    numbers = ["".join(rng.choice(list(text[52:62]), 16)) for _ in range(p.drawn // 20)]  # ordinary, however few the sample has
    plain = _transitions([w for w in ordinary if PLAIN.fullmatch(w)] + numbers)
    open_ = [w for w in ordinary if not PLAIN.fullmatch(w)]
    odds = float(np.log((1 - p.prior) / p.prior))
    ratio = random - _log_chain(plain, alphabet, 5.0)
    for _ in range(p.rounds if open_ else 0):
        likely = 1 / (1 + np.exp(np.clip(_ratios(open_, ratio) - odds, -50, 50)))
        ratio = random - _log_chain(plain + _transitions(open_, likely), alphabet, 5.0)
    return ratio, odds


def _ratios(tokens: list[str], ratio: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each token, over all its characters."""
    data = np.frombuffer(("\0" + "\0".join(tokens)).encode("ascii", "replace"), np.uint8)
    return np.add.reduceat(np.append(np.where(data[1:] == 0, 0.0, ratio[data[:-1], data[1:]]), 0.0), np.flatnonzero(data == 0))


def _is_random(token: str, ratio: np.ndarray, odds: float) -> bool:
    return float(_ratios([token], ratio)[0]) > max(odds, LEAST_MEAN * len(token))


def train(docs: DataFrame, p: SecretParams = SecretParams()) -> tuple[np.ndarray, float]:
    """Learn from the tokens of a bounded sample of documents."""
    per_batch(docs.sparkSession, 2000)
    total = docs.agg(F.count("*")).first()[0]
    sample = docs.filter(rate_filter(sample_key(), F.lit(min(1.0, p.sample_docs / max(1, total))), p.seed))
    rows = (sample.select("text").mapInArrow(_labelled_tokens(p), "secret boolean, token string")
            .groupBy("secret", "token").agg(F.count("*").alias("n")).orderBy("secret", "token").toArrow())
    secret = [t for t, s in zip(rows.column("token").to_pylist(), rows.column("secret").to_pylist()) if s]
    ordinary = [t for t, s in zip(rows.column("token").to_pylist(), rows.column("secret").to_pylist()) if not s]
    return fit(secret, ordinary, p)


def all_spans(text: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """Base spans and added ones, by start, then kind."""
    base = base_spans(text)
    out, covered = list(base), Covered(base)
    for m in TOKEN.finditer(text):
        if not covered.meets(m.start(), m.end()) and _is_random(m.group(), ratio, threshold):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def scan(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row."""
    per_batch(docs.sparkSession, 2000)
    ratio, threshold = model
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t or "", ratio, threshold)]
                     for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, model: tuple[np.ndarray, float], mark: str = "[secret]") -> DataFrame:
    """``docs`` with each run of covered characters replaced by ``mark`` (n_chars, if there, follows)."""
    per_batch(docs.sparkSession, 2000)
    ratio, threshold = model

    def clean(text):
        if not text:
            return text
        parts, at = [], 0
        for s, _, e in all_spans(text, ratio, threshold):
            if s >= at:
                parts += [text[at:s], mark]
            at = max(at, e)
        return "".join(parts) + text[at:] if parts else text

    schema = docs.schema

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("text")
            yield b.set_column(k, b.schema.field(k), pa.array([clean(t) for t in b.column(k).to_pylist()], b.schema.field(k).type))

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = documents(spark, sf_dir)
    found = scan(docs, train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"),
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
