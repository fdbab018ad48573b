"""Language identification with a linear-chain conditional random field over words.

A word (a run of ASCII letters and bytes of other characters, in lower case) has affix features (first and last one to
three bytes), character n-grams (three bytes) and itself as a lexicon entry, all hashed into one weight table. Learned
transitions tie neighbours; forward-backward gives each word's label distribution, so code-switched text gets its
languages word by word. A document's language is the label with the largest sum, its score that label's mean.

Chains end at line ends and after ``CHAIN`` words, so that chains of many documents are worked in lockstep.

The model is fitted on the driver from at most about ``per_label`` labelled documents a language and ``SAMPLE_BYTES`` in
all (whole texts, chosen by a hash of doc_id, of those with ``LONGEST`` bytes at most; labels beyond ``MAX_LABELS`` are an
error) and broadcast: its size depends on no table. The model and broadcast need a classic session's context.

Null text, and text without a letter: ``und`` with score 0; so has every text if no labelled row exists. Of labels with
equal sums the first in alphabetical order is taken. Texts of any length are labelled whole. Rows are independent of
each other, so repeated rows get equal results; an empty table gives no rows. Only doc_id, text, lang (to learn) and the
columns asked for are read; those come back inside one struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import id_text, packed, prefix_hash, span_hash, text_slices

CHAIN, BUCKETS, MAX_LABELS, PER_LABEL = 64, 1 << 16, 200, 150
#: Bytes of text that the sample has, as expected by its hash, and that one of its texts has at most.
SAMPLE_BYTES, LONGEST = 64 << 20, 256 << 10
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    transitions: np.ndarray  # labels x labels

    def save(self) -> dict:
        return {"labels": self.labels, "weights": self.weights, "transitions": self.transitions}


@dataclass
class Words:
    """Words of packed lower-case text: row, chain bounds, and features as (word, bucket) in word order."""

    row: np.ndarray
    chains: np.ndarray
    heads: np.ndarray
    buckets: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter[:-1]]) if len(data) else letter
    start = np.flatnonzero(letter & (~before | edge[:-1]))
    after = np.concatenate([letter[1:], [False]]) if len(data) else letter
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    line = np.cumsum(data == 10)[start] if len(start) else start
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    chains = np.append(np.flatnonzero(place % CHAIN == 0), len(start))

    prefix = prefix_hash(data)
    size = end - start
    fixed = [span_hash(prefix, start, end)]
    for k in (1, 2, 3):
        n = np.minimum(size, k)
        fixed.append(span_hash(prefix, start, start + n) ^ np.uint64(2 * k))
        fixed.append(span_hash(prefix, end - n, end) ^ np.uint64(2 * k + 1))
    grams = np.maximum(size - 2, 0)
    heads = np.cumsum(grams + len(fixed)) - grams - len(fixed)
    buckets = np.empty(int((grams + len(fixed)).sum()), np.int32)
    for j, value in enumerate(fixed):
        buckets[heads + j] = _bucket(value, j)
    at = np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    begin = np.repeat(start, grams) + at
    buckets[np.repeat(heads + len(fixed), grams) + at] = _bucket(span_hash(prefix, begin, begin + 3), 99)
    return Words(row, chains, heads, buckets)


def _bucket(value: np.ndarray, kind: int) -> np.ndarray:
    return ((value + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(40)).astype(np.int64) % BUCKETS


def emissions(words: Words, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[words.buckets], words.heads, axis=0) if len(words.heads) else np.zeros((0, weights.shape[1]), np.float32)


def forward_backward(scores: np.ndarray, chains: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label distribution of each word, and the sum of the distributions of neighbouring labels (if ``pairs``)."""
    n_labels = scores.shape[1]
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    length = np.diff(chains)
    order = np.argsort(-length, kind="stable")
    first, length = chains[:-1][order], length[order]
    ahead = np.empty_like(potential)
    now = np.zeros((0, n_labels))
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length.max(initial=0)))]
    for t, n in enumerate(live):
        at = first[:n] + t
        now = potential[at] if t == 0 else (now[:n] @ step) * potential[at]
        now = now / now.sum(axis=1, keepdims=True)
        ahead[at] = now
    out, joint = np.empty_like(potential), np.zeros((n_labels, n_labels))
    back = np.ones((len(first), n_labels), np.float32)
    for t in range(len(live) - 1, -1, -1):
        at = first[: live[t]] + t
        if t + 1 < len(live):
            n = live[t + 1]
            later = potential[first[:n] + t + 1] * back[:n]
            if pairs:
                both = ahead[at[:n]][:, :, None] * step * later[:, None, :]
                joint += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            new = later @ step.T
            back[:n] = new / new.sum(axis=1, keepdims=True)
        both = ahead[at] * back[: live[t]]
        out[at] = both / both.sum(axis=1, keepdims=True)
    return out, joint


def fit(texts: list[str], langs: list[str], epochs: int = 6, parts: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Maximum likelihood by AdaGrad over ``parts`` slices of the sample, every word labelled as its document is."""
    labels = sorted(set(langs))
    weights = np.zeros((BUCKETS, len(labels)), np.float32)
    transitions = np.zeros((len(labels), len(labels)))
    seen, seen_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    slices = []
    for i in range(parts):
        own = [j for j in range(len(texts)) if j % parts == i]
        if own:
            words = read_words(*packed(pa.array([texts[j].lower() for j in own], pa.string())))
            gold = np.array([labels.index(langs[j]) for j in own])[words.row]
            if len(gold):
                slices.append((words, gold))
    for _ in range(epochs):
        for words, gold in slices:
            share, joint = forward_backward(emissions(words, weights), words.chains, transitions, True)
            wrong = share.astype(np.float64)
            wrong[np.arange(len(gold)), gold] -= 1
            same = np.ones(len(gold), bool)
            same[words.chains[:-1]] = False
            np.subtract.at(joint, (gold[:-1][same[1:]], gold[1:][same[1:]]), 1)
            per = np.diff(np.append(words.heads, len(words.buckets)))
            for k in range(len(labels)):
                g = np.bincount(words.buckets, weights=np.repeat(wrong[:, k], per), minlength=BUCKETS) / len(gold) * 100 + decay * weights[:, k]
                seen[:, k] += g * g
                weights[:, k] -= rate * g / np.sqrt(seen[:, k])
            g = joint / len(gold) * 100 + decay * transitions
            seen_t += g * g
            transitions -= rate * g / np.sqrt(seen_t)
    return Model(labels, weights, transitions)


def held_out() -> F.Column:
    """Whether crc32 of doc_id in decimals leaves 1 on division by 3; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labelled: DataFrame, per_label: int) -> tuple[list[str], list[str]]:
    """Whole texts and labels, about ``per_label`` of each label, by a hash of doc_id; never more than twice that in all."""
    labelled = labelled.filter(F.octet_length("text") <= LONGEST)
    counts = {r["lang"]: (r["n"], r["size"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} labels")
    if not counts:
        return [], []
    room = SAMPLE_BYTES / len(counts)
    share = F.create_map(*(F.lit(x) for lang, (n, size) in counts.items() for x in (lang, min(1.0, per_label / n, room / max(size, 1)))))
    luck = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    rows = labelled.filter(luck < share[F.col("lang")]).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_label * len(counts)).select("text", "lang").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def train(df: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """Fit on ``df``'s rows (doc_id, text, lang) that are not held out and have text and lang."""
    labelled = df.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    texts, langs = sample(labelled.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()), per_label)
    return fit(texts, langs) if texts else None


def _lower(texts: list[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]


def identify(df: DataFrame, model: Model | None, keep: tuple[str, ...] = (), sure: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and shares (label to its part of the words) of every row's text, and
    the columns ``keep`` as a struct ``row``. With ``sure``, also the mean over words of each one's largest label
    probability, which unlike the score is high for text that is clearly in several languages."""
    docs = id_text(df, *([F.struct(*keep).alias("row")] if keep else [])).withColumn("held_out", held_out())
    shared = docs.sparkSession.sparkContext.broadcast(model and model.save())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value and Model(**shared.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                low = _lower(part.column("text").to_pylist())
                data, offsets = packed(pa.array(low, pa.string()))
                n = len(low)
                names, scores, counts, shares, certain = [UNKNOWN] * n, [0.0] * n, [0] * n, [None] * n, [0.0] * n
                if own and len(data):
                    words = read_words(data, offsets)
                    share, _ = forward_backward(emissions(words, own.weights), words.chains, own.transitions)
                    count = np.bincount(words.row, minlength=n)
                    total = np.stack([np.bincount(words.row, weights=share[:, k], minlength=n) for k in range(len(own.labels))], axis=1)
                    mean = total / np.maximum(count, 1)[:, None]
                    largest = np.bincount(words.row, weights=share.max(axis=1), minlength=n) / np.maximum(count, 1)
                    for i, best in enumerate(mean.argmax(axis=1)):
                        if count[i] and any(map(str.isalpha, low[i])):
                            names[i], scores[i], counts[i] = own.labels[best], min(1.0, float(mean[i, best])), int(count[i])
                            shares[i] = list(zip(own.labels, mean[i].tolist()))
                            certain[i] = min(1.0, float(largest[i]))
                given = {c: part.column(c) for c in ("row", "doc_id", "held_out") if c in part.schema.names}
                found = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "n_words": pa.array(counts, pa.int64())}
                found["shares"] = pa.array(shares, pa.map_(pa.string(), pa.float64()))
                more = {"sure": pa.array(certain, pa.float64())} if sure else {}
                yield pa.RecordBatch.from_pydict(given | found | more)

    schema = T.StructType([f for f in docs.schema if f.name == "row"])
    kinds = {"doc_id": "long", "held_out": "boolean", "lang_pred": "string", "score": "double", "n_words": "long", "shares": T.MapType(T.StringType(), T.DoubleType())} | ({"sure": "double"} if sure else {})
    for name, kind in kinds.items():
        schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def label_words(texts: list[str], model: Model) -> list[list[tuple[str, str, float]]]:
    """(word, label, probability) of each text's words in order."""
    low = _lower(texts)
    data, offsets = packed(pa.array(low, pa.string()))
    words = read_words(data, offsets)
    share, _ = forward_backward(emissions(words, model.weights), words.chains, model.transitions)
    out: list[list[tuple[str, str, float]]] = [[] for _ in texts]
    letter = _LETTER[data]
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]) | letter & np.isin(np.arange(len(data)), offsets))
    for i, (row, start) in enumerate(zip(words.row, starts)):
        stop = start
        while stop < offsets[row + 1] and letter[stop]:
            stop += 1
        best = int(share[i].argmax())
        out[row].append((data[start:stop].tobytes().decode(), model.labels[best], float(share[i, best])))
    return out
