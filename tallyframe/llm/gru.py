"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.llm.text import id_remainder, slices, small_batches

HOLD_OUT = 5
SAMPLE_PER_LANGUAGE = 400  # labelled passages that the training sees: the documented bound
PASSAGE_CHARS = 160
SPAN = 64  # bytes after which the network starts anew
HIDDEN = 12
BLOCK = 2048
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def run_direction(p: dict, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (span, batch, hidden) over bytes x (span, batch); keep gathers what the way back needs."""
    size = p["u"].shape[0]
    h = np.zeros((x.shape[1], size), dtype=np.float32)
    out = np.empty((*x.shape, size), dtype=np.float32)
    for t in range(len(x)):
        given, own = p["w"][x[t]], h @ p["u"] + p["b"]
        gates = sigmoid(given[:, :2 * size] + own[:, :2 * size])
        r, z = gates[:, :size], gates[:, size:]
        n = np.tanh(given[:, 2 * size:] + r * own[:, 2 * size:])
        if keep is not None:
            keep.append((h, r, z, n, own[:, 2 * size:]))
        h = n + z * (h - n)
        out[t] = h
    return out


def back_direction(p: dict, x: np.ndarray, kept: list, slope: np.ndarray) -> dict:
    """Gradients by backpropagation through time; slope: of the loss by each hidden state."""
    size = p["u"].shape[0]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    inputs = np.empty((*x.shape, 3 * size), dtype=np.float32)
    carried = np.zeros_like(slope[0])
    for t in range(len(x) - 1, -1, -1):
        h, r, z, n, own = kept[t]
        down = slope[t] + carried
        by_n = down * (1 - z) * (1 - n * n)
        by_r = by_n * own * r * (1 - r)
        by_z = down * (h - n) * z * (1 - z)
        inputs[t] = np.concatenate((by_r, by_z, by_n), axis=1)
        by_own = np.concatenate((by_r, by_z, by_n * r), axis=1)
        grad["u"] += h.T @ by_own
        grad["b"] += by_own.sum(axis=0)
        carried = down * z + by_own @ p["u"].T
    flat = x.ravel()
    order = np.argsort(flat, kind="stable")
    lead = np.flatnonzero(np.concatenate(([True], np.diff(flat[order].astype(np.int16)) != 0)))
    grad["w"][flat[order][lead]] = np.add.reduceat(inputs.reshape(len(flat), -1)[order], lead)
    return grad


@dataclass
class ByteTagger:
    """labels in order; weights of both directions and of the output layer."""

    labels: list[str]
    forward: dict
    backward: dict
    head: dict

    @staticmethod
    def fresh(labels: list[str], hidden: int, seed: int) -> ByteTagger:
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return (rng.standard_normal(shape) * 0.3 / np.sqrt(max(1, shape[0] % 256))).astype(np.float32)

        def direction():
            return {"w": draw(256, 3 * hidden), "u": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, dtype=np.float32)}

        return ByteTagger(labels, direction(), direction(),
                          {"v": draw(2 * hidden, len(labels)), "c": np.zeros(len(labels), dtype=np.float32)})

    def positions(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of every position (span, batch, label), and the hidden states below them."""
        a = run_direction(self.forward, x, keep and keep[0])
        b = run_direction(self.backward, x[::-1], keep and keep[1])[::-1]
        hidden = np.concatenate((a, b), axis=2)
        score = hidden @ self.head["v"] + self.head["c"]
        score = np.exp(score - score.max(axis=2, keepdims=True))
        return score / score.sum(axis=2, keepdims=True), hidden

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> None:
        """Adam on the mean cross entropy of all positions. x: bytes (span, passages); y: label numbers."""
        rng = np.random.default_rng(seed)
        groups = (self.forward, self.backward, self.head)
        moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in g.items()} for g in groups]
        size = self.forward["u"].shape[0]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(y), batch)
            part = x[:, pick]
            kept: tuple[list, list] = ([], [])
            chance, hidden = self.positions(part, kept)
            chance[:, np.arange(batch), y[pick]] -= 1
            chance /= chance.shape[0] * batch
            down = chance @ self.head["v"].T
            flat = hidden.reshape(-1, 2 * size)
            grads = (back_direction(self.forward, part, kept[0], down[:, :, :size]),
                     back_direction(self.backward, part[::-1], kept[1], down[::-1, :, size:]),
                     {"v": flat.T @ chance.reshape(len(flat), -1), "c": chance.sum(axis=(0, 1))})
            norm = np.sqrt(sum(float((v * v).sum()) for g in grads for v in g.values()))
            scale = min(1.0, 1.0 / max(norm, 1e-12))
            for group, grad, moment in zip(groups, grads, moments):
                for k, v in grad.items():
                    m, s = moment[k]
                    m += 0.1 * (v * scale - m)
                    s += 0.01 * ((v * scale) ** 2 - s)
                    group[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the position probabilities of each whole text."""
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        spans = -(-sizes // SPAN)
        grid = np.zeros(int(spans.sum()) * SPAN, dtype=np.uint8)
        pad = np.cumsum(spans) * SPAN - spans * SPAN - (np.cumsum(sizes) - sizes)
        place = np.arange(int(sizes.sum())) + np.repeat(pad, sizes)
        grid[place] = np.frombuffer(b"".join(texts), dtype=np.uint8)
        real = np.zeros(len(grid), dtype=bool)
        real[place] = True
        grid, real = grid.reshape(-1, SPAN), real.reshape(-1, SPAN)
        per_span = np.zeros((len(grid), len(self.labels)))
        for a in range(0, len(grid), BLOCK):
            chance, _ = self.positions(np.ascontiguousarray(grid[a:a + BLOCK].T))
            chance *= real[a:a + BLOCK].T[:, :, None]
            per_span[a:a + BLOCK] = chance.sum(axis=0)
        total = np.zeros((len(texts), len(self.labels)))
        np.add.at(total, np.repeat(np.arange(len(texts)), spans), per_span)
        return total / np.maximum(sizes, 1)[:, None]


def labelled_passages(docs: DataFrame, hold_out: int, per_language: int, seed: int) -> list:
    """At most per_language passages of each language, chosen and placed by hashes of doc_id, from training documents."""
    known = docs.select("doc_id", "text", "lang").filter((id_remainder(F.col("doc_id"), hold_out) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    # about twice as many as wanted pass, so that the ranking below has a bounded number of rows; small languages pass whole
    some = known.join(F.broadcast(counts), "lang").filter(draw < F.lit(float(1 << 40)) * 2 * per_language / F.col("n"))
    place = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest(F.length("text") - PASSAGE_CHARS, F.lit(1))) + 1
    ranked = some.select("doc_id", "lang", draw.alias("draw"),
                         F.substring(F.col("text"), place.cast("int"), F.lit(PASSAGE_CHARS)).alias("passage")).withColumn(
        "k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "passage")))
    return ranked.filter(F.col("k") <= per_language).orderBy("lang", "draw", "doc_id", "passage").collect()


def fit(docs: DataFrame, hold_out: int = HOLD_OUT, per_language: int = SAMPLE_PER_LANGUAGE, hidden: int = HIDDEN,
        steps: int = 260, batch: int = 96, rate: float = 0.02, seed: int = 7) -> ByteTagger | None:
    """Trains on a bounded, balanced sample of labelled passages; None if there is no labelled training document."""
    small_batches(docs.sparkSession)
    rows = labelled_passages(docs, hold_out, per_language, seed)
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    tagger = ByteTagger.fresh(labels, hidden, seed)
    spans, truth = [], []
    for r in rows:
        data = r["passage"].encode()
        for a in range(0, max(len(data) - SPAN // 2, 1), SPAN):
            spans.append(data[a:a + SPAN].ljust(SPAN, b"\0"))
            truth.append(labels.index(r["lang"]))
    x = np.frombuffer(b"".join(spans), dtype=np.uint8).reshape(-1, SPAN).T
    tagger.train(x, np.array(truth), steps, batch, rate, seed)
    return tagger


def label_rows(tagger: ByteTagger | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, has in enumerate(rows.column("has_letter").to_pylist()) if has and tagger is not None]
            if known:
                chance = tagger.pooled([texts[i] for i in known])
                for i, k in zip(known, chance.argmax(axis=1)):
                    named[i] = tagger.labels[k]
                score[known] = np.clip(chance.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(named), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify_languages(docs: DataFrame, tagger: ByteTagger | None = None, hold_out: int = HOLD_OUT) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (mean probability of that label over all bytes).

    Without a tagger one is trained on docs (doc_id, text, lang) first. A prediction sees the whole text's bytes and
    nothing else. A text that is null or has no letter gets 'und' with score 0, as does every text if no labelled training
    document exists. Rows with a null lang are predicted but not learned from; a null doc_id counts as the empty id.
    Repeated rows each get their row; an empty table gives an empty result; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    tagger = tagger or fit(docs, hold_out)
    rows = docs.select("doc_id", "text", (id_remainder(F.col("doc_id"), hold_out) == 0).alias("held_out"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(label_rows(tagger), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identified_rows(tagger: ByteTagger | None, least_score: float, flag: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            known = [i for i, has in enumerate(rows.column(flag).to_pylist()) if has and tagger is not None]
            keep = np.zeros(len(texts), dtype=bool)
            if known:
                keep[known] = tagger.pooled([texts[i] for i in known]).max(axis=1) >= least_score
            yield rows.drop_columns([flag]).filter(pa.array(keep))
    return run


def keep_identified(docs: DataFrame, least_score: float = 0.5, hold_out: int = HOLD_OUT) -> DataFrame:
    """The documents whose language is told with at least least_score, all columns as they are. 'und' is never kept."""
    flag = "_letters" * (1 + max((c.count("_letters") for c in docs.columns), default=0))
    rows = docs.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(identified_rows(fit(docs, hold_out), least_score, flag), docs.schema)
