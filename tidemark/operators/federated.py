"""Federated rounds: local training, scoring, budgeted selection, aggregation, byte accounting.

A model is a flat float vector of a two-layer network (ReLU, sigmoid output),
trained per client with AdamW inside ``applyInPandas``; a client's rows are one
group by nature. Each round is one job; the driver holds only the model vector and
one row per client.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import WIRE_OVERHEAD, metadata_bytes
from tidemark.operators.selection import select_clients
from tidemark.operators.vectors import clipped_mean, weighted_mean

#: Fixed values of local training.
STEPS, BATCH, RATE, DECAY, CLIP, DROPOUT = 24, 512, 1e-3, 1e-4, 5.0, 0.1
#: Fixed values of attacks: share of labels flipped, factor of a flipped update, utility that a forger adds.
FLIP_SHARE, SIGN_FLIP, FORGED = 0.5, -5.0, 1.0


def shapes(features: int, hidden: tuple[int, int] = (128, 64)) -> list[tuple[int, ...]]:
    a, b = hidden
    return [(features, a), (a,), (a, b), (b,), (b, 1), (1,)]


def initial_vector(features: int, seed: int, hidden: tuple[int, int] = (128, 64)) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.uniform(-1, 1, s) * (1 / np.sqrt(s[0])) if len(s) == 2 else np.zeros(s)).ravel() for s in shapes(features, hidden)]).astype(np.float32)


def _unflatten(vector: np.ndarray, sizes: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for s in sizes:
        n = int(np.prod(s))
        out.append(vector[at : at + n].reshape(s).astype(np.float64))
        at += n
    return out


def score(vector: np.ndarray, x: np.ndarray, hidden: tuple[int, int] = (128, 64)) -> np.ndarray:
    w1, b1, w2, b2, w3, b3 = _unflatten(vector, shapes(x.shape[1], hidden))
    h = np.maximum(np.maximum(x @ w1 + b1, 0) @ w2 + b2, 0)
    return 1 / (1 + np.exp(-np.clip(h @ w3 + b3, -40, 40)))[:, 0]


def train_local(vector: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int, hidden: tuple[int, int] = (128, 64), steps: int = STEPS, flip: bool = False) -> np.ndarray:
    """A new vector after ``steps`` AdamW steps of class-weighted cross-entropy; the given one stays as it is."""
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(len(y)) < FLIP_SHARE, 1 - y, y) if flip else y
    weights = len(y) / (2.0 * np.maximum(1, np.bincount(y.astype(int), minlength=2)))
    p = _unflatten(vector, shapes(x.shape[1], hidden))
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        take = rng.integers(0, len(y), min(BATCH, len(y)))
        xb, yb = x[take], y[take].astype(np.float64)
        keep1, keep2 = ((rng.random((len(take), len(b))) >= DROPOUT) / (1 - DROPOUT) for b in (p[1], p[3]))
        h1 = np.maximum(xb @ p[0] + p[1], 0) * keep1
        h2 = np.maximum(h1 @ p[2] + p[3], 0) * keep2
        out = 1 / (1 + np.exp(-np.clip(h2 @ p[4] + p[5], -40, 40)))[:, 0]
        g = ((out - yb) * weights[yb.astype(int)] / len(yb))[:, None]
        g2 = (g @ p[4].T) * (h2 > 0) * keep2
        g1 = (g2 @ p[2].T) * (h1 > 0) * keep1
        grads = [xb.T @ g1, g1.sum(0), h1.T @ g2, g2.sum(0), h2.T @ g, g.sum(0)]
        norm = np.sqrt(sum(float((a * a).sum()) for a in grads))
        grads = [a * min(1.0, CLIP / max(norm, 1e-12)) for a in grads]
        for i, a in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * a, 0.999 * v[i] + 0.001 * a * a
            p[i] = p[i] * (1 - RATE * DECAY) - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return np.concatenate([a.ravel() for a in p]).astype(np.float32)


def _quality(y: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    hit = p >= 0.5
    tp, fp, fn, tn = (float(((hit == a) & (y == b)).sum()) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
    return (2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0), fp / max(1.0, fp + tn)


def client_updates(rows: DataFrame, features: list[str], vector: np.ndarray, round_: int, seed: int, hidden: tuple[int, int] = (128, 64), steps: int = STEPS, malicious: tuple[int, ...] = (), attack: str = "clean", forged: bool = False) -> DataFrame:
    """One candidate row per client (with its delta): rows need client_id, part ('fit' or 'utility'), label and the features.

    ``attack``: clean, label_flip or sign_flip, by the malicious clients; ``forged``: they also add to their utility.
    """

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        import time
        import zlib

        client = int(frame["client_id"].iloc[0])
        own, held = frame[frame["part"] == "fit"], frame[frame["part"] != "fit"]
        x, y = own[features].to_numpy(dtype=np.float64), own["label"].to_numpy(dtype=int)
        began = time.process_time()
        new = train_local(vector, x, y, seed * 1_000_003 + round_ * 1_009 + client, hidden, steps, client in malicious and attack == "label_flip")
        took = time.process_time() - began
        ux, uy = held[features].to_numpy(dtype=np.float64), held["label"].to_numpy(dtype=int)
        (f0, r0), (f1, r1) = (_quality(uy, score(v, ux, hidden)) if len(uy) else (0.0, 0.0) for v in (vector, new))
        delta = (new - vector) * np.float32(SIGN_FLIP if client in malicious and attack == "sign_flip" else 1.0)
        lie = FORGED if forged and client in malicious else 0.0
        wire = len(zlib.compress(b"\0" * 12 + delta.astype("<f4").tobytes(), 6)) + WIRE_OVERHEAD
        return pd.DataFrame({
            "client_id": [client], "utility": [(f1 - 0.25 * r1) - (f0 - 0.25 * r0) + lie], "wire_bytes": [wire], "n_fit": [len(own)], "n_utility": [len(held)], "utility_benign": [int((uy == 0).sum())],
            "utility_attack": [int((uy == 1).sum())], "predicted_airtime_us": [float(wire * 8)], "local_training_seconds": [took], "delta": [delta.tolist()],
        })

    kind = "client_id long, utility double, wire_bytes long, n_fit long, n_utility long, utility_benign long, utility_attack long, predicted_airtime_us double, local_training_seconds double, delta array<float>"
    return rows.select("client_id", "part", "label", *features).groupBy("client_id").applyInPandas(train, kind)


def run_rounds(rows: DataFrame, features: list[str], method: str = "CB-Score", rounds: int = 2, beta: float | None = 0.4, seed: int = 0, hidden: tuple[int, int] = (128, 64), steps: int = STEPS, support: dict[str, int] | None = None, clipped: bool = False) -> tuple[np.ndarray, DataFrame]:
    """The final vector, and one row per round: method, round, selected, used_bytes, budget_bytes, E2E_broadcast."""
    spark, vector, log = rows.sparkSession, initial_vector(len(features), seed, hidden), []
    for n in range(rounds):
        updates = client_updates(rows, features, vector, n, seed, hidden, steps).withColumn("round", F.lit(n)).cache()
        picked = select_clients(updates.drop("delta"), method, ["round"], beta, support, seed=seed + n).first()
        if picked["selected"]:
            mean = clipped_mean if clipped else weighted_mean
            delta = mean(updates.where(F.col("client_id").isin(list(picked["selected"]))), ["round"], "delta", "n_fit").first()["mean"]
            vector = (vector.astype(np.float64) + np.asarray(delta)).astype(np.float32)
        log.append((method, n, list(picked["selected"]), int(picked["used_bytes"]), int(picked["budget_bytes"]), updates.count()))
        updates.unpersist()
    table = spark.createDataFrame(log, "method string, round int, selected array<long>, used_bytes long, budget_bytes long, clients int")
    meta = F.when(F.col("method") == "Full-Contextual", 0).otherwise(F.col("clients") * (metadata_bytes(F.col("method")) + WIRE_OVERHEAD))
    return vector, table.withColumn("E2E_broadcast", F.col("used_bytes") + meta + F.lit(len(vector) * 4 + 12 + WIRE_OVERHEAD))
