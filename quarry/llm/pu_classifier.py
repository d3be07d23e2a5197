"""Quality classifier learned from positive and unlabelled texts.

A linear logistic model over measures of the text minimises the non-negative
unbiased risk (Kiryo et al., 2017)

    prior E_P[l(z)] + max(0, E_U[l(-z)] - prior E_P[l(-z)]),  l = log(1 + e^-z)

P: the texts of trusted positive labels; U: every training text, its label
unseen.  The class prior is estimated from P and U alone: a discriminator of P
against U is fitted first, and the prior is the least ratio of U's share to
P's share above a score, over scores that at least `min_mass` of P reach
(U = prior P + (1 - prior) N never falls below prior P).

Fitting is damped Newton on the whole training set: tasks sum risk, gradient
and curvature over their rows, Spark adds the sums, and a step is halved until
the non-negative risk falls.  The driver holds sums of the model's size only.
The measures are written once, so a text is read once for fit and scores.

Rows: NULL and empty texts have all measures zero and get a score like any
other; NULL labels are no labels; an id with several labels is positive if any
of them is; repeated rows are scored each; without positives or training rows
every score is 0.5; an empty table gives no rows.  Texts of any length are
measured whole, one at a time.  Only the text enters a score; other columns are
kept by `keep_good`, whatever their names, and ignored by `classify`.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, internal
from quarry.session import stage

#: Fixed value: ASCII characters that count as symbols.
SYMBOLS = b"#*$%&|<>{}[]\\^~=+_@/"
N_MEASURES = 20


def measures(text: str | None) -> list[float]:
    """Shares and scales of a text, most of them between 0 and 1."""
    raw = b"" if text is None else text.encode("utf-8", "replace")
    ws = raw.split()
    if not ws:
        return [0.0] * N_MEASURES
    n, size = len(ws), len(raw)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(by[65:91].sum()), int(by[97:123].sum())
    letters = max(1, upper + lower + int(by[128:].sum()))
    lens = np.array([len(w) for w in ws])
    counts = Counter(ws)
    low = [w.lower() for w in ws]
    same = sum(map(bytes.__eq__, low, low[1:]))
    grams = Counter(zip(low, low[1:], low[2:]))
    again = sum(c for c in grams.values() if c > 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    caps = sum(w.isupper() for w in ws)
    alone = sum(len(w) == 1 and not w.isalnum() and w[0] < 128 for w in ws)
    odd_end = sum(w[-1] in SYMBOLS for w in ws)
    ends = int(by[[33, 46, 63]].sum())
    return [
        min(1.0, math.log1p(n) / 12), 10.0 * float(by[list(SYMBOLS)].sum()) / size,
        10.0 * int(by[33]) / size, 10.0 * int(by[124]) / size, upper / letters,
        int(by[48:58].sum()) / size, (int(by[32]) + int(by[10])) / size,
        10.0 * int(by[[44, 46, 58, 59]].sum()) / size, min(2.0, float(lens.mean()) / 10),
        min(2.0, float(lens.std()) / 10), len(counts) / n, same / n, again / max(1, n - 2),
        1 - len(set(lines)) / len(lines), min(1.0, math.log1p(size / len(lines)) / 10),
        caps / n, alone / n, odd_end / n, max(counts.values()) / n, min(1.0, ends / n),
    ]


def measure_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([measures(t) for t in s])
        give_back()
    return measured(text)


@dataclass(frozen=True)
class Model:
    """z = weights . features(measures), standardised by centre and scale."""
    weights: list[float]
    centre: list[float]
    scale: list[float]
    prior: float

    def z(self, x: np.ndarray) -> np.ndarray:
        return _design(x, np.array(self.centre), np.array(self.scale)) @ np.array(self.weights)


def _design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Measures and their squares, standardised and held within 8 deviations,
    and a constant."""
    both = np.concatenate([x, x * x], axis=1)
    s = np.clip((both - centre) / scale, -8, 8)
    return np.concatenate([s, np.ones((len(x), 1))], axis=1)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _summed(train: DataFrame, terms) -> np.ndarray:
    """terms(x, positive) summed over all rows: tasks add their batches, Spark
    adds the tasks place by place."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for pdf in batches:
            if len(pdf):
                total = total + terms(np.stack(pdf["x"].to_numpy()), pdf["positive"].to_numpy(bool))
        if not isinstance(total, float):
            yield pd.DataFrame({"place": np.arange(len(total)), "value": total})
        give_back()

    rows = train.mapInPandas(sums, "place int, value double").groupBy("place").agg(
        F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["place"]] = r["value"]
    return out


def _moments(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    both = np.concatenate([x, x * x], axis=1)
    return np.concatenate([[len(x), positive.sum()], both.sum(axis=0), (both ** 2).sum(axis=0)])


def _newton(train: DataFrame, centre, scale, n_pos: float, n_all: float, prior: float | None,
            ridge: float, rounds: int) -> np.ndarray:
    """Weights of least risk.  prior None: P against U, both at weight one."""
    d = len(centre) + 1
    a = (1.0 if prior is None else prior) / n_pos
    neg = 0.0 if prior is None else -a

    def at(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        def terms(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
            f = _design(x, centre, scale)
            z = f @ w
            p = 1 / (1 + np.exp(-z))
            # every training row is in U; the positives are in P besides
            up, down = a * positive, neg * positive + 1.0 / n_all
            pos_risk = float((up * _softplus(-z)).sum())
            neg_risk = float((down * _softplus(z)).sum())
            bend = p * (1 - p)
            parts = [f.T @ (up * (p - 1)), f.T @ (down * p)]
            parts += [((f * (side * bend)[:, None]).T @ f).ravel() for side in (up, down)]
            return np.concatenate([[pos_risk, neg_risk], *parts])
        s = _summed(train, terms)
        pull = np.full(d, ridge)
        pull[-1] = 0.0
        risk = s[0] + max(0.0, s[1]) + 0.5 * float((pull * w * w).sum())
        slopes, bends = s[2:2 + 2 * d].reshape(2, d), s[2 + 2 * d:].reshape(2, d, d)
        slopes[0] += pull * w
        bends[0] += np.diag(pull + 1e-9)
        return risk, float(s[1]), slopes, bends

    w = np.zeros(d)
    risk, negative, slopes, bends = at(w)
    step, between = 1.0, [0.5, 0.75, 0.25]
    share = float(negative > 0)  # of the negative part: it has no slope where it is cut off
    for _ in range(rounds):
        move = np.linalg.solve(bends[0] + share * bends[1], slopes[0] + share * slopes[1])
        trial = at(w - step * move)
        if trial[0] < risk - 1e-6:
            w, (risk, negative, slopes, bends) = w - step * move, trial
            step, between, share = min(1.0, 2 * step), [0.5, 0.75, 0.25], float(negative > 0)
        elif step >= 0.1:
            step /= 4
        elif between and abs(negative) < 0.05:  # at the edge the way down lies between both slopes
            step, share = 1.0, between.pop(0)
        else:
            break
    return w


def _estimated_prior(train: DataFrame, model: Model, n_pos: float, n_all: float,
                     min_mass: float, bins: int = 256) -> float:
    """Least share ratio of U to P above a score of the discriminator."""
    def terms(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        b = np.clip((model.z(x) + 8) * (bins / 16), 0, bins - 1).astype(int)
        return np.concatenate([np.bincount(b, minlength=bins),
                               np.bincount(b[positive], minlength=bins)]).astype(float)

    s = _summed(train, terms)
    u = np.cumsum(s[:bins][::-1]) / n_all
    p = np.cumsum(s[bins:][::-1]) / n_pos
    ok = p >= min_mass
    return float(np.clip((u[ok] / p[ok]).min(), 0.01, 0.99))


def fit(measured: DataFrame, ridge: float = 1e-4, rounds: int = 14,
        min_mass: float = 0.5, first_ridge: float = 1e-2) -> Model | None:
    """The model of staged rows (x, positive, trains); None without positives.
    The discriminator is held back more, so that it doesn't learn P by heart."""
    train = measured.where("trains").select("x", "positive")
    m = _summed(train, _moments)
    if not len(m) or m[1] == 0:
        return None
    n, n_pos = m[0], m[1]
    k = (len(m) - 2) // 2
    centre = m[2:2 + k] / n
    scale = np.sqrt(np.maximum(m[2 + k:] / n - centre ** 2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    first = _newton(train, centre, scale, n_pos, n, None, first_ridge, rounds)
    told = Model(first.tolist(), centre.tolist(), scale.tolist(), 0.5)
    prior = _estimated_prior(train, told, n_pos, n, min_mass)
    w = _newton(train, centre, scale, n_pos, n, prior, ridge, rounds)
    return Model(w.tolist(), centre.tolist(), scale.tolist(), prior)


def score_column(x: Column, model: Model | None) -> Column:
    """Probability of the positive class from the measures."""
    if model is None:
        return F.when(x.isNotNull(), F.lit(0.5)).otherwise(F.lit(0.5))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            z = model.z(np.stack(s.to_numpy())) if len(s) else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-z)))
        give_back()
    return score(x)


def measured_rows(docs: DataFrame, labels: DataFrame, trains: Column, doc_id: str = "doc_id",
                  text: str = "text", label: str = "quality") -> DataFrame:
    """Staged doc_id, x, positive, trains: every text's measures, whether a
    trusted label calls it positive, and whether the row may train."""
    thin = stage(docs.select(docs[doc_id].alias(doc_id),
                             measure_column(docs[text]).alias("x")), "measures")
    return training_rows(thin, F.col("x"), labels, trains, doc_id, label)


def training_rows(rows: DataFrame, x: Column, labels: DataFrame, trains: Column,
                  doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The same from staged rows that have their measures `x`."""
    trusted = labels.where(F.col(label) == 1).select(
        F.col("doc_id").alias("p_id")).distinct().withColumn("positive", F.lit(True))
    thin = rows.select(rows[doc_id].alias("doc_id"), x.alias("x"))
    return stage(thin.join(trusted, F.col("doc_id") == F.col("p_id"), "left").select(
        "doc_id", "x", F.coalesce("positive", F.lit(False)).alias("positive"),
        trains.alias("trains")), "training")


def classify(docs: DataFrame, labels: DataFrame, trains: Column, threshold: float = 0.3,
             **columns) -> DataFrame:
    """doc_id, score, predicted for each row."""
    rows = measured_rows(docs, labels, trains, **columns)
    scored = rows.withColumn("score", score_column(F.col("x"), fit(rows)))
    return scored.select("doc_id", "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, trains: Column, threshold: float = 0.3,
              text: str = "text", **columns) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier doesn't reject.
    They are written with their measures, which are taken once."""
    x = internal("x")
    measured = stage(docs.withColumn(x, measure_column(docs[text])), "measured")
    model = fit(training_rows(measured, F.col(x), labels, trains, **columns))
    return measured.where(score_column(F.col(x), model) >= threshold).drop(x)
