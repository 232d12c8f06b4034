"""The risk's minimum against plain gradient descent, the prior against a known one, and held-out floors on the shipped documents."""

import numpy as np
from pyspark.sql import functions as F

from arborlight.llm import quality
from arborlight.llm.queries import queries

SF = "/root/testdata/sf0.01"


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.7
    x = rng.random((n, quality.SIZE)) * 0.3
    x[:, 0] += good
    x[:, 1] -= 0.5 * good
    x[:, -1] = 1
    positive = good & (rng.random(n) < 0.5)
    rows = [([float(v) for v in r], bool(p)) for r, p in zip(x.astype(np.float32), positive, strict=True)]
    return spark.createDataFrame(rows, "x array<float>, positive boolean"), x.astype(np.float32).astype(float), positive, good


def risk(w, z, positive, prior, l2):
    s = z @ w
    loss = lambda v: np.logaddexp(0, -v)
    negative = loss(-s).mean() - prior * loss(-s[positive]).mean()
    return prior * loss(s[positive]).mean() + max(0.0, negative) + l2 / 2 * w @ w


def test_fit_reaches_the_minimum_of_the_risk(spark):
    df, x, positive, _ = table(spark)
    prior, spread = 0.7, 10.0
    out, _ = quality.fit(df, prior, spread=spread)
    mean, std = x.mean(0), x.std(0)
    mean[-1], std[-1] = 0, 1
    z, l2 = (x - mean) / std, 1e-4 + spread / positive.sum()
    w = out * std
    w[-1] = out[-1] + (mean * out)[:-1].sum()
    plain = np.zeros(quality.SIZE)
    for _ in range(4000):
        q = 1 / (1 + np.exp(-(z @ plain)))
        plain -= 0.05 * (z.T @ q / len(z) - prior * z[positive].mean(0) + l2 * plain)
    assert risk(w, z, positive, prior, l2) <= risk(plain, z, positive, prior, l2) + 1e-3


def test_prior_is_estimated(spark):
    df, _, _, good = table(spark, 2000, 3)
    _, prior = quality.fit(df)
    assert abs(prior - good.mean()) < 0.08


def test_held_out_floors_on_shipped_documents(spark):
    out = queries()["op3_quality_classifier"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("y")), "doc_id").toPandas()
    y, rank = out.y.to_numpy() == 1, out.score.rank().to_numpy()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert len(out) > 50 and auc >= 0.97 and (out.predicted == out.y).mean() >= 0.93
    assert out.predicted[y].mean() >= 0.95  # clean documents stay


def test_odd_texts_have_features_of_one_length():
    for text in (None, "", " ", "\n\n", "a", "ab", "é🙂", "x" * 100_000, "\x00\x1f", "\ud800"):
        x = quality.features(text)
        assert x.shape == (quality.SIZE,) and np.isfinite(x).all() and x[-1] == 1 and x[-2] == (not text)
