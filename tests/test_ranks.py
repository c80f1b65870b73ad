"""Running sums, first rows and quantiles in bins against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.operators import metrics, ranks


@pytest.fixture(scope="module")
def table(spark):
    """A group with two thirds of the rows, null groups, a group of one row; all values distinct in their group, one null, one NaN."""
    rng = random.Random(3)
    rows = [("hot", float(v), rng.randint(0, 5), i) for i, v in enumerate(rng.sample(range(10_000), 2000))]
    rows += [(None, rng.random(), rng.randint(0, 5), 5000 + i) for i in range(900)] + [("one", 1.0, 7, 9000), ("hot", None, 3, 9001), ("hot", float("nan"), 4, 9002)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, v double, n int, k long")


def place(v):
    return (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)


@pytest.mark.parametrize("bin_rows", [7, 100, 50_000])
def test_running_sums(table, bin_rows):
    rows, df = table
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = {}
    for own in groups.values():
        total, before = 0, None
        for r in sorted(own, key=lambda r: place(r[1])):
            total += r[2]
            want[r[3]] = (total, sum(x[2] for x in own), before)
            before = r[2]
    got = ranks.running(df, ["g"], "v", ["n"], ["n"], bin_rows)
    assert got.columns == [*df.columns, "n_upto", "n_all", "n_before"]
    found = got.collect()
    assert len(found) == len(rows) and {r.k: (r.n_upto, r.n_all, r.n_before) for r in found} == want


def test_bins_are_many_and_bounded(table):
    _, df = table
    sizes = {(r["__group"].g, r["__bin"]): r["count"] for r in ranks.in_bins(df, ["g"], df["v"], 100).groupBy("__group", "__bin").count().collect()}
    hot = [n for (g, _), n in sizes.items() if g == "hot"]
    assert len(hot) >= 8 and max(hot) <= 1000 and sizes["one", 0] == 1
    assert ranks.running(df.limit(0), ["g"], "v", ["n"]).count() == 0


@pytest.mark.parametrize("bin_rows", [50, 50_000])
def test_first_rows(spark, table, bin_rows):
    rows, df = table
    quotas = spark.createDataFrame([("hot", 777), ("one", 5), (None, 3), ("absent", 4)], "g string, quota long")
    got = sorted(r.k for r in ranks.first_rows(df, ["g"], ["n", "k"], quotas, bin_rows=bin_rows).collect())
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[2], r[3]))[:777]
    assert got == sorted([9000, *(r[3] for r in hot)])


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=3000), rng.integers(0, 9, 3000).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b, strict=True)] + [(None, float("nan"), None)], "a double, b double, c double")
    qs = [0.5, 0.005, 0.995, 0.25, 0.75, 0.0, 1.0]
    got = {r.feature: r.q for r in ranks.exact_quantiles(df, ["a", "b", "c"], qs, bin_rows=100).collect()}
    assert set(got) == {"a", "b"}
    plain = df.selectExpr(f"percentile(a, array({', '.join(map(str, qs))})) AS a", f"percentile(nanvl(b, null), array({', '.join(map(str, qs))})) AS b").first()
    assert got["a"] == plain.a and got["b"] == plain.b


def test_a_cell_of_many_bins(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BIN_ROWS", 60)
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 1500), np.round(rng.random(1500), 3)
    df = spark.createDataFrame([("big", int(a), float(b)) for a, b in zip(y, p, strict=True)] + [("small", 1, 0.5), ("small", 0, 0.5)], "cell_id string, y int, p double")
    got = {r.cell_id: r for r in metrics.aucs(df).collect()}
    won = sum((p[i] > p[y == 0]).sum() + (p[i] == p[y == 0]).sum() / 2 for i in np.flatnonzero(y))
    assert abs(got["big"].roc_auc - won / (y.sum() * (y == 0).sum())) < 1e-12 and got["small"].roc_auc == 0.5
    for collinear in (True, False):
        roc = sorted((r.i, r.x, r.y, r.threshold) for r in metrics.curves(df, most=10**6, collinear=collinear).where("cell_id = 'big' and curve = 'ROC'").collect())
        scores = sorted(set(p.tolist()), reverse=True)
        counts = [(int((y[p >= t] == 1).sum()), int((y[p >= t] == 0).sum()), t) for t in scores]
        if not collinear:
            counts = [c for j, c in enumerate(counts) if j in (0, len(counts) - 1) or any(counts[j - 1][m] + counts[j + 1][m] != 2 * c[m] for m in (0, 1))]
        assert [r[0] for r in roc] == list(range(len(counts) + 1)) and [r[3] for r in roc[1:]] == [c[2] for c in counts]
        assert all(abs(r[1] - c[1] / (y == 0).sum()) < 1e-12 and abs(r[2] - c[0] / y.sum()) < 1e-12 for r, c in zip(roc[1:], counts, strict=True))
