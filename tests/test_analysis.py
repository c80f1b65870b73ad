"""Quotas, repairs, gates, hashes and limits on literal cases."""

import itertools
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.columns import keyed_draw, row_hash, row_hash_128
from tidemark.operators import analysis, cohort, privacy, stats
from tidemark.sources import files


def turns(available, total):
    quota = {c: min(a, total // len(available)) for c, a in available.items()}
    left = total - sum(quota.values())
    while left > 0 and any(quota[c] < a for c, a in available.items()):
        for c in sorted(available):
            if quota[c] < available[c] and left > 0:
                quota[c] += 1
                left -= 1
    return quota


def test_equal_quotas_equal_turns(spark):
    draw = random.Random(2)
    rows = [(g, f"c{i}", draw.choice([0, 1, 3, 10, 50, 200])) for g in range(30) for i in range(draw.randrange(1, 7))]
    for total in (0, 7, 40, 2000):
        found = analysis.equal_quotas(spark.createDataFrame(rows, "g int, c string, a long"), total, "a", "c", ["g"]).collect()
        for g in range(30):
            assert {r.c: r.quota for r in found if r.g == g} == turns({c: a for h, c, a in rows if h == g}, total)


def test_row_hash_keeps_separators_apart(spark):
    rows = spark.createDataFrame([("a|vb", "c"), ("a", "b|vc"), ("a", None), ("a", "n"), (None, "a"), ("a|v1:b", "c"), ("a", "1:b|v1:c")], "x string, y string")
    for f in (row_hash, row_hash_128):
        assert rows.select(f(["x", "y"]).alias("h")).distinct().count() == 7


def test_sign_flips_are_exact_or_an_error(spark):
    draw = random.Random(3)
    values = [round(draw.gauss(0.2, 1), 3) for _ in range(12)]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "h int, seed int, d double")
    mean = sum(values) / 12
    want = sum(sum(s * v for s, v in zip(signs, values, strict=True)) / 12 >= mean - 1e-15 for signs in itertools.product((-1, 1), repeat=12)) / 2**12
    assert stats.sign_flip(rows, ["h"], "d", "seed").first().raw_p == pytest.approx(want)
    with pytest.raises(PySparkException):
        stats.sign_flip(spark.range(21).select(F.lit(0).alias("h"), F.col("id").alias("seed"), F.lit(1.0).alias("d")), ["h"], "d", "seed").collect()


def test_exhaustive_split_has_a_limit(spark):
    with pytest.raises(PySparkException):
        cohort.exhaustive_split(spark.range(13).select(F.col("id").alias("group_id"), F.lit(5).alias("benign"), F.lit(5).alias("attack")), (0.7, 0.15, 0.15)).collect()


def test_objective_charges_a_split_once(spark):
    groups = spark.createDataFrame([("a", 10, 10), ("b", 0, 0), ("c", 10, 0)], "group_id string, benign long, attack long")
    where = spark.createDataFrame([("a", "train"), ("b", "validation"), ("c", "test")], "group_id string, split string")
    found = cohort.split_objective(groups, where, {"train": 0.5, "validation": 0.25, "test": 0.25}).first().objective
    assert 2000 < found < 2100  # validation lacks both classes and test one: 1000 each


def test_greedy_split_takes_groups_by_exact_size():
    stats_ = [(f"g{i}", 100 - i, 50 + i) for i in range(9)]
    found = cohort.greedy_split(stats_, {"train": 0.7, "validation": 0.15, "test": 0.15}, starts=5, seed=1)
    assert set(found) == {s[0] for s in stats_} and set(found.values()) == {"train", "validation", "test"}


def test_group_bootstrap_auc_equals_resampling(spark):
    draw = random.Random(5)
    rows = [(g, draw.randrange(2), draw.randrange(8) / 8) for g in range(4) for _ in range(25)]
    df = spark.createDataFrame(rows, "g int, y int, p double")
    found = privacy.group_bootstrap_auc(df, "g", "y", 30)
    draws = spark.range(1, 31).select("id", *((keyed_draw("auc", F.col("id").cast("string"), F.lit(str(j))) % 4).alias(f"d{j}") for j in range(1, 5))).collect()
    aucs = []
    for r in draws:
        own = [x for j in range(1, 5) for x in rows if x[0] == r[f"d{j}"]]
        pos, neg = [p for _, y, p in own if y], [p for _, y, p in own if not y]
        aucs.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    aucs.sort()
    at = lambda q: aucs[math.floor(29 * q)] + (29 * q - math.floor(29 * q)) * (aucs[math.ceil(29 * q)] - aucs[math.floor(29 * q)])
    assert tuple(found.first()) == pytest.approx((at(0.025), at(0.975)))


def test_features_configuration_and_phases(spark):
    assert analysis.remove_features(["a", "b", "c"], ["b", "z"], 1) == ["a", "c"]
    with pytest.raises(ValueError):
        analysis.remove_features(["a", "b"], ["b"])
    good = {"split": {"train": 0.7, "validation": 0.15, "test": 0.15}, "clients": 10}
    assert analysis.checked_config(good) is good
    for bad in ({"split": {"train": 0.7, "validation": 0.15, "test": 0.2}, "clients": 10}, {"split": good["split"], "clients": 1}):
        with pytest.raises(ValueError):
            analysis.checked_config(bad)
    cells = spark.createDataFrame([("primary", "PASS"), ("primary", "FAIL")], "phase string, status string")
    assert {tuple(r) for r in analysis.phase_checks(cells, {"primary": 2, "robustness": 0}).collect()} == {("primary", 2, 2, 1, False), ("robustness", 0, 0, 0, True)}


def test_csv_files_of_either_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n\nJosé,1\n".encode())
    (tmp_path / "b.csv").write_bytes("name,n\nZoë,2\n".encode("latin-1"))
    found = files.read_csv_any(spark, str(tmp_path), "name string, n int")
    assert {(r.name, r.n) for r in found.collect()} == {("José", 1), ("Zoë", 2)}
