"""Every bound query against its SQL in DuckDB, on tables made here."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest

from tidemark.plans import registered

QUERIES, ORACLE = registered()


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    """Small tables of the driver's schemas, with ties and repeats."""
    rng = random.Random(7)
    root = tmp_path_factory.mktemp("sf")
    con = duckdb.connect()

    def table(name, columns, rows):
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{root}/{name}.parquet' (FORMAT parquet)")

    kinds = ["click", "view", "purchase", "signup", "error"]
    day = datetime(2024, 1, 1)
    table("events", "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR", [(i, day + timedelta(minutes=2.4 * i), rng.randrange(60), rng.choice(kinds), round(rng.expovariate(0.02) % 490 + 0.01, 2), f'{{"k": {rng.randrange(100)}}}') for i in range(2400)])
    table(
        "lineitem",
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
        [(i // 4, rng.randrange(60), rng.randrange(10), i % 4 + 1, float(rng.randrange(1, 50)), rng.randrange(10_000) / 4, rng.randrange(10) / 100, 0.0, rng.choice("ANR"), rng.choice("OF"), datetime(1995, 1, 1) + timedelta(days=rng.randrange(2500))) for i in range(1200)],
    )
    table("orders", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR", [(i, i % 30, rng.choice("FOP"), i * 1.5, datetime(1996, 1, 1), rng.choice(["1-URGENT", "5-LOW", "x"])) for i in range(200)])
    table("customer", "c_custkey BIGINT, c_name VARCHAR, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment VARCHAR", [(i, f"c{i}", rng.randrange(25), rng.randrange(-100, 900) / 1.0, rng.choice("AB")) for i in range(90)])
    table("supplier", "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INT, s_acctbal DOUBLE", [(i, f"s{i}", rng.randrange(25), float(rng.randrange(10_000))) for i in range(12)])
    table("part", "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INT, p_retailprice DOUBLE", [(i, "n", f"Brand#{rng.randrange(15)}" if i % 9 else None, "t", i % 7, i / 2) for i in range(120)])
    table("nation", "n_nationkey INT, n_name VARCHAR, n_regionkey INT", [(i, f"N{i}", i % 5) for i in range(25)])
    table("documents", "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT", [(i, "t", "en", f"src{i % 20}", 1) for i in range(50)])
    table("labels", "doc_id BIGINT, quality INT, toxic INT", [(i, 1, 0) for i in range(0, 50, 3)])
    table("embeddings", "vec_id BIGINT, embedding FLOAT[], label INT", [(i, [rng.gauss(0, 1) for _ in range(8)], i % 10) for i in range(80)])
    return str(root)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("events", "lineitem", "orders", "customer", "supplier", "part", "nation", "documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b and (a is None or type(a) is type(b))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows
        return
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(r[columns.index(c)] for c in df.columns) for r in found.fetchall()]
    key = lambda r: tuple((x is None, f"{x:.4f}" if isinstance(x, float) else str(x)) for x in r)
    assert len(rows) == len(want)
    assert all(close(a, b) for x, y in zip(sorted(rows, key=key), sorted(want, key=key), strict=True) for a, b in zip(x, y, strict=True))
