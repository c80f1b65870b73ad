"""Row-level partitions, CSV rows, idempotent sinks and group AUCs against plain versions."""

import csv
import io
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import keyed_draw
from tidemark.operators import integrity, metrics, partition, privacy
from tidemark.sources import files
from tidemark.sources.csv_rows import csv_records, line_states, read_csv_rows


def test_repair_moves():
    assert partition.repair_moves([10, 500, 700, 150], 200) == [(2, 0, 0, 190), (2, 3, 190, 240)]
    assert partition.repair_moves([], 5) == [] and partition.repair_moves([5, 5], 5) == []
    with pytest.raises(ValueError):
        partition.repair_moves([1, 250], 200)


def test_largest_remainder():
    assert partition.largest_remainder([0.5, 0.25, 0.25], 3) == [1, 1, 1]
    assert partition.largest_remainder([0.25, 0.25, 0.5], 6) == [2, 1, 3] and sum(partition.largest_remainder([0.1] * 10, 7)) == 7


@pytest.mark.parametrize("alpha", [0.1, 0.5, 1.0, 3.0])
def test_gamma_has_its_mean_and_variance(alpha):
    drawn = [partition.keyed_gamma(alpha, "t", i) for i in range(4000)]
    mean = sum(drawn) / len(drawn)
    assert abs(mean - alpha) < 0.12 * max(alpha, 0.5) and abs(sum((x - mean) ** 2 for x in drawn) / len(drawn) - alpha) < 0.25 * max(alpha, 0.5)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, None if i % 50 == 0 else min(2, int(rng.expovariate(1))), f"x{i}") for i in range(900)]
    return spark.createDataFrame(data, "id long, label int, rank string").repartition(7)


@pytest.mark.parametrize("bin_rows", [10**6, 40, 3])
def test_rank_within(spark, rows, bin_rows):
    draw = keyed_draw("t", F.col("id").cast("string"))
    ranked = partition.rank_within(rows, "label", "id", draw, "place", bin_rows)
    assert ranked.columns == [*rows.columns, "place"]
    own = defaultdict(list)
    for r in ranked.withColumn("d", draw).collect():
        own[r.label].append((r.d, r.id, r.place))
    assert sum(map(len, own.values())) == 900
    for x in own.values():
        assert [p for _, _, p in sorted(x)] == list(range(len(x)))


@pytest.mark.parametrize(("clients", "alpha", "least"), [(10, 0.5, 60), (5, 0.1, 100), (3, 5.0, 1), (1, 1.0, 900)])
def test_quota_partition(rows, clients, alpha, least):
    got = partition.quota_partition(rows, "label", "id", clients, alpha, 3, least)
    assert got.columns == [*rows.columns, "client_id"]
    dealt = {r.id: r.client_id for r in got.collect()}
    by_class = defaultdict(list)
    for r in rows.withColumn("d", keyed_draw("deal", F.lit("3"), F.col("id").cast("string"))).collect():
        by_class[r.label].append((r.d, r.id))
    want, own = {}, defaultdict(list)
    for y in sorted(by_class, key=lambda y: (y is not None, y or 0)):
        ids, at = [i for _, i in sorted(by_class[y])], 0
        for k, n in enumerate(partition.largest_remainder(partition.dirichlet_shares(alpha, clients, "dirichlet", 3, y), len(ids))):
            for i in ids[at : at + n]:
                want[i] = k
                own[k].append(i)
            at += n
    counts = [len(own[k]) for k in range(clients)]
    while min(counts) < least:  # one at a time, from the front of the largest
        to, giver = counts.index(min(counts)), counts.index(max(counts))
        need = least - counts[to]
        for i in own[giver][:need]:
            want[i] = to
        own[giver] = own[giver][need:]
        counts[to], counts[giver] = least, counts[giver] - need
    assert dealt == want and min(Counter(dealt.values()).values()) >= least and set(dealt.values()) == set(range(clients))


def test_partitions_that_cannot_be(spark, rows):
    few = rows.limit(40)
    with pytest.raises(ValueError):
        partition.quota_partition(few, "label", "id", 10, 0.5, 1, 200)
    with pytest.raises(ValueError):
        partition.multinomial_partition(few, "label", "id", 10, 0.5, 1, 200, attempts=20)
    empty = rows.limit(0)
    assert partition.quota_partition(empty, "label", "id", 3, 1.0, 1).count() == 0
    assert partition.multinomial_partition(empty, "label", "id", 3, 1.0, 1).columns == [*rows.columns, "client_id"]


def test_multinomial_partition(rows):
    got = partition.multinomial_partition(rows, "label", "id", 6, 0.5, 2, 40, at_once=3)
    assert got.columns == [*rows.columns, "client_id"] and got.count() == 900
    assert min(Counter(r.client_id for r in got.collect()).values()) >= 40
    # the first draw that does it, by a plain count
    unit = {r.id: r.u for r in rows.select("id", (keyed_draw("client", F.lit("2"), F.col("id").cast("string")) / float(1 << 32)).alias("u")).collect()}
    label = {r.id: r.label for r in rows.collect()}
    for t in range(1000):
        bounds = {y: partition._cumulative(partition.dirichlet_shares(0.5, 6, "dirichlet", 2, t, y)) for y in set(label.values())}
        want = {i: min(5, sum(b <= u for b in bounds[label[i]])) for i, u in unit.items()}
        if min(Counter(want.values()).get(k, 0) for k in range(6)) >= 40:
            break
    assert {r.id: r.client_id for r in got.collect()} == want


def plain_rows(text, columns):
    out = []
    for n, record in enumerate(csv.reader(io.StringIO(text, newline=""))):
        if n and record and not (len(record) == 1 and not record[0].strip()):
            while len(record) > columns and record[-1] == "":
                record = record[:-1]
            if len(record) <= columns:
                out.append([None if x in ("", "NA") else x for x in record] + [None] * (columns - len(record)))
    return out


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_csv_rows_in_any_split(spark, tmp_path, split):
    rng = random.Random(split)
    parts = ["a", "NA", "", "5\" disk", '"x,y"', '"say ""no"""', '"two\nlines"', '"three\n\n""lines"",\n"', "é", '"\n"', '"' + "long " * 40 + '"', "z"]
    texts = {}
    for name, encoding in (("one", "utf-8"), ("two", "latin-1"), ("three", "utf-8")):
        lines = ["p,q,r"] + [",".join(rng.choice(parts) for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))) if rng.random() < 0.95 else "" for _ in range(300)]
        texts[name] = "\n".join(lines) + ("\n" if name != "three" else "")
        (tmp_path / f"{name}.csv").write_bytes(texts[name].encode(encoding))
    (tmp_path / "head.csv").write_text("p,q,r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = defaultdict(list)
        for r in read_csv_rows(spark, str(tmp_path), "p string, q string, r string").collect():
            got[r.source_file.rsplit("/", 1)[1][:-4]].append((r.row_no, [r.p, r.q, r.r]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(got) == set(texts)
    for name, text in texts.items():
        assert [r for _, r in sorted(got[name])] == plain_rows(text, 3) and sorted(n for n, _ in got[name]) == list(range(len(got[name])))


def test_csv_types_and_carriage_returns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'n,x\r\n1,"a\r\nb"\r\nbad,NA\r\n\r\n3\r\n4,5,6\r\n')
    got = sorted((r.row_no, r.n, r.x) for r in read_csv_rows(spark, str(tmp_path), "n int, x string").collect())
    assert got == [(0, 1, "a\r\nb"), (1, None, None), (2, 3, None)]
    assert csv_records(spark, str(tmp_path)).count() == 6


def test_line_states(spark):
    cases = {"a,b": (0, 1), '"a': (1, 0), 'a"b,c': (0, 0), '"a""b': (1, 0), '"a",b"c': (0, 1), 'x,"': (1, 0), '""': (0, 1), "": (0, 1), '","': (0, 1), '",x': (1, 0), '" "b,"c': (1, 1)}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", *(c.alias(n) for c, n in zip(line_states(F.col("t")), "xy", strict=True)))
    got = {r.t: (r.x, r.y) for r in df.collect()}
    for line, (outside, inside) in cases.items():
        states = []
        for prefix in ("", '"'):
            # a plain automaton: field start, unquoted, quoted, quote seen
            state = "start" if not prefix else "quoted"
            for c in line:
                if state == "quoted":
                    state = "seen" if c == '"' else "quoted"
                elif state == "seen":
                    state = "quoted" if c == '"' else "start" if c == "," else "plain"
                elif state == "start" and c == '"':
                    state = "quoted"
                else:
                    state = "start" if c == "," else "plain"
            states.append(int(state == "quoted"))
        assert got[line] == tuple(states), line


def test_audit_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,label\nx,0\n"y\ny",1\nx,1\n')
    (tmp_path / "b.csv").write_text("k,label\nx,1\nz,0\n")
    rows = read_csv_rows(spark, str(tmp_path), "k string, label int").withColumn("file", F.element_at(F.split("source_file", "/"), -1))
    got = {r.k: tuple(r)[1:] for r in integrity.dedup_index(rows, "k", ["file", "row_no"], "label", ["file", "row_no"]).collect()}
    assert got == {"x": (0, "a.csv", 0, 2, 1), "y\ny": (1, "a.csv", 1, 0, 0), "z": (0, "b.csv", 1, 0, 0)}


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([(c, r, i) for c in (1, 2) for r in (0, 1) for i in range(3)], "cell int, round int, v int")
    files.append_once(batch, path, ["cell", "round"])
    files.append_once(batch, path, ["cell", "round"])
    files.append_once(batch.where("cell = 1"), path, ["cell", "round"])
    files.append_once(spark.createDataFrame([(3, 0, 9)], batch.schema), path, ["cell", "round"])
    assert sorted(map(tuple, spark.read.parquet(path).select(*batch.columns).collect())) == sorted([*map(tuple, batch.collect()), (3, 0, 9)])


def test_built_once(spark, tmp_path):
    source, root, built = tmp_path / "in", str(tmp_path / "cache"), []
    spark.range(5).write.parquet(str(source))

    def make():
        built.append(1)
        return spark.read.parquet(str(source))

    def get(columns, version="1"):
        return files.built_once(spark, root, files.signature(files.file_manifest(spark, str(source), "part-*"), columns, version), make)

    assert get(["id"]).count() == get(["id"]).count() == 5 and len(built) == 1
    get(["id", "x"])
    get(["id"], "2")
    assert len(built) == 3
    key = files.signature(files.file_manifest(spark, str(source), "part-*"), ["id"], "1")
    part = next(p for p in (tmp_path / "cache" / key).glob("*/part-*.parquet"))
    crc = part.with_name(f".{part.name}.crc")
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    crc.unlink(missing_ok=True)
    assert get(["id"]).count() == 5 and len(built) == 4  # a changed byte: built anew
    part = next(p for p in (tmp_path / "cache" / key).glob("*/part-*.parquet") if p != part)
    part.unlink()
    assert get(["id"]).count() == 5 and len(built) in (4, 5)
    spark.range(5, 7).write.mode("append").parquet(str(source))
    assert get(["id"]).count() == 7


def test_group_aucs(spark):
    rng = random.Random(5)
    rows = [(a, g, rng.randrange(2) if g else 1, rng.randrange(6) / 6) for a in ("m", "n", "o") for g in range(4) for _ in range(30)]
    got = privacy.group_aucs(spark.createDataFrame(rows, "attacker string, g int, y int, p double"), ["attacker"], "g")
    want = {}
    for a in ("m", "n", "o"):
        for g in range(4):
            pos, neg = ([r[3] for r in rows if r[:3] == (a, g, y)] for y in (1, 0))
            want[a, g] = sum((x > z) + (x == z) / 2 for x in pos for z in neg) / len(pos) / len(neg) if pos and neg else None
    assert {(r.attacker, r.g): r.auc for r in got.collect()} == pytest.approx(want)
    tied = got.unionByName(got.where("attacker = 'm'").withColumn("attacker", F.lit("a")))
    for r in privacy.worst_attackers(tied, "attacker", ["g"]).collect():
        best = max((want[a, r.g] or 0) for a in "mno") or None
        first = None if best is None else min("a" if a == "m" else a for a in "mno" if want[a, r.g] == best)
        assert (r.auc, r.attacker) == (best, first) and r.tied == (0 if best is None else sum(want[a, r.g] == best for a in "mmno"))
    steps = sorted((r.auc, r.groups, r.share) for r in privacy.auc_distribution(got, []).collect())
    known = sorted(x for x in want.values() if x is not None)
    assert steps == [(x, sum(y <= x for y in known), sum(y <= x for y in known) / len(known)) for x in sorted(set(known))]


def test_roc_without_collinear_points(spark):
    rng = random.Random(2)
    rows = [(c, int(rng.random() < p) if c < 3 else 1, p) for c in range(4) for p in (rng.randrange(40) / 40 for _ in range(120))]
    got = defaultdict(list)
    for r in metrics.curves(spark.createDataFrame(rows, "cell_id int, y int, p double"), collinear=False).where("curve = 'ROC'").orderBy("i").collect():
        got[r.cell_id].append((r.x, r.y, r.threshold))
    for c in range(4):
        own = [(p, y) for k, y, p in rows if k == c]
        n1, n0 = sum(y for _, y in own), sum(1 - y for _, y in own)
        points = [(sum(y for p, y in own if p >= t), sum(1 - y for p, y in own if p >= t), t) for t in sorted({p for p, _ in own}, reverse=True)]
        bent = [b for i, b in enumerate(points) if i in (0, len(points) - 1) or any(points[i - 1][k] + points[i + 1][k] != 2 * b[k] for k in (0, 1))]
        assert got[c] == [(0.0, 0.0, None)] + [(f / n0 if n0 else 0.0, t / n1 if n1 else 0.0, p) for t, f, p in bent]
        assert c == 3 and len(bent) < len(points) or c < 3


@pytest.mark.parametrize("lines", [1, 3])
def test_csv_rows_in_blocks_of_few_lines(spark, tmp_path, monkeypatch, lines):
    """No window holds more than a block's lines; blocks of a split go on where the last one ended."""
    from tidemark.sources import csv_rows

    monkeypatch.setattr(csv_rows, "LINES", lines)
    monkeypatch.setattr(csv_rows, "NUMBERED_TOGETHER", 2)
    test_csv_rows_in_any_split(spark, tmp_path, "1g")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.csv").write_text("p,q,r\n" + "a,b,c\n" * 40)
    blocks = []
    monkeypatch.setattr(csv_rows, "_after", lambda df, *keys, after=csv_rows._after: (blocks.append(after(df, *keys)), blocks[-1])[1])
    csv_records(spark, str(tmp_path / "plain"))
    assert max(r["count"] for r in blocks[0].groupBy("source_file", "block", "piece").count().collect()) <= lines
