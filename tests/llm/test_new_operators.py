"""Operators 11 to 13: templates and round trips, phrases and intervals against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.chat import CHAT_TEMPLATE, chat_digests, format_chats, read_chats
from tidemark.llm.chat_template import Const, TemplateError, Text, Write, compile_template, escape, escape_line, fold, parse, unescape, unescape_line
from tidemark.llm.collocations import collocations
from tidemark.llm.intervals import OPEN, Containment, RELATIONS, click_sessions, sales_by_sessions
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op12_collocations", "op13_interval_overlap"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "documents", "sales", "sale_lines", "clicks"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(found.fetchall(), key=key) != []


# Templates

def render(source, **variables):
    return compile_template(source)(**variables)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"),
        ("{{ 'x' ~ 4 }}{{ \"}}\" }}", "x4}}"),
        ("{% for x in xs %}{{ loop.index0 }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "0p,1q"),
        ("{% if n > 3 %}big{% elif n == 2 %}two{% else %}other{% endif %}", "two"),
        ("{% if n == 1 %}a{% elif n == 5 %}b{% elif n == 2 %}c{% endif %}", "c"),
        ("  {%- set y = n * 4 -%}  {{ y }}", "8"),
        ("{{ m.role }}{{ m['role'] }}{{ m.none_such }}{{ nothing }}", "uu"),
        ("{{ xs | join('-') | upper }}{{ xs | length }}{{ xs[0] }}{{ xs | last }}", "P-Q2pq"),
        ("{{ 'a' if n in [1, 2] else 'b' }}{{ nothing | default('d') }}{{ 'p' in xs and n is defined }}", "adtrue"),
        ("{{ nothing or 'z' }}{{ not nothing }}{{ 'r' not in xs }}{{ nothing is not defined }}", "ztruetruetrue"),
        ("{# a comment #}{{ n // 2 }}{{ 7 % 4 }}{{ 5 - 3 - 1 }}", "131"),
        ("", ""),
    ],
)
def test_template_language(source, text):
    assert render(source, xs=["p", "q"], n=2, m={"role": "u"})[0] == text


@pytest.mark.parametrize("source", ["{{ a", "{% if a %}", "{% for x %}{% endfor %}", "{{ a | none_such }}", "{{ a.__class__( ) }}", "{% endfor %}", "{{ a b }}", "{% include 'x' %}", "{{ f(1) }}", "{{ 'a' + }}"])
def test_not_in_the_language(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_sandbox():
    assert render("{{ a.__class__ }}{{ a['__class__'] }}{{ a.upper }}", a="text")[0] == ""
    for source in ("{{ 'a' * 9 }}", "{{ 1 + 'a' }}", "{{ xs }}", "{% for c in 'abc' %}{% endfor %}x{% for c in n %}{% endfor %}"):
        with pytest.raises(TemplateError):
            render(source, xs=[1], n=3)


def test_constants_are_folded():
    assert fold(parse("a{{ 1 + 1 }}{% if 2 > 1 %}b{{ 'c' | upper }}{% else %}{{ x }}{% endif %}{% for y in none %}z{% endfor %}")) == (Text("a2bC"),)
    assert fold(parse("{{ x ~ ('a' ~ 'b') }}"))[0].value.args[1] == Const("ab")
    assert isinstance(fold(parse("{{ 1 + 'a' }}"))[0], Write)  # fails when it is rendered, not before


def test_generation_spans():
    text, spans = render("é{% generation %}a{% generation %}b{% endgeneration %}{% endgeneration %}c{% generation %}{% endgeneration %}{% generation %}d{% endgeneration %}")
    assert text == "éabcd" and spans == [(1, 3), (4, 5)]


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "<<|", "a\\nb\n", "<", "|", "\\", "<|im_end|><|im_start|>assistant ok", "\\\n\\n<\\|"])
def test_escapes_round_trip(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert unescape_line(escape_line(text)) == text and "\n" not in escape_line(text)


def test_chats_round_trip(spark):
    rng = random.Random(3)
    parts = ["<|im_end|>", "<|", "\\", "|", "<", "\n", "é😀", "assistant", " ", "<|im_start|>user\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|"]), rng.choice([None, "", "".join(rng.choices(parts, k=12))]), "x") for c in [1, 2, 3, None] for t in range(6)]
    rows += [rows[0], (9, None, "assistant", "z" * 100_000, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rows string")
    want = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want[c].append((role or "", text or ""))
    formatted = format_chats(df)
    texts = {r.conv_id: r for r in formatted.collect()}
    got = {r.conv_id: r for r in read_chats(formatted).collect()}
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == want
    for c, turns in want.items():
        assert "".join(got[c].learned) == "".join(x for role, x in turns if role == "assistant")
        assert texts[c].text.count("<|im_end|>") == texts[c].text.count("<|im_start|>") == len(turns)
    digest = {r.conv_id: r for r in chat_digests(formatted).collect()}
    for c, turns in want.items():
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in turns).encode()).hexdigest()
        assert digest[c].formatted_chars == len(texts[c].text) and digest[c].n_turns == len(turns)
    assert format_chats(df.limit(0)).count() == 0
    with pytest.raises(TemplateError):
        format_chats(df, "{% if %}")
    other = format_chats(df.where("conv_id = 9"), CHAT_TEMPLATE.replace("<|im_start|>", "[").replace("<|im_end|>", "]")).first()
    assert other.text == "[assistant\n" + "z" * 100_000 + "]\n" and other.spans[0].start == 11


# Phrases

def mined(rows, min_count, longest, top, percent):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    candidates = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    for (lang, p), a in candidates.items():
        if any(x[0] == lang and len(x[1]) > len(p) and 100 * b >= percent * a and any(x[1][i : i + len(p)] == p for i in range(len(x[1]))) for x, b in candidates.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("longest", "top", "percent", "few"), [(5, 2000, 100, 1 << 19), (3, 7, 60, 0), (2, 5, 100, 1 << 19), (5, 2000, 100, 0), (4, 50, 100, 60)])
def test_phrases_equal_brute_force(spark, monkeypatch, longest, top, percent, few):
    monkeypatch.setattr("tidemark.llm.collocations.FEW_NAMES", few)  # 0: always joined, never broadcast; 60: joined after the words
    rng = np.random.default_rng(longest)
    vocabulary = ["a", "B", "cé", "\x00d", "e f", "ẞ", "g-h", "(i)", "Ä", "k" * 300]
    texts = ["".join(rng.choice(vocabulary, p=np.arange(10, 0, -1) / 55) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ! "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, [None, "und", "en", ""][i % 4], "x") for i, t in enumerate(texts)] + [(90, None, "en", None), (91, "", None, None), (92, " \n.. ", "fr", None), (1, texts[1], "und", "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, id string").repartition(5)
    got = sorted(tuple(r) for r in collocations(df, 8, longest, top, percent).collect())
    assert got == mined([(r[1], r[2]) for r in rows], 8, longest, top, percent) != []
    assert collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    from tidemark.llm.collocations import _scored

    table = spark.createDataFrame([("en", 1, "a b", 3 * 10**12, [7 * 10**12, 3 * 10**12], [5 * 10**12, 3 * 10**12])], "lang string, id long, phrase string, f long, heads array<long>, tails array<long>")
    assert _scored(table, spark.createDataFrame([("en", 10**14)], "lang string, n long"), 2).first().score == 1000 * 3 * 10**12 * 10**14 // (35 * 10**24)


# Intervals

def relation(a, b):
    return RELATIONS[3 * ((a[0] >= b[0]) + (a[0] > b[0])) + (a[1] >= b[1]) + (a[1] > b[1])]


@pytest.mark.parametrize("seed", range(6))
def test_containment_lists_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    big, entries, asked = 40, set(), []
    for owner in range(5):
        for _ in range(rng.integers(0, 60)):
            s = int(rng.integers(0, 30))
            entries.add((owner, s, big - 1 if rng.random() < 0.2 else min(38, s + int(rng.integers(0, 12 if seed % 2 else 2)))))
        asked += [(owner, s := int(rng.integers(0, 30)), big - 1 if rng.random() < 0.2 else min(38, s + int(rng.integers(0, 15)))) for _ in range(20)]
    rows = sorted(entries, key=lambda x: (x[0], x[1], -x[2]))
    o, s, e = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
    n, crc = rng.integers(1, 5, len(rows)), rng.integers(0, 1 << 32, len(rows))
    totals = Containment(o, s, e, n, crc, big).probe(*(np.array([q[k] for q in asked], dtype=np.int64) for k in range(3)))
    for i, (owner, qs, qe) in enumerate(asked):
        want = defaultdict(lambda: [0, 0, 0])
        for j, (other, a, b) in enumerate(rows):
            if other == owner and a <= qe and qs <= b:
                w = want[relation((qs, qe), (a, b))]
                w[0] += n[j]
                w[1] += n[j] * (min(b, qe) - max(a, qs) + 1)
                w[2] += crc[j]
        for k, name in enumerate(RELATIONS):
            got = totals[k, :, i].tolist()
            if qe == big - 1 and k % 3 == 1:  # both open: the overlap isn't looked at
                got[1] = want[name][1] if want[name][0] else got[1]
            assert got == [int(x) for x in want[name]]


def test_sessions_and_sales(spark):
    day = datetime(2024, 1, 1)
    minute = lambda m: None if m is None else day + timedelta(minutes=m)
    clicks = [(1, minute(29), 1, "view"), (2, minute(59), 1, None), (3, minute(59), 1, "error"), (4, minute(89.5), 1, "view"), (5, minute(1), None, "error"), (6, None, 1, "error"), (7, minute(0), 2, "error"), (8, minute(-500), 3, "x"), (8, minute(-500), 3, "x")]
    clicks_df = spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long, kind string").withColumn("s", F.lit("a clashing name"))
    got = sorted((r.client_id, r.first, r.last, r.open) for r in click_sessions(clicks_df).collect())
    us = lambda m: int((day - datetime(1970, 1, 1)).total_seconds() * 1e6 + m * 60e6)
    assert got == [(1, us(29), us(59), True), (1, us(89.5), us(89.5), False), (2, us(0), us(0), True), (3, us(-500), us(-500), False)]
    sales = [(10, 1, "done", minute(0)), (10, 1, "done", minute(0)), (11, 2, "open", minute(800)), (12, None, "open", minute(0)), (13, 1, "open", None), (14, 3, None, minute(-500)), (15, 9, "done", minute(0))]
    sales_df = spark.createDataFrame(sales, "sale_id long, client_id long, status string, sold_at timestamp_ntz")
    lines = spark.createDataFrame([(10, minute(400)), (10, None), (14, minute(-9000)), (None, minute(5))], "sale_id long, shipped_at timestamp_ntz")
    crc = lambda m: zlib.crc32(str(us(m)).encode())
    got = sorted(map(tuple, sales_by_sessions(sales_df, lines, clicks_df).collect()))
    assert got == sorted([(10, "starts", 1, 2, crc(29)), (10, "started_by", 1, 1, crc(89.5)), (11, "finishes", 1, None, crc(0)), (14, "equals", 1, 1, crc(-500))])
    for empty in ((sales_df.limit(0), lines, clicks_df), (sales_df, lines, clicks_df.limit(0))):
        assert sales_by_sessions(*empty).count() == 0
    assert sales_by_sessions(sales_df, lines.limit(0), clicks_df).count() == 4
    assert OPEN > us(0)


def test_joined_ids_are_not_gathered_by_an_aggregate(spark):
    """An aggregate's lists of the ids of many blocks are in a task's memory at once; sorted rows are one block's at a time."""
    from tidemark.llm import collocations as co

    level = spark.createDataFrame([(1, "en", ["a", "b"], [2, 1], [0, 1, 0, -1]), (2, "en", ["c"], [1], [0, -1]), (3, "fr", ["a", "b"], [1, 1], [0, 1, -1])], co.WORD_BLOCKS)
    names = spark.createDataFrame([("en", "a", 7), ("en", "b", 9), ("fr", "x", 4)], "lang string, word string, id long")
    joined = co._joined(level, names, co.WORD)
    assert "collect_list" not in joined._jdf.queryExecution().toString()
    assert [(r.block, r.lang, [tuple(x) for x in r["keys"]], r["counts"]) for r in joined.collect()] == [(1, "en", [(7, 9), (9, 7)], [1, 1])]
