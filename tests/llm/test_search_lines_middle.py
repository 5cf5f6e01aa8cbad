"""Ranked search, line dedup and fill-in-middle against plain versions; edge cases of every input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from docweave.llm import fill_middle, lexical, line_dedup, oracles, registry  # noqa: E402

SCHEMA = "doc_id long, text string, shard long, term string, score string, output string, form string, row long"


def docs_of(spark, rows, parts=3):
    """(doc_id, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "x", "y", "z", "psm", -1) for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_line_dedup", "op13_fill_middle"])
def test_queries_equal_their_sql(spark, data, name):
    got = registry.queries()[name](spark, data)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = con.sql(oracles.SQL[name])
    assert sorted(rel.columns) == sorted(got.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rel.select(", ".join(columns)).fetchall(), key=repr)


# --- 11 --------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, queries, k):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = {}
    asked = defaultdict(list)
    for q, t in queries:
        asked[q] += terms(t)
    for q, ts in asked.items():
        found = []
        for i, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(q, r + 1): (None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])}
    return out


def corpus(r, n=300):
    words = ["".join(r.choice("abcdeÉß漢") for _ in range(r.randint(1, 3))) for _ in range(150)]
    return words, [(r.randrange(n), " ".join(r.choice(words) for _ in range(int(r.paretovariate(0.8)) % 400))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes", [1, 2_000, 10**9])
def test_search_equals_a_plain_scan(spark, monkeypatch, shard_bytes):
    r = random.Random(shard_bytes)
    words, docs = corpus(r)
    docs += [(None, "ab Cd"), (None, "ab Cd"), (900, None), (901, ""), (902, "... !"), (903, "Ab.CD-ab_é\x00É x1"), (904, "ab " * 50_000), (905, "q" * 5000)]
    queries = [(q % 30, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for q in range(33)] + [(50, None), (51, "nowhere"), (52, "AB ab cd"), (53, "ab " * 400), (None, "cd")]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    index = lexical.Index(docs_of(spark, docs, 4), shard_bytes=shard_bytes)
    rows = index.search(spark.createDataFrame(queries, "query_id long, text string"), 7).collect()
    assert len(rows) == len({(x.query_id, x["rank"]) for x in rows})
    assert {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in rows} == plain_search(docs, queries, 7)
    assert index.table.filter("term IS NOT NULL").groupBy("shard", "term").count().filter("count > 1").count() == 0
    index.drop()


def test_sums_over_doubles_stay_exact(spark):
    docs = [(1, "ab"), (2, "ab cd"), (3, "cd")]
    queries = [(1, "ab " * 400_000)]
    rows = lexical.Index(docs_of(spark, docs)).search(spark.createDataFrame(queries, "query_id long, text string"), 3).collect()
    assert {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in rows} == plain_search(docs, queries, 3)
    shard = {"ids": [1], "lengths": [1], "n": 3, "l": 4}
    heaps = lexical._Heaps(2)
    lexical._score([{"w": 2**20 - 1, "postings": bytes([0, 1]), "queries": [{"query_id": 1, "times": 10**4 + 1}]}], shard, heaps)
    m = 75 + 25 * 3 // 4
    assert list(heaps.rows()) == [(1, 1, (2**20 - 1) * (10**9 // (1000 + 12 * m)) * (10**4 + 1))]


def test_empty_tables_have_no_ranks(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "ab")], "query_id string, text string")
    assert lexical.Index(none).search(asked, 5).collect() == []
    assert lexical.Index(docs_of(spark, [(1, "ab")])).search(asked.limit(0), 5).collect() == []
    assert [tuple(x) for x in lexical.Index(docs_of(spark, [(1, "ab"), (2, "cd ef")])).search(asked, 5).select("query_id", "rank", "doc_id").collect()] == [("a", 1, 1)]


def test_postings_pack_and_unpack():
    r = np.random.default_rng(1)
    v = np.concatenate([[0, 1, 127, 128, 16383, 16384, 2**40, 2**62], r.integers(0, 300, 1000)])
    data, ends = lexical.packed(v)
    assert (lexical.unpacked(data.tobytes()) == v).all() and ends[-1] == len(data)
    assert len(lexical.unpacked(b"")) == 0


# --- 12 --------------------------------------------------------------------------------------------------


def plain_dedup(docs, chars, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    order = lambda i: (i is not None, i or 0)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                held[key(x)].add(i)
    last = {k: max(v, key=order) for k, v in held.items() if len(v) >= least}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_equal_a_plain_count(spark):
    r = random.Random(5)
    lines = [r.choice(["", " ", "\t\x0b"]) + w + r.choice(["", "\r", "  ", "\x85"]) for w in ("".join(r.choice("abÀ漢 ") for _ in range(r.randint(6, 12))) for _ in range(40))]
    docs = [(r.randrange(60), "\n".join(r.choice([str.upper, str])(r.choice(lines)) for _ in range(r.randint(0, 9)))) for _ in range(90)]
    docs += [(None, lines[0]), (None, lines[0] + "\n" + lines[1]), (100, None), (101, ""), (102, "\n"), (103, "\n\n" + lines[2] + "\n")]
    got = line_dedup.dedup_lines(docs_of(spark, docs), min_chars=8, min_docs=4)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_dedup(docs, 8, 4)


def test_a_hot_line_and_a_text_of_many_lines(spark):
    banner = "This very line stands in every single document of the table"
    docs = [(i, f"{banner}\nown line number {i} of a document, of forty points or more\n  {banner.upper()}\r") for i in range(400)]
    docs.append((1000, "\n".join([banner, "short"] * 30_000)))
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs_of(spark, docs, 8)).collect()}
    assert all(got[i].n_dropped == 2 and got[i].text.startswith("own line") for i in range(400))
    assert got[1000].n_dropped == 0 and got[1000].n_lines == 60_000 and got[1000].text == docs[-1][1]
    docs[-1] = (-1, docs[-1][1])
    first = {x.doc_id: x for x in line_dedup.dedup_lines(docs_of(spark, docs, 8)).collect()}
    assert first[-1].n_dropped == 30_000 and first[-1].text == "\n".join(["short"] * 30_000) and first[399].n_dropped == 0


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(docs_of(spark, []).limit(0)).collect() == []


def test_line_dedup_runs_no_python(spark, data):
    plan = line_dedup.op12_line_dedup(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 13 --------------------------------------------------------------------------------------------------


def units_of(text, unit):
    if unit == "code_point":
        return list(text)
    at = {"word": r"(?<=[ \t-\r])(?![ \t-\r])", "line": r"(?<=\n)"}[unit]
    return [x for x in re.split(at, text) if x]


def plain_cut(doc_id, text, unit, plain, spm, seed):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    text = text or ""
    u = units_of(text, unit)
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["code_point", "word", "line"])
@pytest.mark.parametrize("step", [1, 60, 4_000_000])
def test_cuts_equal_plain_ones(spark, unit, step):
    r = random.Random(step)
    docs = [(r.randrange(500), "".join(r.choice("ab <>PSM\n\té漢😀") for _ in range(r.randint(0, 40)))) for _ in range(250)]
    docs += [(None, "no id é"), (1, None), (2, ""), (3, "<"), (4, "a<P>b"), (5, "<M>"), (6, "<P"), (7, "S>"), (8, "é" * 70_000), (8, "é"), (9, "\n\n"), (10, "  a")]
    made = fill_middle.transform(docs_of(spark, docs), unit=unit, plain_percent=80, spm_percent=40, seed="s", step=step)
    rows = fill_middle.restore(made, step=step).collect()
    assert sorted((tuple(x)[:6] for x in rows), key=repr) == sorted((plain_cut(i, t, unit, 80, 40, "s") for i, t in docs), key=repr)
    assert sorted(((x.doc_id, x.restored) for x in rows), key=repr) == sorted(((i, t or "") for i, t in docs), key=repr)
    assert {x.form for x in rows} == {"plain", "psm", "spm"}


def test_middle_of_an_empty_table_and_of_an_unknown_unit(spark):
    assert fill_middle.restore(fill_middle.transform(docs_of(spark, []).limit(0))).collect() == []
    with pytest.raises(KeyError):
        fill_middle.transform(docs_of(spark, [(1, "a")]), unit="page")
    same = docs_of(spark, [(1, "abc def")] * 3)
    assert len(set(map(tuple, fill_middle.transform(same, plain_percent=100).collect()))) == 1
    assert fill_middle.transform(same, plain_percent=0).filter(F.col("form") != "plain").count() == 0
