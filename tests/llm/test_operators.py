"""The training-data operators against brute force and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from urllib.parse import urljoin

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import text as text_module
from graphloom.llm import chat, components, exact_dedup, packing, partenum, ppm, queries, sharding, site_lines, superkmers, url_filters, winnowing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(rb"[^\x20\x09-\x0D]+")
WORDS = [f"w{i}" for i in range(400)]


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def awkward():
    """Nulls, empty, blank and very long texts, copies, near copies, repeated rows and ids."""
    base = words(1, 60)
    near = base[:30] + ["changed"] + base[31:]
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, "\n\t ".join(base)), (4, " ".join(near)), (5, " ".join(near[:50] + words(9, 4) + near[54:])),
        (6, None), (7, ""), (8, " \n "), (9, "one two"), (10, "one  two"), (11, "One Two"), (12, " ".join(words(2, 6000))), (13, "é ü 日本語 <|endoftext|> x"), (14, "\u00a0 a\u2003b \x1c c"),
        (15, " ".join(words(3, 20) + base[10:40] + words(4, 20))), (15, " ".join(words(3, 20) + base[10:40] + words(4, 20))), (16, "12 34 ... !!"), (None, " ".join(base)), (None, None), (12, "same id other text"),
        (17, "line\nline\nfoot"), (18, "other\nfoot"), (19, "more\nfoot\n\n"), (20, "foot"), (21, "last\n foot "),
    ]
    return [(i, t, "en" if i and i % 2 else None, "s", len(t) if t is not None else None) for i, t in rows]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(awkward(), DOCS).withColumns({"id": F.lit(1), "row": F.lit("x"), "key": F.lit(2.5), "component": F.lit(None).cast("string"), "ranges": F.lit(0), "digest": F.lit("d"), "host": F.lit("h")}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == sorted(want.select(", ".join(got.columns)).fetchall(), key=repr)


# 1. URL filters.


def test_hosts_and_rules(spark):
    urls = ["http://A.Example.com/en/x", "https://www.example.com/en/y?q#f", "http://x.net/es/1", "http://net/fr/", "http://com?x", "http://notcom/", "http://example.com/de/", "nope", None, "", "x://", "http://www.example.com", "http://a.com://b/c"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["id"]: r for r in url_filters.judge(pages).collect()}
    assert [got[i]["rule"] for i in range(13)] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, "com/", None, None, None, None, None, None]
    assert [got[i]["verdict"] for i in range(9)] == ["block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert (got[0]["host"], got[0]["path"], got[1]["path"], got[8]["host"]) == ("a.example.com", "/en/x", "/en/y", "")


def test_blocks_spread_over_aliases_unless_allowed(spark):
    rules = (url_filters.Rule("bad.org", "/", False), url_filters.Rule("good.org", "/", True))
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/y#frag"), (3, "http://c.org/"), (4, "http://d.org/"), (5, "http://bad.org/1"), (6, None), (7, "http://good.org/2"), (1, "http://a.org/x")], "page_id long, url string")
    edges = spark.createDataFrame([("http://a.org/x", "http://t.org/"), ("http://t.org/", "http://bad.org/q"), ("http://b.org/y", "http://a.org/x"), ("http://c.org/", "http://bad.org/2"), ("http://good.org/z", "http://c.org/"), ("http://d.org/", None), (None, None), ("http://d.org/", "http://d.org/")], "a string, b string")
    got = sorted((r["id"] or 0, r["verdict"]) for r in url_filters.judge(pages, edges, rules=rules).collect())
    assert got == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "block"), (6, "allow"), (7, "allow")]
    html = spark.createDataFrame([("http://a.org/1#x", '<link href="http://b.org/1" rel="canonical">'), ("http://c.org/", '<META HTTP-EQUIV="refresh" content="0; url=http://d.org/z">'), ("http://e.org/", "<p>canonical</p>"), (None, '<link rel=canonical href=http://q.org/>'), ("http://f.org/", None)], "url string, html string")
    assert bag(url_filters.alias_edges(html)) == [("http://a.org/1", "http://b.org/1"), ("http://c.org/", "http://d.org/z")]
    assert bag(url_filters.judge(pages.limit(0), edges)) == []


def test_relative_targets_are_resolved(spark):
    """Against Python's urljoin; a page without a rule is blocked by a relative canonical link to a blocked path."""
    bases = ["http://A.net/d/e/f?q=1#z", "https://a.net", "http://a.net/d/", "http://a.net/x"]
    targets = ["/es/x", "//B.net/y?z", "g", "g/../h?a=/../b", "../g", "../../../g", "./", "..", "?k=v", "/", "/a/./b/../c", "https://c.org/1", "/go?u=http://d.org/", "g;p=1"]
    pairs = [(a, b) for a in bases for b in targets]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", url_filters.resolved(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r for r in got if r["r"] != urljoin(r["a"], r["b"])] == []
    odd = spark.createDataFrame([("http://a.net/d/e", "x//y"), ("http://a.net/", "mailto:x@y.z"), ("http://a.net/", "javascript:void(0)"), ("nope", "/x"), ("nope", "http://a.net/x")], "a string, b string")
    assert [r["r"] for r in odd.select(url_filters.resolved(F.col("a"), F.col("b")).alias("r")).collect()] == ["http://a.net/d/x//y", None, None, None, "http://a.net/x"]
    pages = [
        (1, "http://x.net/a", '<link rel="canonical" href="/es/x">'), (2, "http://y.org/a", '<link rel="canonical" href="//x.net/fr/z">'), (3, "http://x.net/d/e", '<meta http-equiv="refresh" content="0; url=../es/y">'),
        (4, "http://x.net/b", '<base href="http://w.net/es/"><link rel="canonical" href="q">'), (5, "http://x.net/c", '<link rel="canonical" href="/ok">'), (6, "http://x.net/e", '<link rel="canonical" href="mailto:a@x.net">'), (7, "http://x.net/f#g", '<link rel="canonical" href="#top">'),
    ]
    out = url_filters.url_report(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r["page_id"]: r["verdict"] for r in out.collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}


def test_any_number_of_rules(spark):
    """A table of rules gives what an expression of them gives; many hosts, suffixes, nested paths and ties."""
    r = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "org", "a.b.c.d.org", "d.org"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/fr/y/z", "/e"]
    rules = [url_filters.Rule(h, p, r.random() < 0.5) for h in hosts for p in paths if r.random() < 0.7]
    urls = [f"http://{s}{h}{p}{t}" for h in hosts for s in ("", "www.", "q.w.", "not") for p in paths for t in ("", "x", "?q", "/k")] + [None, "", "x", "http://", "http://."]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    table = spark.createDataFrame([(x.host, x.path, x.allow) for x in rules] + [(None, "/", True), ("com", None, True)], "host string, path string, allow boolean")
    want = bag(url_filters.judge(pages, rules=tuple(rules)))
    assert bag(url_filters.judge(pages, rules=table).select(*url_filters.judge(pages).columns)) == want and len(want) == len(urls)
    many = [(f"h{i}.com", "/", i % 2 == 0) for i in range(100_000)]
    got = url_filters.judge(spark.createDataFrame([(1, "http://h7.com/"), (2, "http://a.h8.com/x"), (3, "http://h8.org/")], "page_id long, url string"), rules=tuple(url_filters.Rule(*x) for x in many))
    assert sorted((x["id"], x["rule"], x["verdict"]) for x in got.collect()) == [(1, "h7.com/", "block"), (2, "h8.com/", "allow"), (3, None, "allow")]


def test_all_tags_of_a_page_count(spark):
    html = [
        (1, "http://a.org/1", '<link rel="cANONICAL" href="http://x.net/es/1">'), (2, "http://a.org/2", '<link rel=canonical href="http://ok.org/?a=1&amp;b=2"><LINK REL="canonical" HREF="/fr2"> <meta http-equiv=refresh content="0;url=http://x.net/fr/">'),
        (3, "http://ok.org/?a=1&b=2", None), (4, "http://a.org/4", '<link rel="nofollow canonical" href="http://x.net/es/4">'), (5, "http://a.org/5", '<link rel="alternate" href="http://x.net/es/4">canonical'), (6, None, "canonical"),
    ]
    out = url_filters.url_report(spark.createDataFrame(html, "page_id long, url string, html string"))
    assert {r["page_id"]: r["verdict"] for r in out.collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}


def test_allowed_pages_are_kept(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/1", "k"), (2, "http://x.net/q", "k"), (2, "http://x.net/q", "k"), (None, "http://a.com/", "k"), (3, None, None)], "page_id long, url string, rule string")
    assert sorted(r["id"] or 0 for r in url_filters.keep_allowed(pages).collect()) == [0, 2, 2, 3]
    assert url_filters.keep_allowed(pages.limit(0)).count() == 0


def test_chains_go_in_logarithmic_rounds(spark):
    """In the order of names, against it, and in a tree of depth 600."""
    n = 10_000
    made = components.rounds(spark.range(n - 1).selectExpr("id as a", "id + 1 as b"))
    assert len(made) <= 20
    edges = spark.range(600).selectExpr("id as a", "id + 1 as b").union(spark.range(600).selectExpr("2000 - id", "1999 - id")).union(spark.range(600).selectExpr("id", "id + 5000"))
    got = components.connected_components(edges)
    assert got.groupBy("component").count().collect() is not None
    assert sorted(map(tuple, got.groupBy("component").count().collect())) == [(0, 1201), (1400, 601)]


def test_components_against_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100, i) for i in range(101, 150)] + [(i, i + 1) for i in range(200, 240)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    for held in (3, 12, 40, 1000):  # one task closes what few edges are left
        closed = components.connected_components(spark.createDataFrame([(-b if b else b, -a if a else a) for a, b in edges], "a long, b long"), task_edges=held)
        groups = defaultdict(set)
        for x, c in closed.collect():
            groups[c].add(x)
        want = defaultdict(set)
        for x in parent:
            want[find(x)].add(-x)
        assert sorted(groups.items()) == sorted((min(v), v) for v in want.values())
    assert components.connected_components(spark.createDataFrame([(4, 4), (None, 1)], "a long, b long"), task_edges=9).count() == 0


# 2. Sharding.


def test_shards_fit_and_only_large_ones_split(spark, rows, none):
    docs = spark.createDataFrame([(i, "x" * (1 + i % 50)) for i in range(3000)] + [(9999, "y" * 5000)] + [(7, "z" * 40)] * 60, "doc_id long, text string")
    got = sharding.shard(docs, limit_bytes=2000).collect()
    assert len(got) == 3061
    size, count = {}, Counter()
    for r in got:
        size[r["shard"]] = r["shard_bytes"]
        count[r["shard"]] += 1
    assert all(b <= 2000 or b == 5000 and count[s] == 1 for s, b in size.items())
    assert sum(b for b in size.values()) == sum(1 + i % 50 for i in range(3000)) + 5000 + 2400
    plain = {s for s in size if "." not in s}
    assert not any(a != b and b.startswith(a) for a in plain for b in plain)
    for s in plain:  # a parent that would have fitted was not split
        if s and "." not in s:
            assert sum(b for t, b in size.items() if t.startswith(s[:-1])) > 2000
    assert {r["shard"] for r in sharding.shard(rows).collect()} == {""} and sharding.shard(rows).count() == 25
    assert sharding.shard(none).count() == 0


def test_rows_of_one_key_fit_too(spark, tmp_path):
    """Unequal texts under a key, dealt over the partitions in a row that puts long ones together; rows longer than the limit stand alone."""
    texts = ["z" * (1900 if i % 4 == 0 else 1 + i % 90) for i in range(800)] + ["y" * 2001, "y" * 7000, None, ""]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, t) for t in texts[:200]] + [(i, "x" * 100) for i in range(100, 400)], "doc_id long, text string").repartition(3)
    size, rows = Counter(), Counter()
    got = sharding.shard(docs, limit_bytes=2000).join(docs.groupBy("doc_id").count(), F.col("key").eqNullSafe(F.col("doc_id"))).collect()
    assert len(got) == 1304
    said = {r["shard"]: (r["shard_bytes"], r["shard_rows"]) for r in got}
    back = sharding.write_shards(docs, str(tmp_path / "s"), limit_bytes=2000)
    assert bag(back.select("doc_id", "text")) == bag(docs)
    for r in back.collect():
        size[r["shard"]] += len(r["text"] or "")
        rows[r["shard"]] += 1
    assert any("." in s for s in said) and any("." in s for s in size)
    assert all(b <= 2000 or n == 1 for b, n in said.values()) and all(b <= 2000 or rows[s] == 1 for s, b in size.items())
    assert Counter(r["shard"] for r in got) == Counter({s: n for s, (_, n) in said.items()})
    assert sum(b for b, _ in said.values()) == sum(size.values()) == sum(len(t or "") for t in texts + texts[:200]) + 30_000


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 30) for i in range(100)], "doc_id long, text string")
    back = sharding.write_shards(docs, str(tmp_path / "s"), limit_bytes=600)
    named = docs.limit(30).withColumns({"shard": F.lit("mine"), "row_": F.lit(1), "key": F.lit(None).cast("string")})
    again = sharding.write_shards(named, str(tmp_path / "n"), limit_bytes=100)
    assert bag(again.select(named.columns)) == bag(named) and again.select("shard_").distinct().count() > 4
    assert sharding.write_shards(docs.limit(0), str(tmp_path / "e")).count() == 0
    assert back.count() == 100 and max(r["b"] for r in back.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).collect()) <= 600


# 3. Line dedup.


def test_boilerplate(rows, none):
    out = site_lines.drop_boilerplate(rows.where("doc_id >= 17"), min_pages=3, max_ratio=0.5).select("doc_id", "text", "n_lines", "n_dropped")
    assert bag(out) == [(17, "line\nline", 3, 1), (18, "other", 2, 1), (19, "more\n\n", 4, 1), (20, "", 1, 1), (21, "last", 2, 1)]
    assert site_lines.drop_boilerplate(none).count() == 0
    whole = site_lines.drop_boilerplate(rows)
    assert whole.count() == 25 and whole.where("text is null").count() == 2
    clashing = rows.withColumns({"__host": F.lit(1), "host_": F.lit(2), "lines_": F.lit(3)})
    assert site_lines.drop_boilerplate(clashing, counts=False).columns == clashing.columns
    nulls = rows.withColumn("source", F.lit(None).cast("string"))
    assert bag(site_lines.drop_boilerplate(nulls.where("doc_id >= 17"), min_pages=3, max_ratio=0.5).select("text")) == bag(out.select("text"))


# 4. Language ID.


def test_languages(spark, rows, none):
    docs = files(spark, "documents")
    got = ppm.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    model = ppm.train(docs)
    out = {r["id"]: r for r in ppm.identify(rows.where("doc_id in (6, 7, 8, 16, 13)"), model).collect()}
    assert [out[i]["lang"] for i in (6, 7, 8, 16)] == ["und"] * 4 and out[13]["lang"] != "und" and out[6]["score"] == 0
    assert ppm.identify(none, model).count() == 0
    empty = ppm.train(none)
    assert {r["lang"] for r in ppm.identify(rows, empty).collect()} == {"und"}
    kept = ppm.keep_identified(rows, model)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} & {6, 7, 8, 16} == set()


def test_signs_beyond_ascii_are_no_letters(spark):
    """However many there are; letters of any script are."""
    model = ppm.train(files(spark, "documents"))
    signs = [c * n for c in "\u2014\u2022\u2605\U0001f600\u3002\u0663\u00bd" for n in (1, 7, 8, 9, 5000)] + ["\u2014 12 \u2022\u2022\u2022 34 \u2605\u2605\u2605\u2605\u2605"]
    letters = ["\u65e5" * 9, "\u00e9" * 8, "\u00aa", "\u2605" * 5000 + "\u0436", "\u2014" * 9 + "a", "\u0627" * 3]
    docs = spark.createDataFrame(list(enumerate(signs + letters)), "doc_id long, text string")
    got = {r["id"]: r for r in ppm.identify(docs, model).collect()}
    assert [(got[i]["lang"], got[i]["score"]) for i in range(len(signs))] == [("und", 0)] * len(signs)
    assert all(got[len(signs) + i]["lang"] != "und" and got[len(signs) + i]["score"] > 0 for i in range(len(letters)))
    assert {r["doc_id"] for r in ppm.keep_identified(docs, model, least=0).collect()} == set(range(len(signs), len(signs) + len(letters)))


def test_a_model_has_a_bound(spark):
    docs = files(spark, "documents")
    small = ppm.train(docs, max_bytes=200_000)
    assert small.cost.nbytes <= 200_000 < ppm.train(docs).cost.nbytes
    got = ppm.identify(docs, small).join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("want")), "id").where("lang <> 'und' and want is not null")
    assert got.where("lang = want").count() >= 0.9 * got.count() > 0
    one = ppm.train(docs, max_bytes=1)
    assert len(one.cost[0]) == one.n


def test_code_lengths_are_those_of_ppm():
    """Every distribution sums to one, and bits are the sum of escapes and symbols of method C with exclusion."""
    text = b"abracadabra"
    grams = Counter()
    s = b"   " + text
    for i in range(len(text)):
        grams[s[i : i + 4]] += 1
    m = ppm.build([("x", g, n) for g, n in grams.items()], 3, least=1)
    counts = [defaultdict(Counter) for _ in range(4)]
    for g, n in grams.items():
        for k in range(4):
            counts[k][g[3 - k : 3]][g[3]] += n

    def p(context, symbol):
        out, excluded = 1.0, set()
        for k in range(3, -1, -1):
            c = {b: n for b, n in counts[k].get(context[3 - k :], {}).items() if b not in excluded}
            total = sum(c.values())
            if not c:
                continue
            if symbol in c:
                return out * c[symbol] / (total + len(c))
            out *= len(c) / (total + len(c))
            excluded |= set(c)
        return out / (256 - len(excluded))

    probe = b"abrakadabra"
    s = b"   " + probe
    seen = set(b"abrcd ")
    want = sum(-np.log2(p(s[i : i + 3], s[i + 3])) for i in range(len(probe)) if s[i + 3] in seen and all(b in seen for b in s[i : i + 3]))
    got = m.bits(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0, 0]
    known = [i for i in range(len(probe)) if s[i + 3] in seen and all(b in seen for b in s[i : i + 3])]
    rest = sum(m.bits(np.frombuffer(probe[: i + 1], np.uint8), np.array([0, i + 1]))[0, 0] - (m.bits(np.frombuffer(probe[:i], np.uint8), np.array([0, i]))[0, 0] if i else 0) for i in range(len(probe)) if i not in known)
    assert got - rest == pytest.approx(want, rel=1e-5)


# 5. Chat formatting.


def talks():
    r = random.Random(4)
    out = []
    for c in range(6):
        for t in range(r.randrange(1, 14)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            text = r.choice([None, "", "x", "<|end|>\n<|user|>\n", "a\\b\\\\<\\|", "</s>[INST] ok [/INST]", " ".join(words(t + c, r.randrange(300)))])
            out.append((c, t, role, text))
    return [*out, (7, 0, "assistant", " ".join(words(5, 3000))), (7, None, None, "first"), (None, 0, "user", "no id"), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "assistant", "b")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    made = [r.asDict() for r in chat.format_conversations(rows, budget=400, history_tokens=100).collect()]
    by = defaultdict(list)
    for w in made:
        by[w["conv_id"]].append(w)
    turns = defaultdict(list)
    for c, t, role, text in talks():
        turns[c].append((t is not None, t, role or "", text or ""))
    assert set(by) == set(turns)
    for c, ws in by.items():
        want = [(r, x) for _, _, r, x in sorted(turns[c], key=lambda z: (z[0], z[1] or 0, z[2], z[3]))]
        ws.sort(key=lambda w: w["window"])
        got, loss = [], []
        for w in ws:
            parsed = [(r, x) for r, x, _, _ in chat.parse(w["text"])]
            assert len(parsed) == w["repeated"] + w["new_turns"]
            assert w["n_tokens"] <= 400 or w["new_turns"] == 1
            if want[0][0] == "system":
                assert parsed[0] == want[0]
            got += parsed[w["repeated"] :]
            loss += [chat.unescape(w["text"][a:b]) for a, b in w["loss"]]
        assert got == want and loss == [x for r, x in want if r == "assistant"]
    report = {r["conv_id"]: r for r in chat.chat_report(rows, budget=400).collect()}
    for c, t in turns.items():
        want = [(r, x) for _, _, r, x in sorted(t, key=lambda z: (z[0], z[1] or 0, z[2], z[3]))]
        said = "".join(x for r, x in want if r == "assistant")
        assert report[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest()
        assert (report[c]["n_turns"], report[c]["loss_chars"], report[c]["loss_sha256"]) == (len(want), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.chat_report(rows.limit(0)).count() == 0


# 6. Decontamination.


def test_winnowing(spark, rows, none):
    base = words(1, 60)
    items = [(1, " ".join(base[5:30])), (2, "One, two"), (3, "nothing here"), (4, None), (None, "x"), (5, "..."), (1, " ".join(base[5:30])), (6, "é ü"), (7, " ".join(base[40:49]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(winnowing.brute_force([(r["doc_id"], r["text"]) for r in rows.collect()], items), key=repr)
    assert bag(winnowing.contamination_report(rows, bench)) == want and any(r[5] for r in want)
    unique = rows.where("doc_id is not null").dropDuplicates(["doc_id"])
    blocks = winnowing.contamination_report(unique, bench, block_bytes=20)
    assert bag(blocks) == sorted(winnowing.brute_force([(r["doc_id"], r["text"]) for r in unique.collect()], items), key=repr)
    assert winnowing.contamination_report(none, bench).count() == 0
    assert winnowing.contamination_report(rows, bench.limit(0)).where("contaminated").count() == 0
    clean = winnowing.drop_contaminated(rows, bench)
    assert clean.columns == rows.columns and clean.count() == sum(not r[5] for r in want)


@pytest.mark.parametrize("block_bytes", [1, 20, 200])
def test_blocks_give_a_row_for_each_row(spark, rows, block_bytes):
    """Rows that repeat an id or have none are judged each on their own, however many blocks there are."""
    base = words(1, 60)
    items = [(1, " ".join(base[5:30])), (2, "One, two"), (4, None), (5, "same id"), (6, "\u00e9 \u00fc"), (7, " ".join(base[40:49])), (8, " ".join(base[20:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(winnowing.brute_force([(r["doc_id"], r["text"]) for r in rows.collect()], items), key=repr)
    assert len(want) == 25 and bag(winnowing.contamination_report(rows, bench, block_bytes=block_bytes)) == want
    assert winnowing.contamination_report(rows.limit(0), bench, block_bytes=block_bytes).count() == 0
    kept = winnowing.drop_contaminated(rows, bench, block_bytes=block_bytes)
    assert kept.columns == rows.columns and bag(kept) == bag(winnowing.drop_contaminated(rows, bench)) and kept.where("text is null").count() == 2


def test_a_joined_benchmark_finds_what_a_broadcast_one_does(spark):
    """Many items with windows in common, and documents of which half hold one passage."""
    passage = words(3, 25)
    items = [(f"i{i}", " ".join((passage[:12] if i % 3 == 0 else []) + words(200 + i, r))) for i, r in enumerate([3, 4, 5, 9, 10, 11, 40] * 6)]
    docs = [(i, " ".join(words(500 + i, 30) + (passage if i % 2 else items[i % 42][1].split()) + words(600 + i, 10))) for i in range(60)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    want = sorted(winnowing.brute_force(docs, items), key=repr)
    assert bag(winnowing.contamination_report(a, b)) == want == bag(winnowing.contamination_report(a, b, block_bytes=0))


# 7. Exact dedup.


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_duplicates(rows, none, bits):
    """With 8 bits of digest, different texts meet and are told apart by their bytes."""
    data = [(r["doc_id"], re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")) for r in rows.collect()]
    groups = defaultdict(list)
    for i, t in data:
        groups[t].append(i)
    want = []
    for i, t in data:
        low = min((x for x in groups[t] if x is not None), default=None)
        want.append((i, low, len(groups[t]), i == low, hashlib.sha256(t.encode()).hexdigest()))
    assert bag(exact_dedup.exact_report(rows, digest_bits=bits)) == sorted(want, key=repr)
    assert exact_dedup.exact_report(none).count() == 0


def entries(spark, ids, digests=lambda i: bytes([i % 256])):
    return spark.createDataFrame([(i, bytearray(digests(i))) for i in ids], "id long, digest binary")


def test_compaction_keeps_the_smallest_identifier(spark):
    index = exact_dedup.Index(fanout=3)
    for ids in ([5, 9], [3, 7], [4, 1]):
        index.flush(entries(spark, ids, lambda i: [i % 2]))
    assert len(index.runs) == 1 and bag(index.runs[0].entries.select("low", "rows")) == [(1, 5), (4, 1)]
    assert bag(index.hits().select("low", "rows")) == [(1, 5)]


def test_a_batch_is_looked_up_through_the_filter_of_each_run(spark):
    """The filter lets all digests of the run through and few others; runs lie in ranges of the digest."""
    sha = lambda i: hashlib.sha256(str(i).encode()).digest()
    index = exact_dedup.Index(fanout=9)
    index.flush(entries(spark, range(5000), sha))
    index.flush(entries(spark, range(4000, 9000), sha))
    asked = entries(spark, range(8000, 13000), sha).select("digest")
    run = index.runs[1]
    passed = {bytes(r["digest"]) for r in run.may_hold(asked).collect()}
    held = {sha(i) for i in range(8000, 9000)}
    assert held <= passed and len(passed) < 1000 + 4000 / 15
    assert {bytes(r["digest"]) for r in index.find(asked).collect()} == held
    assert bag(index.find(entries(spark, range(4500, 4502), sha)).select("low", "rows")) == [(4500, 2), (4501, 2)]
    ranges = sorted(map(tuple, run.entries.groupBy(F.input_file_name()).agg(F.min("digest"), F.max("digest")).select("min(digest)", "max(digest)").collect()))
    assert all(bytes(a[1]) < bytes(b[0]) for a, b in zip(ranges, ranges[1:]))
    assert index.hits().count() == 1000 and exact_dedup.Index(9).repeated == []


# 8. Jaccard join.


def brute_links(data, t=Fraction(3, 4)):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = []
    for _, text in data:
        w = SPACES.findall((text or "").encode().translate(low))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and t.denominator * both >= t.numerator * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low_id = defaultdict(list)
    for i in range(len(data)):
        if data[i][0] is not None:
            low_id[find(i)].append(data[i][0])
    return sorted(((d, len(sets[i]), d if not sets[i] else min(low_id[find(i)], default=None)) for i, (d, _) in enumerate(data)), key=repr)


def test_jaccard_join(rows, none):
    data = [(r["doc_id"], r["text"]) for r in rows.collect()]
    assert bag(partenum.near_duplicates_report(rows)) == brute_links(data)
    assert partenum.near_duplicates_report(none).count() == 0
    clashing = rows.withColumns({"__id": F.lit(1), "__row": F.lit(2), "row_": F.lit(3), "stay": F.lit(4)})
    kept = partenum.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and not {2, 3, 4} & set(ids) and ids.count(15) == 1 and {6, 7, 8} <= set(ids)


def test_jaccard_join_loses_no_link(spark):
    """Random sets around the threshold, of all sizes, with a passage that many share."""
    r = random.Random(8)
    passage, data = words(77, 30), []
    for base in range(40):
        w = words(base + 500, r.choice([5, 6, 7, 9, 12, 20, 40, 90, 200]))
        for _ in range(r.choice([1, 2, 3, 5])):
            x = list(w)
            for _ in range(r.randrange(0, max(1, len(x) // 25) + 1)):
                x[r.randrange(len(x))] = r.choice(WORDS)
            data.append((len(data), " ".join(x + (passage if base % 3 == 0 else []))))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = brute_links(data)
    assert bag(partenum.near_duplicates_report(docs)) == want
    assert bag(partenum.near_duplicates_report(docs, task_shingles=60)) == want  # groups are split over tasks


def test_jaccard_join_joins_what_blocks_cut(spark):
    """Two large groups of near copies that share candidates, over many blocks, with repeated rows."""
    r = random.Random(9)
    data = []
    for base in (1, 2):
        w = words(base + 900, 60)
        for _ in range(60):
            x = list(w)
            x[r.randrange(60)] = r.choice(WORDS)
            data.append((len(data), " ".join(x)))
    mixed = words(901, 60)[:40] + words(902, 60)[:20]
    data += [(len(data), " ".join(mixed)), data[3], data[3], data[70]]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = brute_links(data)
    assert bag(partenum.near_duplicates_report(docs)) == want
    assert bag(partenum.near_duplicates_report(docs, task_shingles=300)) == want


@pytest.mark.parametrize("task_shingles", [1 << 18, 600])
def test_a_long_chain_of_near_copies_takes_as_few_tables_as_a_short_one(spark, monkeypatch, task_shingles):
    """Few edges, however long their paths, are joined in one step, not in rounds of as many tasks as there are partitions."""
    made, stored = Counter(), components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: (made.update([name]), stored(df, name))[1])
    w = words(31, 500)
    data = [(i, " ".join(w[2 * i : 2 * i + 60])) for i in range(200)] + [(i, " ".join(words(i, 30))) for i in range(500, 520)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert bag(partenum.near_duplicates_report(docs, task_shingles=task_shingles)) == brute_links(data)
    assert made["edges"] == made["low"] == made["components"] and not made["labels"]
    assert made["edges"] == 1 if task_shingles > 600 else 1 < made["edges"] <= 4


def test_structured_words_and_weak_keys_link_nothing_falsely(spark, rows):
    """Words that polynomial hashes take for one another; and keys of 3 bits, under which most sets meet."""
    texts = [thue_morse(1024), thue_morse(1024, "b", "a"), thue_morse(1024) + " x", "p q r s " + thue_morse(2048), "p q r s " + thue_morse(2048, "b", "a")]
    data = list(enumerate(texts))
    assert bag(partenum.near_duplicates_report(spark.createDataFrame(data, "doc_id long, text string"))) == brute_links(data)
    r = random.Random(3)
    data = [(x["doc_id"], x["text"]) for x in rows.collect()]
    for base in range(25):
        w = words(base + 40, r.choice([3, 8, 30, 90]))
        data += [(100 + len(data) + i, " ".join(w[:x] + w[x + 1 :])) for i, x in enumerate(r.sample(range(len(w)), 2))]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    want = brute_links(data)
    assert bag(partenum.near_duplicates_report(docs)) == want == bag(partenum.near_duplicates_report(docs, key_bits=3))


def test_a_passage_in_most_documents_holds_no_group_together(spark):
    """Documents that are half one passage, split over tasks by a small limit; few of them are near copies."""
    passage, data = words(7, 30), []
    for i in range(80):
        own = words(300 + i // 2 if i % 8 == 0 else 400 + i, 30)
        data.append((i, " ".join(own[:15] + passage + own[15:])))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = brute_links(data)
    assert bag(partenum.near_duplicates_report(docs)) == want
    assert bag(partenum.near_duplicates_report(docs, task_shingles=500, bucket_signatures=100)) == want


def test_signatures_of_similar_sets_meet():
    """Any two sets of the threshold's similarity share as many as each needs, in the larger one's band."""
    bands, r = partenum.Bands(Fraction(3, 4)), np.random.default_rng(5)
    for n in [1, 2, 3, 4, 7, 9, 13, 20, 27, 28, 34, 50, 90, 150, 400, 1000]:
        for _ in range(30):
            both = int(np.ceil(0.75 * n))
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            extra = int(r.integers(0, max(0, int(both / 0.75) - n) + 1))
            b = np.unique(np.concatenate((r.choice(a, both + (n - both) * (extra == 0 and r.random() < 0.5), replace=False), r.integers(0, 2**64, extra, dtype=np.uint64))))
            if 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)):
                continue
            sets = partenum.Sets.__new__(partenum.Sets)
            sets.hashes, sets.sizes = np.concatenate((a, b)), np.array([len(a), len(b)])
            sets.bounds = np.array([0, len(a), len(a) + len(b)])
            (sig, of, role), own, low = partenum.sign(sets, bands, np.arange(2))
            got = {(d, x): set(sig[(of == d) & (role == x)].tolist()) for d in (0, 1) for x in (0, 1)}
            small, large = (0, 1) if len(a) <= len(b) else (1, 0)
            _, high = bands.upto(2000)
            x = int(np.searchsorted(high, len((a, b)[large])) - np.searchsorted(high, len((a, b)[small])))
            both = len(got[small, x] & got[large, 0])
            assert x in (0, 1) and both >= max(own[large], (own, low)[x][small], 1), (n, len(a), len(b))


def test_tables_between_steps_go(spark, tmp_path, monkeypatch):
    """What a result does not read is deleted, also when a step fails; the result can be read."""
    from graphloom.llm import shared

    monkeypatch.setattr(shared, "checkpoint_dir", lambda s: str(tmp_path))
    there = lambda: {p.name.rsplit("-", 1)[0] for p in (tmp_path / "graphloom").iterdir()}
    docs = spark.createDataFrame([(i, " ".join(words(i % 7, 30))) for i in range(40)], "doc_id long, text string")
    out = partenum.near_duplicates_report(docs)
    assert there() == {"signatures", "classes", "named"} and out.groupBy("component_id").count().count() == 7
    assert exact_dedup.exact_report(docs).where("kept").count() == 7 and there() == {"signatures", "classes", "named", "digests", "groups", "clashes"}
    with pytest.raises(ZeroDivisionError), shared.Scratch(spark) as scratch:
        scratch.keep(shared.stored(docs, "failed"))
        1 / 0  # noqa: B018
    assert "failed" not in there() and shared._SCRATCH == []


# 9. Packing.


def test_packing(rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(rows, capacity=64, block_tokens=500).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[(r["id"], r["doc_tokens"])].append(r)
    want = Counter()
    for r in rows.collect():
        want[(r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]))] += 1
    have = Counter()
    for (i, n), ps in pieces.items():
        by_start = defaultdict(list)
        for p in ps:
            by_start[p["start"]].append(p)
        while by_start.get(0):
            at, ids = 0, []
            while at < n:
                p = by_start[at].pop()
                part = np.frombuffer(p["ids"], "<u4").tolist()
                assert len(part) == p["length"]
                ids += part
                at += p["length"]
            have[(i, tuple(ids))] += 1
    assert {k: v for k, v in have.items() if k[0] not in (15, None)} == {k: v for k, v in want.items() if k[0] not in (15, None)}
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(seqs) <= total / 64 + 3 * 3 + total / 500
    assert packing.pack(none).count() == 0


def test_balance_levels_costs():
    r = random.Random(1)
    lengths = [r.randrange(1, 700) for _ in range(400)]
    out = packing.balance(lengths, 1024, 1.0, 1 / 512)
    cost, fill = defaultdict(float), Counter()
    for _, _, n, s in out:
        cost[s] += n + n * n / 512
        fill[s] += n
    assert sum(fill.values()) == sum(lengths) and len(fill) == -(-sum(lengths) // 1024) and max(fill.values()) <= 1024
    assert max(cost.values()) < 1.8 * (sum(cost.values()) / len(cost))


def thue_morse(n, a="a", b="b"):
    """Words whose polynomial hashes modulo 2**64 agree, whatever the base."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def ids_of(got):
    out = defaultdict(list)
    for r in sorted(got, key=lambda r: r["start"]):
        out[r["id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    return out


def test_units_are_told_apart_by_their_bytes(spark, monkeypatch):
    """Structured words, and a hash of two bits under which most units meet."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = [thue_morse(1024), thue_morse(1024, "b", "a"), "x " + thue_morse(2048), "y " + thue_morse(2048, "b", "a"), "plain words of a text", "other words", "", "words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert ids_of(packing.pack(docs).collect()) == want
    tokens = packing.Tokens(packing.tokenizer_path())
    monkeypatch.setattr(packing, "hash_ranges", lambda *a: text_module.hash_ranges(*a) & np.uint64(3))
    for _ in range(2):
        for part in (texts[:4], texts[4:], texts):
            raw = [t.encode() for t in part]
            ids, at = tokens.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_word_hashes():
    """Equal for equal words alone, of any length, and apart under another seed."""
    made = [thue_morse(n, a, b) for n in (1, 7, 8, 9, 16, 127, 128, 129, 1024, 4096) for a, b in ("ab", "ba")] + ["\0", "\0\0", "a\0", "", "a"]
    raw = [m.encode() for m in made * 2]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    h = text_module.hash_ranges(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])
    assert len(set(h.tolist())) == len(set(made)) and h[: len(made)].tolist() == h[len(made) :].tolist()
    assert not set(h.tolist()) & set(text_module.hash_ranges(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:], 1).tolist())


# 10. Substring dedup.


def brute_repeats(data, k=13):
    toks = [(i if i is not None else superkmers.NO_ID, SPACES.findall((t or "").encode())) for i, t in data]
    first = {}
    for i, w in toks:
        for j in range(len(w) - k + 1):
            first[tuple(w[j : j + k])] = min(i, first.get(tuple(w[j : j + k]), i))
    out = []
    for (d, _), (i, w) in zip(data, toks):
        gone = {x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for x in range(j, j + k)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(rows, none):
    data = [(r["doc_id"], r["text"]) for r in rows.collect()]
    got = bag(superkmers.repeats_report(rows))
    assert got == brute_repeats(data) and any(r[2] for r in got)
    assert superkmers.repeats_report(none).count() == 0
    assert bag(superkmers.repeats_report(rows, k=3, m=1)) == brute_repeats(data, 3)


def test_window_hash_collisions_are_told_apart(spark, monkeypatch):
    """With 6-bit window hashes different windows meet; their words decide."""
    real = superkmers.grams
    monkeypatch.setattr(superkmers, "grams", lambda h, k: real(h, k) & np.uint64(63) if k == 13 else real(h, k))
    data = [(i, " ".join(words(i % 3, 40) if i < 6 else words(i, 30))) for i in range(9)]
    held = superkmers._Held()
    from graphloom.llm.text import NOT_SPACE, Words

    for i, t in data:
        raw = np.frombuffer(t.encode(), np.uint8)
        held.add(np.array([i]), np.array([i]), Words(raw, np.array([0, len(raw)]), NOT_SPACE), 13, 3, np.zeros(0, np.uint64))
    blobs = [b for _, b in held.flush(1, 13)]
    ids, _, s, e = superkmers._count_bucket(blobs, 13)
    removed = Counter()
    for i, a, b in zip(ids.tolist(), s.tolist(), e.tolist()):
        removed[i] += b - a
    assert {r[0]: r[2] for r in brute_repeats(data) if r[2]} == dict(removed)


def test_a_run_of_one_minimiser_may_have_any_number_of_windows(spark):
    """A repeated word makes one super-k-mer of more than 65,535 windows; its copies lie in the same task."""
    data = [(1, "again " * 100_000), (2, "again " * 100_000), (3, "again " * 66_000 + "end")]
    assert bag(superkmers.repeats_report(spark.createDataFrame(data, "doc_id long, text string").coalesce(1))) == brute_repeats(data)


def test_rows_without_an_id_are_told_apart(spark):
    """Thousands of rows without an id share a window with document 1; as many others share nothing and lose nothing."""
    shared = " ".join(f"s{i}" for i in range(13))
    data = [(1, shared)] + [(None, f"{shared} t{i}") for i in range(20_000)] + [(None, " ".join(f"u{i}v{j}" for j in range(15))) for i in range(20_000)]
    got = superkmers.repeats_report(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(13, 0, 1), (14, 13, 20_000), (15, 0, 20_000)]


def test_frequent_grams_change_nothing(spark):
    """A passage that most documents hold, with words of their own beside it."""
    passage = words(5, 40)
    data = [(i, " ".join(words(100 + i, 20) + (passage if i % 3 else passage[:20]) + words(900 + i, 20))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert len(superkmers.frequent_grams(docs, "text", 3, 1 << 20, 1 / 256)) >= 38
    assert bag(superkmers.repeats_report(docs)) == brute_repeats(data) == bag(superkmers.repeats_report(docs, sample_bytes=0))
