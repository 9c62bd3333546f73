"""Sharding, mixing, exact dedup and URL rules against plain models."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import corpus
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import exact, mixing, sharding, urls
from gaugeflow.llm.components import connected_components


def test_shards_of_awkward_rows(spark):
    data = corpus.rows()
    got = sharding.minimax_shards(corpus.documents(spark), shards=7, slot_rows=5).collect()
    texts = defaultdict(list)
    for i, t, _ in data:
        texts[i].append((t or "").encode())
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in data)
    shard_of = defaultdict(set)
    for r in got:
        raw = texts[r["doc_id"]][0]
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        shard_of[raw].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def _least_capacity(sizes, shards):
    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    low, high = 0, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_the_smallest(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "SEGMENT_BITS", 3)  # many rounds of refinement
    rng = random.Random(seed)
    keys = list({rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)})
    if seed % 2:
        keys = [k >> 40 for k in keys]  # crowded: few high bits differ
    groups = {k: rng.choice([1, 5, 50, 400]) for k in keys}
    df = spark.createDataFrame(list(groups.items()), "key long, bytes long")
    capacity, firsts = sharding.minimax_cuts(df, 6)
    ordered = [groups[k] for k in sorted(groups)]
    assert capacity == _least_capacity(ordered, 6)
    loads = Counter()
    for k, n in groups.items():
        loads[sum(k >= f for f in firsts)] += n
    assert max(loads.values()) <= capacity and len(firsts) <= 5


def test_one_huge_group_leaves_the_rest_even(spark):
    groups = [(k, 1000 if k == 500 else 1) for k in range(0, 1000)]
    capacity, firsts = sharding.minimax_cuts(spark.createDataFrame(groups, "key long, bytes long"), 5)
    assert capacity == 1000
    loads = Counter(sum(k >= f for f in firsts) for k, _ in groups)
    assert len(loads) == 5


def test_shards_of_nothing(spark):
    assert sharding.minimax_shards(corpus.empty(spark)).count() == 0


def _sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(3))
def test_apportionment(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for by, n in enumerate((1, 3, 12, 40)):
        votes = [rng.choice([0, 1, 1, 7, 1000, rng.randrange(1, 10**5)]) for _ in range(n)]
        votes[0] = 3
        seats = rng.randrange(0, 300)
        rows += [(by, i, v, seats) for i, v in enumerate(votes)]
        expected |= {(by, i): q for i, q in enumerate(_sainte_lague(votes, seats))}
    df = spark.createDataFrame(rows, "by int, item int, votes long, seats long")
    got = {(r["by"], r["item"]): r["quota"] for r in mixing.apportion(df, ["by"], ["item"]).collect()}
    assert got == expected


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, set(names), sum(sizes.values())
    while rest:
        over = [s for s in rest if left * weight[s] > most * sizes[s] * sum(weight[x] for x in rest)]
        if not over:
            whole = sum(weight[x] for x in rest)
            return target | {s: left * weight[s] / whole for s in rest}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        rest -= set(over)
    return target


def test_mix_of_awkward_rows(spark):
    data = corpus.rows()
    got = mixing.mix(corpus.documents(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in data)
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += corpus.word_count(t)
    target = _targets(sizes)
    taken = Counter()
    text = {i: t for i, t, _ in data}
    for r in got:
        assert r["size"] == corpus.word_count(text[r["doc_id"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.02 * t + 2
    again = mixing.mix(corpus.documents(spark).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing(spark):
    assert mixing.mix(corpus.empty(spark)).count() == 0
    only = corpus.documents(spark, [(1, None, None), (2, "", "a")])
    assert [r["taken"] for r in mixing.mix(only).collect()] == [0, 0]


@pytest.mark.parametrize("bits,capacity", [(64, 4096), (64, 4), (3, 2)])
def test_exact_groups(spark, bits, capacity):
    data = corpus.rows()
    got = exact.exact_groups(corpus.documents(spark), capacity, bits, combine_bytes=2000).collect()
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in data]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    digest = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in norm}
    text = dict(norm)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in norm)
    for r in got:
        own = groups[text[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (min(own), len(own), digest[r["doc_id"]])
    assert Counter(r["keep_id"] for r in got if r["kept"]) == Counter(min(g) for g in groups.values())
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    leaves = exact.directory(keys, 50)
    loads = exact.bucket_of(keys, leaves).groupBy("bucket").count().collect()
    assert max(r["count"] for r in loads) <= 50 and sum(r["count"] for r in loads) == 2000
    assert sum(2.0 ** -r["depth"] for r in leaves.collect()) == pytest.approx(1.0, abs=0.3)


def test_exact_groups_of_nothing(spark):
    assert exact.exact_groups(corpus.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 300])
def test_components(spark, n):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)] + [(9, 9)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in parent)


URLS = [
    ("http://A.Example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://a.example.net/de/x?q#f", "a.example.net", "/de/x", "net/", "block"),
    ("http://net", "net", "", None, "allow"),
    ("http://mynet/x", "mynet", "/x", None, "allow"),
    ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("https://x.org/fr/://y", "x.org", "/fr/://y", "org/fr/", "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("ftp://x.com?a=/de/", "x.com", "", None, "allow"),
]


def test_rules_and_aliases(spark):
    pages = [(i, u[0], None) for i, u in enumerate(URLS)] + [(3, URLS[3][0], "<p>again")]
    html = '<link href="http://a.example.net/de/x?q#f" rel="canonical">'
    pages += [(20, "http://q.com/1", html), (21, "http://q.com/2", "<meta http-equiv='refresh' content='0; url=/1'>")]
    pages += [(22, "http://w.org/fr/ok", "<LINK rel=canonical href=http://q.com/2>"), (23, "http://q.com/3", "<link rel=icon href=/1>")]
    df = spark.createDataFrame([(*p, "host", "hit") for p in pages], "page_id long, url string, html string, host string, hit string")
    got = {r["page_id"]: r for r in urls.aliased_verdicts(df, urls.page_links(df)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
    assert [got[i]["verdict"] for i in (20, 21, 22, 23)] == ["block", "block", "allow", "allow"]
    assert urls.aliased_verdicts(df.limit(0), urls.page_links(df.limit(0))).count() == 0


def _many(spark, sources, docs, long_share=0):
    """Documents of 50 to 500 words, some of 5,000, of many sources."""
    words = F.pmod(F.xxhash64("id"), F.lit(451)) + 50
    words = F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) < long_share, 5000).otherwise(words).cast("int")
    return spark.range(docs).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), F.col("id") % sources).alias("source"),
        F.repeat(F.lit("w "), words).alias("text"),
    )


@pytest.mark.parametrize("sources,docs", [(3, 3_000), (20, 20_000), (200, 60_000), (5_000, 200_000)])
def test_mix_meets_the_targets_of_many_sources(spark, sources, docs):
    got = mixing.mix(_many(spark, sources, docs))
    assert got.where("taken > 3 * size OR taken < 0").isEmpty()
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(sums) == sources
    assert all(abs(r["taken"] / r["target"] - 1) < 0.02 for r in sums)


def test_no_plan_of_the_mix_apportions_more_than_once(spark, monkeypatch):
    plans = []

    def watched(df, name="table", keep=mixing.saved):
        plans.append((name, df))
        return keep(df, name)

    monkeypatch.setattr(mixing, "saved", watched)
    plans.append(("result", mixing.mix(_many(spark, 3, 300))))
    windows = {name: df._jdf.queryExecution().optimizedPlan().toString().count("Window ") for name, df in plans}
    joins = {name: df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for name, df in plans}
    assert max(windows.values()) <= 9 and max(joins.values()) <= 5, (windows, joins)


def test_rows_without_id_are_spread_over_shards(spark):
    docs = _many(spark, 2, 4_000).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    docs = docs.withColumn("text", F.concat("text", F.monotonically_increasing_id()))
    sums = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] / r["w"] - 1) < 0.02 for r in sums)


LINKS = [
    ("http://A.b/x/y.html", "z.html", "http://a.b/x/z.html"),
    ("http://a.b/x/y.html?q=1", "../z/./w?k=1&amp;l=2#f", "http://a.b/z/w?k=1&l=2"),
    ("http://a.b", "z", "http://a.b/z"),
    ("http://a.b/x/", "..", "http://a.b/"),
    ("http://a.b/x", "../../../z", "http://a.b/z"),
    ("http://a.b/x?old", "?new", "http://a.b/x?new"),
    ("HTTPS://a.b/x", "//C.d/e", "https://c.d/e"),
    ("http://a.b/x", "/y/../z", "http://a.b/z"),
    ("http://a.b/x", "HTTP://C.D", "http://c.d/"),
    ("http://a.b/x", "#top", None),
    ("http://a.b/x", "mailto:me@c.d", None),
    ("http://a.b/x", "http://A.B/x#part", None),
]


def test_links_are_resolved_against_their_page(spark):
    pages = [(i, page, f"<link rel='canonical' href='{link}'>") for i, (page, link, _) in enumerate(LINKS)]
    pages += [(50, "http://m.n/1", "<link rel=canonical href=/2><p><LINK href='/3' rel='canonical'>"
               "<meta http-equiv=refresh content='3;url=/4'><meta content='0; URL=/5' http-equiv='x'>")]  # fmt: skip
    pages += [(51, None, "<link rel=canonical href=/2>"), (52, "http://m.n/9", None), (53, "no scheme", "<link rel=canonical href=/2>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r["src"], r["dst"]) for r in urls.page_links(frame).collect()}
    keys = {p: spark.range(1).select(urls.url_key(F.lit(p))).first()[0] for p, _, _ in LINKS}
    expected = {(keys[page], dst) for page, _, dst in LINKS if dst}
    assert got == expected | {("http://m.n/1", f"http://m.n/{i}") for i in (2, 3, 4)}


def test_blocks_reach_aliases_however_they_are_written(spark):
    pages = [
        (1, "http://x.com/de/../a", None),
        (2, "http://Y.com/start", "<link rel=canonical href='page2.html'><link rel=canonical href='http://EXAMPLE.com/de/z#top'>"),
        (3, "http://y.COM/page2.html#part", None),
        (4, "http://y.com/other", "<link rel=canonical href='./start?'>"),
        (5, "http://w.org/fr/a", "<link rel=canonical href='http://y.com/start'>"),
        (2, "http://Y.com/start", None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r["page_id"], r["verdict"], r["alias_blocked"]) for r in urls.aliased_verdicts(frame, urls.page_links(frame)).collect()]
    assert sorted(got) == [(1, "allow", False), (2, "block", True), (2, "block", True), (3, "block", True), (4, "allow", False), (5, "allow", False)]
