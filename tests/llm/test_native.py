"""Sharding and URL filters."""

import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from palisade.llm import queries, sharding
from palisade.llm.sharding import shard_documents
from palisade.llm.url_graph import Rule, judge_urls, link_edges, rank
from tests.llm.helpers import corpus, documents


def check_shards(rows, n, slack):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    total = sum(len((r.text or "").encode()) + 1 for r in rows)
    largest = max(len((r.text or "").encode()) + 1 for r in rows)
    for shard, own in by.items():
        assert 0 <= shard < n
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(len((r.text or "").encode()) + 1 for r in own) - total / n) <= largest * slack + 0.01 * total


def test_shards_are_near_equal_and_gapless(spark):
    for ranges in (64 << 20, 4000):
        rows = shard_documents(documents(spark), 4, range_bytes=ranges).collect()
        assert len(rows) == len(corpus())
        check_shards(rows, 4, 1.5)


def test_one_text_for_all_rows_is_split_by_id(spark):
    rows = shard_documents(documents(spark, [(k * 3, "same text") for k in range(1000)]), 8).collect()
    check_shards(rows, 8, 1)
    assert {r.shard for r in rows} == set(range(8))


def test_repeated_rows_and_null_ids(spark):
    rows = shard_documents(documents(spark, [(1, "a")] * 5 + [(None, "b")] * 3 + [(None, None)]), 4).collect()
    assert len(rows) == 9
    for shard in {r.shard for r in rows}:
        own = [r.slot for r in rows if r.shard == shard]
        assert sorted(own) == list(range(len(own)))


def test_empty(spark):
    assert shard_documents(documents(spark, []), 4).count() == 0


def brute_shards(rows, n):
    """(id, shard, slot) by sorting all rows by key and cutting where the bytes below come closest to equal shares."""
    def key(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), seed=42)
        return (h - (1 << 64) if h >> 63 else h, -(2**63) if row[0] is None else row[0])

    ordered = sorted(rows, key=key)
    sizes = [len((t or "").encode()) + 1 for _, t in ordered]
    total, below = sum(sizes), [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    cuts = [min(range(len(below)), key=lambda k: (abs(below[k] - total * i / n), k)) for i in range(1, n)]
    bounds = [0, *cuts, len(ordered)]
    return sorted((i, shard, slot) for shard in range(n) for slot, (i, _) in enumerate(ordered[bounds[shard]:bounds[shard + 1]]))


@pytest.mark.parametrize("most_ranges, most_cells, block, range_bytes", [(1 << 16, 1 << 20, 128, 64 << 20), (1 << 16, 1 << 20, 3, 20), (1 << 16, 64, 2, 300), (40, 1 << 20, 128, 60)])
def test_shards_equal_brute_force(spark, monkeypatch, most_ranges, most_cells, block, range_bytes):
    """A third of the rows hold one text; ranges, cells and blocks are small in turn."""
    monkeypatch.setattr(sharding, "MOST_RANGES", most_ranges)
    monkeypatch.setattr(sharding, "MOST_CELLS", most_cells)
    monkeypatch.setattr(sharding, "BLOCK", block)
    rng = random.Random(4)
    rows = [(k * 7 - 900, "hot text" if k % 3 == 0 else None if k % 50 == 1 else "x" * rng.randrange(60) + str(k)) for k in range(600)] + [(2**62, "y" * 900), (-(2**62), "hot text")]
    got = shard_documents(documents(spark, rows), 7, tolerance=0.0, range_bytes=range_bytes).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == brute_shards(rows, 7)


def test_query_columns(spark, tmp_path):
    documents(spark, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_histogram_shards(spark, str(tmp_path)).collect()
    text = {i: t for i, t in corpus() if i not in (None, 90)}
    for r in rows:
        if r.doc_id in text:
            data = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, html string, verdict string, trust double")


def test_rules(spark):
    urls = ["http://a.com/x", "http://example.com/en/1", "https://WWW.Example.com/en/2?q", "http://b.net/es/", "http://b.net/fr", "http://com", "http://xcom/y", None, "no scheme", "http://b.org#f", "a://b://c.net/fr/z"]
    rows = judge_urls(pages(spark, [(k, u, None) for k, u in enumerate(urls)])).orderBy("page_id").collect()
    assert [r["rule"] for r in rows] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, None, None]
    assert [r["host"] for r in rows] == ["a.com", "example.com", "www.example.com", "b.net", "b.net", "com", "xcom", "", "", "b.org", "b:"]
    assert [r["path"] for r in rows] == ["/x", "/en/1", "/en/2", "/es/", "/fr", "", "/y", "", "", "", "//c.net/fr/z"]
    assert rows[7]["verdict"] == "allow"


def power_rank(edges, seeds, damping, rounds):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    score = dict(seeds)
    for _ in range(rounds):
        new = defaultdict(float)
        for (a, b), w in edges.items():
            new[b] += damping * score.get(a, 0) * w / out[a]
        lost = sum(score.values()) - sum(new.values())
        for s, w in seeds.items():
            new[s] += lost * w
        score = new
    return score


def test_rank_equals_power_iteration(spark):
    edges = {("a", "b"): 2.0, ("b", "c"): 1.0, ("c", "a"): 1.0, ("a", "d"): 1.0, ("e", "a"): 5.0}
    seeds = {"a": 0.5, "e": 0.5}
    got = rank(spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double"), spark.createDataFrame(list(seeds.items()), "host string, weight double"), 0.85, 1e-7, 200, "t")
    want = {h: s for h, s in power_rank(edges, seeds, 0.85, 300).items() if s}
    got = {r.host: r.score for r in got.collect()}
    assert {h: s / sum(got.values()) for h, s in got.items()} == pytest.approx(want, abs=1e-6)


def all_visits(links, seeds, damping):
    """What every host is ever given, each seed starting with 1; links: {src: {dst: weight}}."""
    total, last = defaultdict(float), {s: 1.0 for s in seeds}
    while sum(last.values()) > 1e-9:
        for h, s in last.items():
            total[h] += s
        new = defaultdict(float)
        for h, s in last.items():
            for to, w in links.get(h, {}).items():
                new[to] += damping * s * w / sum(links[h].values())
        last = new
    return total


def brute_verdicts(rows):
    """(host, path, rule, verdict) of each (url, html), by plain reading of the contract and of the method."""
    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        return host.translate({k: k + 32 for k in range(65, 91)}), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]

    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

    def rule_of(host, path):
        fit = [r for r in rules if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fit, key=len, default=None)

    said, links = defaultdict(list), defaultdict(lambda: defaultdict(float))
    for url, html in rows:
        host, path = split(url)
        if host:
            said[host].append(rules.get(rule_of(host, path)))
            for to in re.findall(r'<a href="([^"]*)"', html or ""):
                other = split(to if "://" in to else "http:" + to if to.startswith("//") else None)[0]
                if other and other != host:
                    links[host][other] += 1
    back = defaultdict(dict)
    for a, to in links.items():
        for b, w in to.items():
            back[b][a] = w
    seeds = {v: [h for h, x in said.items() if 2 * x.count(v) > len(x)] for v in ("allow", "block")}
    trust, distrust = all_visits(links, seeds["allow"], 0.85), all_visits(back, seeds["block"], 0.85)
    out = []
    for url, _ in rows:
        host, path = split(url)
        rule = rule_of(host, path)
        out.append((host, path, rule, rules[rule] if rule else "block" if distrust[host] > trust[host] else "allow"))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    """A graph of 60 hosts with links, a chain of 30 hosts towards a blocked one, odd urls, nulls and repeated pages."""
    rng = random.Random(9)
    hosts = [f"h{k}.{rng.choice(('org', 'net', 'com', 'io'))}" for k in range(60)] + ["www.example.com", "example.com"]
    link = lambda to: f'<a href="{to}">x</a>'
    rows = []
    for host in hosts:
        for _ in range(rng.randrange(1, 4)):
            to = [rng.choice(("http://", "https://", "//")) + rng.choice((rng.choice(hosts), rng.choice(hosts).upper())) + "/p" for _ in range(rng.randrange(4))]
            rows.append((f"http://{host}{rng.choice(('/en/a', '/es/b', '/fr/c', '/', '', '?q', '/fr'))}", "".join(map(link, [*to, "/own"]))))
    rows += [(f"http://c{k}.chain/", link(f"http://c{k + 1}.chain/")) for k in range(30)] + [("http://c30.chain/", link("http://far.net/")), ("http://far.net/es/1", "")]
    rows += [(None, link("http://h0.org/")), ("no scheme", None), ("ftp://Odd.NET/es/1#f", None), ("http://", ""), rows[0], rows[0]]
    spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.host, r.path, r.rule, r.verdict) for r in queries.op9_link_trust(spark, str(tmp_path)).orderBy("page_id").collect()]
    want = brute_verdicts(rows)
    assert got == want
    assert [v for h, _, _, v in want if h.endswith(".chain")] == ["block"] * 31
    assert len({v for _, _, rule, v in want if rule is None}) == 2


def test_links_and_propagation(spark):
    rules = (Rule("allow", "good.org", "/"), Rule("block", "bad.org", "/"))
    html = lambda *to: "".join(f'<a class=x href="{t}">l</a>' for t in to)
    rows = [(1, "http://good.org/", html("http://mid.org/a", "/local")), (2, "http://bad.org/", html("http://bad.org/self")), (3, "http://farm.org/1", html("//BAD.org/x", "https://bad.org/y")),
            (4, "http://mid.org/a", ""), (5, "http://lone.org/", None), (5, "http://lone.org/", None)]
    df = pages(spark, rows)
    assert {(r.src, r.dst, r.weight) for r in link_edges(df).collect()} == {("good.org", "mid.org", 1.0), ("farm.org", "bad.org", 2.0)}
    got = [(r.page_id, r.verdict) for r in judge_urls(df, rules).orderBy("page_id").collect()]
    assert got == [(1, "allow"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (5, "allow")]
    assert [r.verdict for r in judge_urls(df, rules, broadcast_hosts=0).orderBy("page_id").collect()] == [v for _, v in got]


def test_the_number_of_seeds_does_not_count(spark):
    """One blocked seed links to a host as one trusted host does; nine more trusted seeds elsewhere change nothing there."""
    rules = (Rule("allow", "good.org", "/"), Rule("block", "bad.org", "/"))
    link = lambda to: f'<a href="http://{to}/">l</a>'
    rows = [(1, "http://a.good.org/", link("mid.org")), (2, "http://mid.org/", link("bad.org")), (3, "http://bad.org/", "")]
    few = judge_urls(pages(spark, rows), rules).filter("page_id = 2").first()
    more = judge_urls(pages(spark, rows + [(10 + k, f"http://h{k}.good.org/", "") for k in range(9)]), rules).filter("page_id = 2").first()
    assert few.verdict == more.verdict
    assert more.distrust == pytest.approx(few.distrust) and few.trust > 0 and more.trust > 0


def test_empty_pages(spark):
    assert judge_urls(pages(spark, [])).count() == 0
