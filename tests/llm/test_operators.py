"""Corpus operators against brute force, and the cases that each must survive."""

import math
import os
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import catalog, digests, jaccard, language, mixing, packing, passages, redirects, rules, sharding, tokens
from tests.test_catalog import DATA, compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__x` string, tile string"
RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, texts, ids=None, langs=None, sources=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t) if t is not None else None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, ties, repeated rows, clashing columns."""
    long = prose(60_000, 1)
    texts = [None, "", "   ", "one", "one two", "ÀÉ ﬁ", long, long, prose(80, 2), prose(80, 2), prose(80, 2), None]
    return table(spark, texts, [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None, None], ["en", None] * 6, [None, "s"] * 6)


@pytest.fixture(scope="module")
def near(spark):
    base = [prose(120, i) for i in range(12)]
    texts = list(base)
    for i, t in enumerate(base[:6]):
        w = t.split()
        w[5 * i : 5 * i + 4] = ["zz"] * 4
        texts += [" ".join(w), t.upper()]
    return texts


def grams(t):
    w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}


def linked(texts, ids, least=0.5):
    """{doc_id: (class_id, links)} by comparing all pairs."""
    g = [grams(t) for t in texts]
    parent, links = {d: d for d in ids}, dict.fromkeys(ids, 0)

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for (a, x), (b, y) in combinations(zip(ids, g), 2):
        if x & y and len(x & y) / len(x | y) >= least - 1e-12:
            links[a], links[b] = links[a] + 1, links[b] + 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (find(d), links[d]) for d in ids}


def test_jaccard_join(spark, near, odd):
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.ngram_jaccard_join(table(spark, near)).collect()}
    assert got == linked(near, range(len(near))) and sum(x > 0 for _, x in got.values()) == 18
    kept = jaccard.keep_one(table(spark, near))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "__x", "tile"] and {r["doc_id"] for r in kept.collect()} == set(range(12))
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.ngram_jaccard_join(odd).collect()}
    assert got == {2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 1), 8: (7, 1), 9: (9, 0)}


def test_jaccard_join_of_a_large_group(spark, monkeypatch):
    """A group of edited and exact copies in blocks of a few sets, against all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r, base = random.Random(4), prose(90, 600)
    texts = [" ".join("zz" + str(i) if r.random() < r.choice((0, 0.02, 0.06)) else w for w in base.split()) for i in range(60)] + [prose(40, 700 + i) for i in range(40)]
    texts += texts[:10] + texts[:3]
    ids = [1000 - i for i in range(len(texts))]
    got = {x["doc_id"]: (x["class_id"], x["links"]) for x in jaccard.ngram_jaccard_join(table(spark, texts, ids)).collect()}
    assert got == linked(texts, ids)


def test_jaccard_join_loses_no_pair(spark):
    """Pairs of J from 0.5 to 0.53, of which the bands alone lose some, and others just below 0.5."""
    texts = []
    for k in range(400):
        shared, n = prose(62, 20_000 + k), 60
        for i in (0, 1):  # n shared grams, and in each text so many of its own
            own = (n // 2, n // 2 - 2, n // 2 - 3, n // 2 + 1)[k % 4]
            texts.append(shared + " " + " ".join(f"o{k}x{i}x{j}" for j in range(own)))
    got = {x["doc_id"]: (x["class_id"], x["links"]) for x in jaccard.ngram_jaccard_join(table(spark, texts)).collect()}
    assert got == {2 * k + i: (2 * k + i * (k % 4 == 3), int(k % 4 != 3)) for k in range(400) for i in (0, 1)}


def test_packing(spark, odd):
    r = random.Random(1)
    sizes = sorted((r.randint(0, 50) for _ in range(300)), reverse=True)
    room, want = [], []
    for s in sizes:
        b = next((i for i, x in enumerate(room) if x >= s), len(room))
        room += [50] * (b == len(room))
        want.append((b, 50 - room[b]))
        room[b] -= s
    assert packing.first_fit_decreasing(sizes, 50) == want
    rows = packing.pack(table(spark, [prose(r.randint(0, 90), i) for i in range(60)]), 100, group_docs=16).collect()
    used = {}
    for x in rows:
        used.setdefault((x["group"], x["bin"]), []).append((x["offset"], x["offset"] + x["length"]))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert packing.pack(odd).agg(F.sum("length")).first()[0] == odd.agg(F.sum(F.octet_length("text"))).first()[0]


def test_shards(spark, odd):
    r = np.random.default_rng(1)
    parts = np.zeros((200, 4), np.int64)
    parts[:, 0] = r.integers(1, 1000, 200)
    sums, where = sharding.differencing(parts)
    assert sorted(np.bincount(where[:, 0], parts[:, 0], 4)) == sorted(sums) and sums[0] - sums[-1] <= 2
    docs = table(spark, [prose(RNG.randint(1, 60), i % 150) for i in range(300)])
    for bucket in (4096, 20):
        rows = sharding.karmarkar_karp_shards(docs, 4, bucket_groups=bucket).collect()
        assert len(rows) == 300 and len({(x["group"], x["shard"]) for x in rows}) == len({x["group"] for x in rows})
    assert sharding.karmarkar_karp_shards(odd, 3).count() == odd.count()


def test_separator_scan(spark, tmp_path, odd):
    texts = [prose(n, n) for n in (0, 1, 50, 3, 400, 7, 0, 0, 90)] + [None]
    files, order = tokens.write_token_files(table(spark, texts).coalesce(2), f"file://{tmp_path}/t")
    coder, want = tokens.encoder(), []
    assert sorted(r["doc_id"] for r in order.collect()) == list(range(len(texts)))
    for f in files.orderBy("file").collect():
        ids = np.fromfile(f["path"].removeprefix("file://"), "<u2")
        assert len(ids) == f["tokens"]
        start = 0
        for k, end in enumerate(np.flatnonzero(ids == tokens.SEPARATOR)):
            want.append((f["file"], k, start, int(end) - start, True))
            start = int(end) + 1
    assert sorted(w[3] for w in want) == sorted(len(coder.encode_ordinary(t or "")) for t in texts)
    for block in (1, 2, 7, 64, 1 << 20):
        assert sorted(map(tuple, tokens.separator_scan(files, block_tokens=block).collect())) == want
    np.array([5, 6, tokens.SEPARATOR, 7, 8, 9], "<u2").tofile(tmp_path / "open.bin")
    one = spark.createDataFrame([(0, f"file://{tmp_path}/open.bin", 6), (1, None, 3), (2, "x", 0)], "file int, path string, tokens long")
    for block in (1, 2, 4, 100):
        assert sorted(map(tuple, tokens.separator_scan(one, block_tokens=block).collect())) == [(0, 0, 0, 2, True), (0, 1, 3, 3, False)]
    rows = tokens.document_token_counts(table(spark, texts)).collect()
    assert {r["doc_id"]: r["tokens"] for r in rows} == {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert sorted(str(r["doc_id"]) for r in tokens.document_token_counts(odd).collect()) == sorted(str(r["doc_id"]) for r in odd.collect())


def test_redirects(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    pages = [(1, "http://a.com/1", link.format("http://b.com/1")), (2, "https://www.b.com/1/", link.format("/2")), (3, "http://b.com/2#x", None), (4, "http://c.com/bad", ""), (5, "http://blog.c.com/x", None), (6, None, None), (7, "http://d.com/", "<meta http-equiv=refresh content='0; url=http://a.com/1'>"), (7, "http://d.com/", None), (8, "http://e.com", None)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    known = spark.createDataFrame([("http://b.com/2", "http://c.com/bad"), ("http://blog.c.com/x", "http://c.com/bad"), (None, "x")], "src string, dst string")
    got = {(r["page_id"], r["decision"]) for r in redirects.redirect_decisions(p, known, block=("/bad$",), allow=("^http://blog",)).collect()}
    assert got == {(1, "block"), (2, "block"), (3, "block"), (4, "block"), (5, "allow"), (6, "pass"), (7, "block"), (8, "pass")}
    assert redirects.redirect_decisions(p.limit(0)).count() == 0


def test_redirects_odd_pages(spark):
    """Repeated rows, very long and empty URLs, clashing columns, a chain of 40 steps and a loop."""
    long = "http://a.org/" + "x" * 50_000
    rows = [(1, long, None, "x", 1), (1, long, None, "x", 1), (2, "", "", None, 2), (None, "http://spam-farm.example.com/", None, "y", None)]
    rows += [(100 + i, f"http://h{i}.org/", f'<link rel=canonical href="//h{i + 1}.org">', None, i) for i in range(40)] + [(200, "http://h40.org", '<link href="http://spam-farm.example.com" rel="canonical">', None, 0)]
    rows += [(300, "http://l1.org/A", '<link rel="canonical" href="http://l2.org/">', None, 0), (301, "http://l2.org/", '<link rel="canonical" href="http://l1.org/A">', None, 0), (302, "http://l1.org/a?page=2", None, None, 0)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, rule string, node int")
    out = redirects.redirect_decisions(p)
    got = sorted((r["page_id"] or 0, r["decision"]) for r in out.collect())
    assert out.columns == ["page_id", "url", "rule", "decision"]
    assert got == sorted([(1, "pass"), (1, "pass"), (2, "pass"), (0, "block"), (300, "pass"), (301, "pass"), (302, "pass"), (200, "block")] + [(100 + i, "block") for i in range(40)])
    bad = spark.createDataFrame([("l1.org", True, "block"), ("H3.org", False, "block")], "host string, subdomains boolean, rule string")
    got = {r["page_id"] for r in redirects.redirect_decisions(p, hosts=bad).where("decision = 'block'").collect()}
    assert got == {None, 200, 300, 301, 302} | {100 + i for i in range(40)}


def test_links_to_blocked_urls_without_a_page(spark):
    """The links of pages count without a table of redirects, and whether or not what they name has a page."""
    rows = [(1, "http://a.org/", '<meta http-equiv="refresh" content="0; url=http://spam-farm.example.com/x">'), (2, "http://b.org/", '<link rel="canonical" href="http://a.org">'), (3, "http://c.org/", '<link rel="canonical" href="http://d.org/">')]
    out = redirects.redirect_decisions(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["rule"], r["decision"]) for r in out} == {(1, None, "block"), (2, None, "block"), (3, None, "pass")}


def test_normal_form(spark):
    same = ["http://www.A.com/B?ref=1&x=2", "https://a.com:443/B?x=2&utm_source=z#top", "//m.a.com/B/?x=2".replace("/?", "?")]
    other = ["http://a.com/b?x=2", "http://a.com/B?x=2&page=3", "http://a.com/B"]
    rows = spark.createDataFrame([(u,) for u in same + other], "url string").select(redirects.normal_form(F.col("url")).alias("n")).collect()
    assert len({r["n"] for r in rows[:3]}) == 1 and len({r["n"] for r in rows}) == 4


def test_blocked_hosts(spark, tmp_path):
    urls = {
        "block": ["http://spam-farm.example.com", "https://m.CASINO-WIN.example.com:443/a?b=1", "http://blog.adult-x.example.net/x", "http://me@free-bets.example.com/", "http://www.cheap-pills.example.com?ref=x", "ads-track.example.com/1"],
        "pass": ["http://a.org/1?ref=x", "http://blog.a.org/2", "http://a.org/spam-farm.example.com/", "http://a.org/?u=http://spam-farm.example.com/", "http://notspam-farm.example.com/", "http://spam-farm.example.com.a.org/", None],
    }
    rows = [(u, d) for d, us in urls.items() for u in us]
    spark.createDataFrame([(i, u, None) for i, (u, _) in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["decision"] for r in catalog.QUERIES["op5_redirect_equivalence"](spark, str(tmp_path)).collect()}
    assert got == {i: d for i, (_, d) in enumerate(rows)}
    page = spark.read.parquet(f"{tmp_path}/pages.parquet").where("url like '%adult-x%'")
    kept = redirects.redirect_decisions(page, hosts=redirects.host_rules(spark, allowed=["blog.adult-x.example.net"]))
    assert [r["decision"] for r in kept.collect()] == ["allow"]


def test_rules(spark, odd):
    for n, risk, level in ((50, 0.1, 0.05), (400, 0.01, 0.01), (5, 0.01, 0.05), (1000, 0.02, 0.001)):
        k = rules.most_rejections(n, risk, level)
        tail = lambda k: sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        assert (k < 0 or tail(k) <= level) and tail(k + 1) > level
    texts = [prose(30, i) for i in range(4000)] + ["# $ % & " * 20] * 50
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 4000), 0) for i in range(4050)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in rules.risk_controlled(docs, labels).collect()}
    assert not kept & set(range(4000, 4050)) and len(kept) > 4000 * (1 - rules.RISK)
    assert rules.risk_controlled(odd, labels.limit(0)).count() == odd.count()


def test_rules_ties_and_repeats(spark):
    """Labels that repeat count each; a tie at the cutoff is one bucket, never cut in two."""
    texts = ["a b c d e f g h i j" + "!" * (i % 3) for i in range(3000)] + ["!" * 30] * 3
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] * 2, "doc_id long, quality int, toxic int")
    lim = {r["rule"]: r for r in rules.cutoffs(rules.rule_scores(docs), labels).collect()}
    assert lim["marks"]["good"] == 6000
    buckets = {r["doc_id"]: r["marks"] for r in rules.rule_scores(docs).collect()}
    assert lim["marks"]["rejected"] == sum(2 * (buckets[i] >= lim["marks"]["cutoff"]) for i in range(3000))
    kept = {r["doc_id"] for r in rules.risk_controlled(docs, labels).collect()}
    assert all((i in kept) == (j in kept) for i in range(2997) for j in [i + 3])


def test_rules_keep_their_bound():
    """Simulation of the selection: in 4000 worlds a cutoff that rejects too many good documents is chosen in at most a share DELTA."""
    rng, broken, chosen = np.random.default_rng(6), 0, 0
    n, risk, level, share = 400, 0.05, 0.05, 0.01  # each of 20 buckets from the top holds 1 % of the good documents
    room = rules.most_rejections(n, risk, level)
    for _ in range(4000):
        tail = np.cumsum(rng.multinomial(n, [share] * 20 + [1 - 20 * share])[:20])
        over = np.flatnonzero(tail > room)
        safe = int(over[0]) if len(over) else 20  # buckets rejected: up to the first whose tail is too large
        chosen += safe > 0
        broken += safe * share > risk + 1e-9
    assert broken <= level * 4000 and chosen > 3900


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_rules_choose_cutoffs(spark):
    rows = catalog.QUERIES["op6_cutoff_report"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 4 * len(rules.RULES)
    for r in rows:
        assert (r["cutoff"] is None) == (r["good"] < r["needed"]) and (r["cutoff"] is None or r["rejected"] <= 0.02 * r["good"])
    assert any(r["cutoff"] is not None for r in rows)


def test_shares_of_many_sources():
    weights = {f"s{i}": 1.0 / (i + 1) ** 2 for i in range(50_000)}
    shares = mixing.integer_shares(weights, 400_000)
    assert sum(shares.values()) == 400_000 and min(shares.values()) == 1 and shares["s0"] == max(shares.values())
    assert mixing.integer_shares({"a": 2.0, "b": 1.0, "c": 1.0}, 8) == {"a": 4, "b": 2, "c": 2}


def test_mixing_against_brute_force(spark):
    """The whole schedule, slot by slot: earliest deadline first among released blocks, sources starting over."""
    texts = [prose(40, 900 + i) for i in range(120)]
    docs = table(spark, texts, sources=[("a", "b", "c")[0 if i < 80 else 1 if i < 110 else 2] for i in range(120)])
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    shares, blocks, slots = mixing.plan(docs, weights, 600, period=20)
    rows = mixing.pfair_mix(docs, weights, 600, period=20).collect()
    period = sum(shares.values())
    n, want = dict.fromkeys(shares, 0), []
    for t in range(slots):
        ready = [(-(-(n[s] + 1) * period // p), s) for s, p in shares.items() if n[s] * period // p <= t]
        due, s = min(ready)
        assert due > t
        want.append((t, s, n[s] % blocks[s], n[s] // blocks[s]))
        n[s] += 1
        assert all(abs(n[x] - (t + 1) * p / period) < 1 for x, p in shares.items())
    got = {(r["slot"], r["source"], r["block"], r["epoch"]) for r in rows}
    assert got <= set(want)
    held = {(r["source"], r["block"]) for r in rows}  # blocks that no document hashes to have no rows
    assert got == {w for w in want if (w[1], w[2]) in held}
    assert {r["doc_id"] for r in rows} == set(range(120))
    once = mixing.pfair_mix(docs, weights, 600, period=20, max_epochs=1).collect()
    assert sorted(r["doc_id"] for r in once) == list(range(120))


def test_mixing_null_source_with_weights(spark, odd):
    rows = mixing.pfair_mix(odd, {"": 1.0, "s": 3.0}, block_bytes=1000).collect()
    assert {r["source"] for r in rows} == {"", "s"} and sum(r["epoch"] == 0 for r in rows) == odd.count()
    assert {r["source"] for r in mixing.pfair_mix(odd, {"s": 1.0}).collect()} == {"s"}


CLASHING = ["__ll_source", "__ll_slot", "__ll_row", "__lexiloom_spans", "__lexiloom_id", "__lexiloom_gone", "__spans", "__id", "__gone", "__GONE_", "slot", "row", "source_", "of", "block", "epoch", "key", "at", "d", "hub", "digest", "rep", "class_id", "keeper", "group", "bytes", "raw", "shard", "file", "tokens", "stratum", "n", "language", "probability", "copy_id"]


def test_clashing_names(spark):
    """Columns by all names that the operators use inside go through those that return documents, and don't disturb the others."""
    texts = [prose(90, 1), prose(90, 1) + " x", prose(70, 2) + " " + prose(60, 3), prose(60, 4) + " " + prose(60, 3), None, ""]
    plain = table(spark, texts)
    wide = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    model = language.fit([t.encode()[:64] for t in texts[:4]], ["a", "b", "a", "b"], steps=3)

    def rows(df):
        return sorted(map(str, (r.asDict() for r in df.collect())))

    for f in (jaccard.keep_one, passages.cut_repeats, mixing.mixed, lambda d: language.accepted(d, model, least=0.0)):
        a, b = f(plain), f(wide)
        assert b.columns == wide.columns and rows(b.select(plain.columns)) == rows(a)
        assert all(r[c] == f"{c}{r['doc_id']}" for r in b.collect() for c in CLASHING)
    for f in (jaccard.ngram_jaccard_join, packing.pack, sharding.karmarkar_karp_shards, tokens.document_token_counts, mixing.pfair_mix, passages.repeated_passages, digests.canonical_copies, lambda d: language.identify(d, model), rules.rule_scores):
        assert rows(f(wide)) == rows(f(plain))


def test_mixing(spark, odd):
    shares = {"a": 5, "b": 3, "c": 11, "d": 1}
    seen = dict.fromkeys(shares, 0)
    for t, (s, _) in enumerate(mixing.pfair_period(shares), 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * p / 20) < 1 for x, p in shares.items())
    assert seen == shares
    texts = [prose(40, i) for i in range(200)]
    rows = mixing.pfair_mix(table(spark, texts, sources=[f"s{i % 3 if i < 60 else 0}" for i in range(200)]), block_bytes=500).collect()
    assert {r["doc_id"] for r in rows} == set(range(200)) and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    slot_of = {(r["source"], r["block"], r["epoch"]): r["slot"] for r in rows}
    assert len(set(slot_of.values())) == len(slot_of)
    assert mixing.pfair_mix(odd).where("epoch = 0").count() == odd.count()
    assert mixing.mixed(odd).columns == odd.columns


def test_passages(spark, odd):
    shared = prose(80, 99)
    texts = [prose(100, 1) + " " + shared + " " + prose(50, 2), prose(70, 3) + " " + shared.upper() + " " + prose(60, 4), prose(200, 5), shared]
    rows = {r["doc_id"]: r for r in passages.repeated_passages(table(spark, texts)).collect()}
    assert rows.keys() == {1, 3} and rows[1]["kept_in"] == [0]
    assert abs(rows[1]["start_word"] - 70) <= 3 and abs(rows[1]["end_word"] - 150) <= 3
    left = {r["doc_id"]: r for r in passages.cut_repeats(table(spark, texts)).collect()}
    assert left.keys() == {0, 1, 2} and left[0]["text"] == texts[0] and left[2]["text"] == texts[2]
    assert 120 <= len(left[1]["text"].split()) <= 140 and left[1]["n_chars"] == len(left[1]["text"])
    kept = passages.cut_repeats(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 2 and not kept.where("doc_id = 8").count()


def test_passage_spans_of_edited_copies():
    """Against brute force: every range that qualifies meets a span, and every span qualifies."""
    r = np.random.default_rng(7)
    for words_, at in ((60, 28), (90, 43)):
        b = r.integers(0, 1 << 31, words_).astype(np.uint32)
        a = b.copy()
        a[[at, at + 4]] = 1, 2
        assert passages.duplicate_spans(a, b) == [(0, words_)]
    some = none = 0
    for n in (50, 55, 60, 80, 100, 150) * 40:
        b = r.integers(0, 1 << 31, n).astype(np.uint32)
        a = np.where(r.random(n) < r.choice([0.02, 0.06, 0.08, 0.12]), r.integers(0, 1 << 31, n), b)
        a = np.concatenate([r.integers(0, 1 << 31, 20), a, r.integers(0, 1 << 31, 20)]).astype(np.uint32)
        there = {tuple(b[i : i + 3]) for i in range(n - 2)}
        hit = np.array([tuple(a[i : i + 3]) in there for i in range(len(a) - 2)])
        sums = np.concatenate([[0], np.cumsum(hit)])
        good = {(i, j + 2) for i in np.flatnonzero(hit) for j in np.flatnonzero(hit) + 1 if j - i >= 48 and sums[j] - sums[i] >= 0.7 * (j - i) - 1e-9}
        spans = passages.duplicate_spans(a, b)
        assert set(spans) <= good
        assert all(any(s < y and x < e for s, e in spans) for x, y in good)
        some, none = some + bool(good), none + (not good)
    assert some > 50 and none > 20
    parts = [r.integers(0, 1 << 31, k).astype(np.uint32) for k in (200, 120, 200)]  # words of its own between two copies stay
    assert passages.duplicate_spans(np.concatenate(parts), np.concatenate([parts[0], parts[2]])) == [(0, 200), (320, 520)]


def test_passages_whose_first_partner_is_no_copy(spark):
    """B and C share 50 words of which A holds the inner 40; in D the stock phrase stands before what E repeats."""
    texts, copies = [], set()
    for k in range(40):
        shared, stock = prose(50, 5000 + k), prose(45, 7000 + k)
        texts.append(prose(60, 8000 + k) + " " + " ".join(shared.split()[5:45]) + " " + prose(60, 9000 + k))
        texts += [prose(60, 10000 + 2 * k + i) + " " + shared + " " + prose(60, 11000 + 2 * k + i) for i in (0, 1)]
        copies.add(5 * k + 2)
        own = stock + " " + prose(15, 12000 + k)
        texts += [prose(30, 13000 + k) + " " + stock + " " + prose(60, 14000 + k) + " " + own, prose(60, 15000 + k) + " " + own]
        copies.add(5 * k + 4)
    rows = passages.repeated_passages(table(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == copies
    assert all(r["kept_in"] == [r["doc_id"] - 1] for r in rows)
    r = np.random.default_rng(1)
    phrase = r.integers(0, 1 << 31, 30).astype(np.uint32)
    segments = [np.concatenate([phrase, r.integers(0, 1 << 31, 60)]).astype(np.uint32) for _ in range(300)]
    segments[290], segments[299] = segments[3].copy(), np.concatenate([phrase, segments[7][30:55], r.integers(0, 1 << 31, 35)]).astype(np.uint32)
    batch = pa.RecordBatch.from_pydict({"hub": [1] * 300, "side": [5] * 300, "doc_id": list(range(300)), "first": [0] * 300, "tokens": [s.tobytes() for s in segments]})
    got = [x for b in passages._rest(50, 0.7)(iter([batch])) for x in zip(*b.to_pydict().values())]
    assert got == [(290, 0, 90, 3), (299, 0, 55, 7)]


def test_stock_phrase_is_not_compared_by_pairs(monkeypatch):
    """600 segments share 45 words, too few for a passage; only those that share more are compared."""
    r = np.random.default_rng(2)
    phrase = r.integers(0, 1 << 31, 45).astype(np.uint32)
    segments = [np.concatenate([phrase, r.integers(0, 1 << 31, 60)]).astype(np.uint32) for _ in range(600)]
    segments[500] = np.concatenate([segments[20][:70], segments[500][70:]])
    calls, plain = [], passages.duplicate_spans
    monkeypatch.setattr(passages, "duplicate_spans", lambda *a: calls.append(1) or plain(*a))
    batch = pa.RecordBatch.from_pydict({"hub": [1] * 600, "side": [5] * 600, "doc_id": list(range(600)), "first": [0] * 600, "tokens": [s.tobytes() for s in segments]})
    got = [x for b in passages._rest(50, 0.7)(iter([batch])) for x in zip(*b.to_pydict().values())]
    assert got == [(500, 0, 70, 20)] and len(calls) < 600


def test_first_windows_of_keys_in_any_batches():
    r = np.random.default_rng(3)
    rows = sorted({(int(k), int(d), int(p)) for k, d, p in zip(r.integers(0, 40, 400) ** 2 // 40, r.integers(0, 9, 400), r.integers(0, 4, 400))})
    want = []
    for key in {k for k, _, _ in rows}:
        own = [x for x in rows if x[0] == key]
        if len({d for _, d, _ in own}) > 1:
            want += [(*x, *own[0][1:]) for x in own[1:]]
    for size in (1, 3, 50, 1000):
        batches = [pa.RecordBatch.from_pydict({"key": k, "doc_id": d, "pos": p, "lo": p, "hi": p}) for k, d, p in ([list(c) for c in zip(*rows[i : i + size])] for i in range(0, len(rows), size))]
        out = [x for b in passages._met(iter(batches)) for x in zip(*b.to_pydict().values())]
        assert sorted((k, d, p, h, hp) for k, d, p, _, _, h, hp, _, _, _ in out) == sorted(want)
        assert all(sum(k == x[0] for k, _, _ in rows) == 2 for x in out if x[9])


def test_merged_windows():
    key, doc = np.array([5, 5, 5, 7, 5]), np.array([0, 0, 0, 0, 1])
    pos, lo, hi = np.array([9, 3, 40, 4, 3]), np.array([5, 0, 30, 0, 0]), np.array([20, 10, 50, 9, 10])
    got = list(zip(*(x.tolist() for x in passages.merged_windows(key, doc, pos, lo, hi))))
    assert got == [(5, 0, 3, 0, 20), (5, 0, 40, 30, 50), (7, 0, 4, 0, 9), (5, 1, 3, 0, 10)]


def exact_runs(texts, n=50):
    """Starts (doc, word) of the runs of n words that an earlier text has."""
    seen, out = {}, []
    for d, t in enumerate(texts):
        w = t.lower().split()
        for i in range(len(w) - n + 1):
            run = tuple(w[i : i + n])
            if seen.setdefault(run, d) < d:
                out.append((d, i))
    return out


def covered(rows):
    return {(r["doc_id"], i) for r in rows for i in range(r["start_word"], r["end_word"])}


def test_passages_behind_a_worse_copy(spark):
    """Z, A, B: A and B share 64 words; Z, which comes first, has them with words changed, so that the keys lead to it."""
    r, texts = random.Random(8), []
    for k in range(300):
        shared = prose(64, 20000 + k).split()
        worse = [r.choice(WORDS) if r.random() < r.choice((0.1, 0.2, 0.3)) else w for w in shared]
        texts += [prose(40, 21000 + 3 * k + i) + " " + " ".join(x) + " " + prose(40, 23000 + 3 * k + i) for i, x in enumerate((worse, shared, shared))]
    at = covered(passages.repeated_passages(table(spark, texts)).collect())
    runs = exact_runs(texts)
    assert len({d for d, _ in runs}) == 300
    assert all(all((d, i + j) in at for j in range(50)) for d, i in runs)


def test_passages_against_brute_force(spark):
    """200 documents that share passages of 20 to 120 words, some edited.

    Every exact run is found, but for a few words at its ends where an earlier near copy confirmed it; near copies by far most; nothing else.
    """
    r, pool = random.Random(9), [prose(n, 30000 + n) for n in range(20, 121, 4)]
    texts, some = [], []
    for d in range(200):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(prose(r.randint(5, 80), 31000 + len(some)))
            some.append(0)
            w = r.choice(pool).split()
            parts.append(" ".join(r.choice(WORDS) if r.random() < r.choice((0, 0, 0.04, 0.08)) else x for x in w))
        texts.append(" ".join(parts))
    rows = passages.repeated_passages(table(spark, texts)).collect()
    at = covered(rows)
    assert all(sum((d, i + j) in at for j in range(50)) >= 45 for d, i in exact_runs(texts))
    hashes = [passages.words(*passages.text_buffer(pa.array([t.lower()])))[2] >> np.uint64(32) for t in texts]
    right = set()
    for d, a in enumerate(hashes):
        for e in range(d):
            for s, t in passages.duplicate_spans(a.astype(np.uint32), hashes[e].astype(np.uint32)):
                right |= {(d, i) for i in range(s, t)}
    assert len(right & at) >= 0.95 * len(right)
    assert len(at - right) <= 0.01 * len(at)


def test_hot_segment_is_salted(spark, monkeypatch):
    monkeypatch.setattr(passages, "ASKERS", 3)
    shared = prose(70, 40000)
    texts = [prose(20, 41000 + i) + " " + shared + " " + prose(20, 42000 + i) for i in range(40)]
    rows = passages.repeated_passages(table(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == set(range(1, 40)) and all(r["kept_in"] == [0] for r in rows)


def test_digests(spark, odd):
    texts = ["Hello  World", "hello world ", "ﬁne", "FINE", "other", "", " "]
    got = {r["doc_id"]: (r["keeper"], r["copies"]) for r in digests.canonical_copies(table(spark, texts)).collect()}
    want = {0: (0, 2), 1: (0, 2), 2: (2, 2), 3: (2, 2), 4: (4, 1), 5: (5, 2), 6: (5, 2)}
    assert got == want
    clash = digests.canonical_copies(table(spark, texts), hasher=lambda b: b"\0" * 16, broadcast_ids=0)
    assert {r["doc_id"]: (r["keeper"], r["copies"]) for r in clash.collect()} == want
    assert digests.canonical_copies(odd).count() == odd.where("doc_id is not null and text is not null").count()


def test_language_gradients():
    m = language.new_model(["a", "b", "c"], 4, 1)
    m = language.Model(m.languages, *[[w.astype(np.float64) for w in x] for x in (m.tables, m.loops)], m.out.astype(np.float64), m.bias.astype(np.float64))
    ids, sizes, order = language.lanes_of([b"hello", b"abc", b"zq", b"hello!"])
    labels = np.array([0, 1, 2, 1])[order]
    _, grads = language.gradients(m, ids, sizes, labels)
    rng = np.random.default_rng(0)
    for w, g in zip(m.weights(), grads):
        for k in rng.choice(np.flatnonzero(g), 4):
            at = np.unravel_index(k, w.shape)
            old, e = w[at], 1e-2
            ends = []
            for x in (old + e, old - e):
                w[at] = x
                ends.append(language.gradients(m, ids, sizes, labels)[0])
            w[at] = old
            assert abs((ends[0] - ends[1]) / (2 * e) - g[at]) < 2e-3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_language_held_out(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    m = language.train(docs.where("doc_id % 2 = 0"))
    rest = language.identify(docs.where("doc_id % 2 = 1"), m).join(docs.select("doc_id", "lang"), "doc_id")
    assert rest.where("language = lang").count() >= 0.9 * rest.count()
    rows = {r["doc_id"]: r for r in language.identify(odd, m).collect()}
    assert rows[1]["language"] is None and not rows[2]["accepted"] and rows[7]["language"]
    assert language.accepted(odd, m).columns == odd.columns
    runs = language.label_positions(odd, m).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    assert {r["doc_id"]: r["n"] for r in runs.where("doc_id = 7").collect()} == {7: len(odd.where("doc_id = 7").first()["text"])}
    assert language.identify(odd.limit(0)).count() == 0


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for f in (jaccard.ngram_jaccard_join, jaccard.keep_one, packing.pack, sharding.karmarkar_karp_shards, tokens.document_token_counts, mixing.pfair_mix, mixing.mixed, passages.repeated_passages, passages.cut_repeats, digests.canonical_copies, language.accepted):
        assert f(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= kept and (k in (0, 1, 2) or now == kept)
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        kept = now
