"""Edge cases and brute force for the text operators."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geotide.llm import components, decontam, forest, langid, lm, mixing, neardup, resample, spans, toxicity, urls
from geotide.llm.elias_fano import EliasFano
from geotide.llm.queries import QUERIES, RULES
from geotide.llm.words import Block, hash_words, mix, shingles

DOCS = "doc_id long, text string, lang string, source string, score string, matches int, n_removed int, component_id string, key int, _id int"


def words(rs, n):
    return " ".join("".join(rs.choice(["ka", "lo", "mi", "tre", "son", "ubi", "vel", "qua"]) for _ in range(rs.randint(2, 5))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, "x", 1, 1, "x", 1, 1) for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rs = random.Random(3)
    base = words(rs, 60)
    rows = [(k, words(rs, 40) + ".", "aa" if k % 2 else "bb", f"s{k % 3}") for k in range(20)]
    rows += [(100, base, "aa", "s1"), (101, base.upper(), "aa", None), (102, base + " end", "bb", "s1"), (103, base, None, "s2")]
    rows += [(200, None, "aa", "s1"), (201, "", "aa", None), (202, " \n\t ", None, None), (203, "one two", None, "s1"), (204, "one two", "bb", "s2"), (205, "123 !!!", "bb", "s2")]
    rows += [(None, base, "aa", "s1"), (None, None, None, None), (None, words(rs, 30), "bb", "s1")]
    rows += [(300, words(rs, 60000), "aa", "s1")]
    rows += [(0, rows[0][1], rows[0][2], rows[0][3])]  # a repeated row
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_words_match_the_plain_rule():
    text = "Ab  cD\x0b\x0ce f ẞİ ".encode() * 3
    h, a, b = hash_words(text.lower())
    assert [text.lower()[x:y] for x, y in zip(a, b)] == text.lower().split()
    assert len(set(h.tolist())) == len(set(text.lower().split()))
    long = b"ab cd " * 400_000
    assert len(set(hash_words(long)[0].tolist())) == 2 and len(hash_words(long)[0]) == 800_000


def brute_near(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), i if not sets[k] else least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_near_duplicates_equal_brute_force(spark, odd):
    got = neardup.near_duplicates(spark, odd).collect()
    want = brute_near([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_ambiguous_group_equals_brute_force(spark):
    rs = random.Random(8)
    base = words(rs, 80).split()
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rs.randint(1, 4)):
            w[rs.randrange(len(w))] = words(rs, 1)
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark, docs).collect()), key=str)
    assert got == brute_near(rows)


def test_parts_of_a_crowded_bucket_lose_no_link(spark):
    """Buckets that still hold many components, whole and cut in parts, in batches that end within a bucket."""
    rs = random.Random(12)
    base = words(rs, 60).split()
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rs.randint(1, 3)):
            w[rs.randrange(len(w))] = words(rs, 1)
        rows.append((k, " ".join(w)))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_near(rows)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for crowd in (1024, 6):
            got = neardup.near_duplicates(spark, docs, neardup.Settings(crowd=crowd)).collect()
            assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_components(spark, monkeypatch):
    """A long path and random edges: by one task and by steps; few edges take one written table, however long the path."""
    rs = random.Random(13)
    edges = [(k, k + 1) for k in range(3000, 4000)] + [(rs.randrange(600), rs.randrange(600)) for _ in range(400)]
    rs.shuffle(edges)
    root = {k: k for e in edges for k in e if e[0] != e[1]}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    df, written, plain = spark.createDataFrame(edges, "a long, b long").repartition(5), [], components.table
    monkeypatch.setattr(components, "table", lambda s, d, what: written.append(what) or plain(s, d, what))
    assert dict(components.components(spark, df).collect()) == {k: top(k) for k in root} and len(written) == 1
    assert dict(components.components(spark, df, few=0).collect()) == {k: top(k) for k in root} and len(written) > 2
    assert components.components(spark, df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, odd, none):
    left = neardup.one_of_each(spark, odd).collect()
    ids = [r["doc_id"] for r in left]
    assert ids.count(0) == 1 and 100 in ids and not {101, 102, 103, 204} & set(ids) and {200, 201, 202, 205, 300} <= set(ids)
    assert neardup.one_of_each(spark, none).count() == 0


def test_estimate_is_unbiased(spark):
    cfg = neardup.Settings()
    assert cfg.longs == 4
    row = spark.range(1).select(F.array(*[F.lit(k) for k in (1, 2, 3, 4)]).alias("x"))
    assert row.select(neardup.estimate(F.col("x"), F.col("x"), cfg)).first()[0] == 1.0


def test_mixing(spark, odd, none):
    rows = mixing.plan(spark, odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        assert r["taken"] == r["epochs"] * r["size"] + r["part"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    for s, rs in by.items():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 3 * len(rs), s
        assert rs[0]["target"] <= 2 * rs[0]["source_size"]
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * total) < 1e-6 * total
    key = lambda rs: sorted(tuple(map(str, r)) for r in rs)
    assert key(rows) == key(mixing.plan(spark, odd).collect())
    assert mixing.plan(spark, none).count() == 0
    assert mixing.plan(spark, odd, keep=("text", "size", "key", "part")).columns == ["doc_id", "source", "text", "key", "size", "source_size", "target", "epochs", "part", "taken"]
    texts = mixing.repeat(mixing.plan(spark, odd, keep=("text",))).collect()
    assert sum(len((r["text"] or "").split()) for r in texts) == sum(r["taken"] for r in rows)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_urls(spark):
    rows = [
        (1, "http://A.example.com/de/x?q", None), (2, "http://a.example.com/en/", '<a href="http://bad.net/x">'), (3, "https://bad.net/x", ""), (4, "https://good.org/fr/1", "<a HREF = 'https://Friend.org/z'>"),
        (5, "https://friend.org/en/", '<a href=//other.info/a>'), (6, "https://x.example.net/en/1", None), (7, None, None), (8, "no url", None), (9, "http://net", None), (10, "http://friend.org/en/", None), (1, "http://A.example.com/de/x?q", None),
    ]
    got = {r["page_id"]: r for r in urls.judge(spark, pages(spark, rows), RULES).collect()}
    say = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert say[1] == ("a.example.com", "/de/x", "example.com/de/", "block")
    assert say[2] == ("a.example.com", "/en/", None, "block")  # links to a blocked host
    assert say[3] == ("bad.net", "/x", "net/", "block") and say[4][2:] == ("org/fr/", "allow") and say[6][2:] == ("example.net/en/", "allow")
    assert say[5][3] == "allow" and got[5]["trust"] > 0
    assert say[7] == ("", "", None, "allow") and say[8] == ("", "", None, "allow") and say[9] == ("net", "", None, "allow")
    assert urls.judge(spark, pages(spark, []), RULES).count() == 0


def test_page_rank_equals_power_iteration(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1)]
    edges = urls.transitions(spark.createDataFrame(links, "src string, dst string, n long"))
    got = {r["host"]: r["score"] for r in urls.walk(spark, edges, spark.createDataFrame([("a",)], "host string"), damping=0.85, enough=1e-13).collect()}
    p = {"a": 0.15}
    for _ in range(300):
        q = Counter({"a": 0.15})
        for s, d, n in links:
            q[d] += 0.85 * p.get(s, 0) * n / sum(m for x, _, m in links if x == s)
        p = q
    assert all(abs(got[k] - p[k]) < 1e-11 for k in p)
    chain = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(30)], "src string, dst string, n long")
    far = {r["host"]: r["score"] for r in urls.walk(spark, urls.transitions(chain), spark.createDataFrame([("h0",)], "host string"), damping=0.85, enough=1e-6).collect()}
    assert len(far) == 31 and abs(far["h30"] - 0.15 * 0.85**30) < 1e-12


def test_spans_against_brute_force(spark, odd, none):
    rs = random.Random(5)
    passage = " ".join(words(rs, 9) + "." for _ in range(7))
    rows = [(k, words(rs, 30) + ". " + (passage if k % 3 == 0 else "") + " " + words(rs, 25) + ".") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cfg, seen, want = spans.Settings(), {}, {}
    parts = {}
    for i, t in rows:
        b = Block(0, [t.encode()])
        cut = spans.sentence_ends(b, 0, cfg)
        w = t.split()
        for s in range(len(cut)):
            begin = cut[s - 1] if s else 0
            e = next((e for e in range(s + cfg.sentences - 1, len(cut)) if cut[e] - begin >= cfg.words), None)
            if e is not None:
                seen.setdefault(tuple(x.lower() for x in w[begin : cut[e]]), []).append((i, s, e))
        parts[i] = (w, cut)
    gone = {(i, s) for at in seen.values() for i, a, e in sorted(at)[1:] for s in range(a, e + 1)}
    for i, (w, cut) in parts.items():
        want[i] = [x for s in range(len(cut)) if (i, s) not in gone for x in w[cut[s - 1] if s else 0 : cut[s]]]
    got = {r["doc_id"]: r for r in spans.remove_repeats(spark, docs).collect()}
    assert {i: r["text"].split() for i, r in got.items()} == want
    assert got[0]["n_removed"] == 0 and got[3]["n_removed"] >= 5 and got[1]["text"] == rows[1][1]
    out = spans.remove_repeats(spark, odd)
    assert out.count() == odd.count() and len(set(out.columns)) == len(out.columns)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[200] is None and kept[201] == "" and kept[202] == " \n\t "
    assert spans.remove_repeats(spark, none).count() == 0


def test_every_sentence_of_a_repeated_run_goes(spark):
    rs = random.Random(6)
    many = lambda *sizes: " ".join(" ".join(f"w{rs.randrange(10**6)}" for _ in range(k)) + "." for k in sizes)
    end, short, bare = many(15, 8, 8), many(4, 3, 5), " ".join(f"b{rs.randrange(10**6)}" for _ in range(400))
    pool = [many(rs.randint(1, 15)) for _ in range(12)]
    rows = [(0, f"{many(9)} {end} {many(12)}"), (1, f"{many(5)} {end} {many(7)}"), (2, f"{many(6)} {short} {many(6)}"), (3, f"{many(6)} {short} {many(6)}")]
    rows += [(4, many(9) + " " + bare), (5, " ".join(f"c{rs.randrange(10**6)}" for _ in range(100)) + " " + bare + " " + " ".join(f"d{rs.randrange(10**6)}" for _ in range(100)))]
    rows += [(k, " ".join(rs.choice(pool) for _ in range(rs.randint(2, 7)))) for k in range(10, 30)]
    cfg, seen, parts = spans.Settings(), {}, {}
    for i, t in rows:
        block = Block(0, [t.encode()])
        cut, whole = spans.sentences(block, 0, cfg)
        w, begin = t.split(), [0, *cut.tolist()]
        for a in range(len(cut)):
            for b in range(a, min(len(cut), a + 300)):  # all runs, the longest too
                if (b - a + 1 >= cfg.sentences and cut[b] - begin[a] >= cfg.words) or (b - a + 1 >= cfg.several and whole[a : b + 1].all()):
                    seen.setdefault(tuple(w[begin[a] : cut[b]]), []).append((i, a, b))
        parts[i] = (w, begin)
    gone = {(i, k) for at in seen.values() for i, a, b in sorted(at)[1:] for k in range(a, b + 1)}
    got = {r["doc_id"]: r for r in spans.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (w, begin) in parts.items():
        assert got[i]["text"].split() == [x for k in range(len(begin) - 1) if (i, k) not in gone for x in w[begin[k] : begin[k + 1]]], i
    assert got[1]["n_removed"] == 3 == got[3]["n_removed"]
    assert sum(x.startswith("b") for x in got[5]["text"].split()) <= 12


def test_spans_of_rows_that_share_an_id(spark):
    rs = random.Random(7)
    passage, other = (" ".join(words(rs, 9) + "." for _ in range(4)) for _ in range(2))
    rows = [(0, passage, "a"), (1, passage, "b"), (1, other, "c"), (2, "x. " + other, "d"), (5, words(rs, 30) + ".", "e"), (5, "no more", "f"), (None, passage, "g")]
    rows += [(7, other.upper(), "h")] * 3 + [(8, words(rs, 12) + ". " + words(rs, 13) + ".", "i")] * 4
    for ids in ("long", "string"):
        docs = spark.createDataFrame([(i if ids == "long" or i is None else f"k{i}", t, x) for i, t, x in rows], f"doc_id {ids}, text string, n_sentences string").repartition(3)
        docs = docs.withColumnRenamed("n_sentences", "tag")
        got = sorted((r["tag"], r["text"]) for r in spans.remove_repeats(spark, docs).collect())
        by = {tag: [t for x, t in got if x == tag] for tag in "abcdefghi"}
        assert by["g"] == [passage]  # the row without id is first
        assert by["a"] == by["b"] == [""] and by["c"] == [other] and by["d"] == ["x. "], by
        assert by["e"] == [rows[4][1]] and by["f"] == ["no more"] and by["h"] == [""] * 3
        assert sorted(by["i"]) == ["", "", "", rows[-1][1]]


def test_leaks(spark, odd, none):
    rs = random.Random(11)
    items = [(k, words(rs, rs.randint(20, 60))) for k in range(30)] + [(90, "tiny one"), (91, None), (92, "")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    w = items[3][1].split()
    near = list(w)
    near[len(near) // 2] = "changed"
    rows = [(1, words(rs, 33) + " " + items[2][1].upper() + " " + words(rs, 50)), (2, " ".join(near)), (3, " ".join(w[: len(w) // 2])), (4, words(rs, 400)), (5, "so tiny one is"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in decontam.find_leaks(spark, docs, bench).collect()}
    n, m = len(w) - 4, 5
    assert got[1] == [2] and got[2] == ([3] if (n - m) * 100 >= 75 * (n + m) else []) and not got[3] and not got[4] and got[5] == [90] and not got[6] and not got[7]
    small = decontam.Settings(part_chars=1500)  # several blocks
    assert {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in decontam.find_leaks(spark, docs, bench, small).collect()} == got
    out = decontam.find_leaks(spark, odd, bench)
    assert out.count() == odd.count() and len(set(out.columns)) == len(out.columns)
    assert decontam.find_leaks(spark, none, bench.limit(0)).count() == 0


def test_leaks_of_shared_items_do_not_depend_on_blocks(spark):
    rs = random.Random(12)
    item, prompt = [f"w{rs.randrange(10**6)}" for _ in range(50)], [f"p{rs.randrange(10**6)}" for _ in range(30)]
    asks = [[f"q{rs.randrange(10**6)}" for _ in range(30)] for _ in range(8)]
    items = [(k, " ".join(item)) for k in range(10)] + [(20 + k, " ".join(prompt + q)) for k, q in enumerate(asks)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    near, mixed = list(item), prompt + asks[0]
    near[25] = "changed"
    mixed[12] = "changed"
    docs = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(mixed)), (3, " ".join(prompt + item[:30]))], "doc_id long, text string")
    twice = bench.filter("item_id < 2")
    assert [[(m["item_id"], round(m["similarity"], 9)) for m in r["matches"]] for r in decontam.find_leaks(spark, docs.filter("doc_id = 1"), twice).collect()] == [[(0, round(41 / 51, 9)), (1, round(41 / 51, 9))]]
    whole = {r["doc_id"]: r["matches"] for r in decontam.find_leaks(spark, docs, bench).collect()}
    assert {k: [m["item_id"] for m in v] for k, v in whole.items()} == {1: list(range(10)), 2: [20], 3: []}
    for size in (400, 2000):
        assert {r["doc_id"]: r["matches"] for r in decontam.find_leaks(spark, docs, bench, decontam.Settings(part_chars=size)).collect()} == whole


def test_leaks_against_all_windows(spark):
    """Every window of every document against every item by the exact similarity, for edited passages of all lengths."""
    rs = random.Random(13)
    cfg = decontam.Settings()
    items = [(k, words(rs, rs.choice((6, 8, 12, 20, 33, 50, 90)))) for k in range(60)]
    rows = []
    for k in range(170):
        w = items[rs.randrange(60)][1].split()
        for _ in range(rs.choice((0, 1, 1, 2, 3))):
            at = rs.randrange(len(w))
            w[at : at + rs.choice((0, 1))] = [f"z{rs.randrange(10**6)}"] * rs.choice((0, 1))
        rows.append((k, f"{words(rs, rs.randrange(60))} {' '.join(w)} {words(rs, rs.randrange(60))}"))
    all_ = decontam.Items([i for i, _ in items], [t.encode() for _, t in items], cfg)
    want = set()
    for i, t in rows:
        sh = shingles(Block(0, [t.encode()]).words(0), cfg.words)
        for k, (_, text) in enumerate(items):
            n = len(text.split()) - cfg.words + 1
            if any(all_.similarity(k, sh[at : at + n]) >= 0.75 - 1e-9 for at in range(max(1, len(sh) - n + 1))):
                want.add((i, k))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = [{(r["doc_id"], m["item_id"]) for r in decontam.find_leaks(spark, docs, bench, decontam.Settings(part_chars=size)).collect() for m in r["matches"]} for size in (10**6, 900, 300)]
    assert len(want) > 80 and got[0] <= want and len(got[0]) >= 0.98 * len(want) and got[0] == got[1] == got[2]


def test_block_index_misses_nothing():
    rs = np.random.RandomState(1)
    items = rs.randint(0, 256, (300, 8)).astype(np.uint8)
    index = decontam.BlockIndex(items, 23)
    asked = items[:50].copy()
    for row in asked:
        for bit in rs.choice(64, 20, replace=False):
            row[bit // 8] ^= np.uint8(1 << (bit % 8))
    row, item = index.find(asked)
    distance = np.bitwise_count(asked[:, None, :] ^ items[None]).sum(axis=2)
    assert set(zip(row.tolist(), item.tolist())) == set(zip(*[x.tolist() for x in np.nonzero(distance <= 23)]))


def test_elias_fano():
    rs = np.random.RandomState(2)
    for n, u in ((1, 10), (1000, 1 << 63), (5000, 6000), (3000, 10**9)):
        v = np.sort(rs.randint(0, min(u, 2**62), n).astype(np.uint64))
        ef = EliasFano(EliasFano.build(v, u))
        assert (ef.access(np.arange(n)) == v).all()
        x = np.sort(np.concatenate((v[:200], rs.randint(0, min(u, 2**62), 200).astype(np.uint64))))
        at, equal = ef.successor(x)
        assert (at == np.searchsorted(v, x)).all() and (equal == np.isin(x, v)).all()
        begin = rs.randint(0, n, len(x))
        end = np.minimum(n, begin + rs.randint(0, 9, len(x)))
        at, equal = ef.within(x, begin, end)
        for k in range(len(x)):
            part = v[begin[k] : end[k]]
            assert equal[k] == (x[k] in part) and (not equal[k] or v[at[k]] == x[k])


def test_search_in_a_range_costs_no_selection_a_step(monkeypatch):
    rs = np.random.RandomState(4)
    v = np.unique(np.concatenate((rs.randint(0, 1 << 40, 20_000), (1 << 39) + rs.randint(0, 60_000, 30_000)))).astype(np.uint64)
    ef, asked, select = EliasFano(EliasFano.build(v, 1 << 40)), [], EliasFano._select
    monkeypatch.setattr(EliasFano, "_select", lambda self, k, one: (asked.append(len(k)), select(self, k, one))[1])
    x = np.sort(np.concatenate((v[::7], v[::7] + np.uint64(1))))
    begin = rs.randint(0, len(v), len(x))
    for low, high in ((np.zeros_like(begin), np.full_like(begin, len(v))), (begin, np.minimum(len(v), begin + (1 << rs.randint(0, 16, len(x)))))):
        del asked[:]
        at, equal = ef.within(x, low, high)
        place = np.searchsorted(v, x)
        assert (equal == np.isin(x, v) & (place >= low) & (place < high)).all() and (at[equal] == place[equal]).all()
        assert sum(asked) <= 2 * len(x)


def test_scores_do_not_depend_on_blocks(spark, odd, monkeypatch):
    model = lm.fit(spark, odd.filter("doc_id % 2 = 0"), lm.Settings(shard_words=64, shard_tokens=500))
    batch = pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "text": r["text"] and r["text"].encode()} for r in odd.collect()])
    visits, load, got = [], lm.load, []
    monkeypatch.setattr(lm, "load", lambda path, name: (visits.append(name), load(path, name))[1])
    for size in (1, lm._SCORED):
        monkeypatch.setattr(lm, "_SCORED", size)
        del visits[:]
        got.append(([b.to_pylist() for b in lm._score(model)(iter([batch]))], len(visits)))
    assert got[0][0] == got[1][0] and got[1][1] < got[0][1] / 2


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, odd, none, order):
    train = odd.filter("doc_id % 2 = 0 or doc_id is null")
    model = lm.fit(spark, train, lm.Settings(order=order, shard_words=64, shard_tokens=500))
    assert len(model.bounds) > 5 and len(model.first) > 2
    got = lm.score(spark, odd, model).collect()
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    c, b, t3 = Counter(), Counter(), Counter()
    for r in train.collect():
        w = toks(r["text"])
        c.update(w), b.update(zip([None, *w[:-1]], w)), t3.update(zip([None, *w[:-2]], w[:-1], w[1:]))
    n, v = sum(c.values()), len(c)
    k = lambda count: model.cfg.kappa * count**model.cfg.power
    one = lambda x: (c[x] + 1) / (n + v + 1)
    two = lambda u, x: (b[u, x] + k(c[u]) * one(x)) / (c[u] + k(c[u])) if c[u] else one(x)

    def three(s, u, x, first):
        p = two(u, x)
        return p if first or order < 3 or not b[s, u] else (t3[s, u, x] + k(b[s, u]) * p) / (b[s, u] + k(b[s, u]))

    want = {}
    for r in odd.collect():
        w = toks(r["text"])
        base = sum(math.log10(one(x)) for x in w)
        full = sum(math.log10(three(s, u, x, i == 0)) for i, (s, u, x) in enumerate(zip([None, None, *w[:-2]], [None, *w[:-1]], w)))
        want.setdefault((r["doc_id"], len(w)), (sum(c[x] > 0 for x in w), base, full))
    assert len(got) == odd.count()
    for r in got:
        known, base, full = want[r["doc_id"], r["n_tokens"]]
        assert r["n_known"] == known and r["train_tokens"] == n and abs(r["base_score"] - base) < 1e-6 * max(1, -base) and abs(r["score"] - full) < 0.02 * r["n_tokens"], (r, full)
    empty = lm.fit(spark, none)
    assert all(r["n_known"] == 0 and r["score"] == 0 for r in lm.score(spark, odd, empty).collect())


def test_neighbours(spark):
    rs = np.random.RandomState(4)
    x = rs.randn(1200, 16)
    x[100:400] = x[100]  # many equal vectors
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0]), (5200, [None] * 16), (None, [1.0] * 16)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in forest.nearest(spark, table_, every=50, cfg=forest.Settings(search=400, block=64)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    assert set(got) == set(range(0, 1200, 50))
    for q, found in got.items():
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(len(x)), -s))[:5]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        hit += len(set(want.tolist()) & {v for _, v, _ in found})
    assert hit / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in forest.nearest(spark, few, every=50).collect()] == [(0, 1, 1, 0.0)]
    assert forest.nearest(spark, few.limit(0), every=50).count() == 0


def test_neighbours_of_odd_rows(spark):
    """Rows that share an id, huge and tiny components, many queries of one leaf."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0]), (50, [2.0**700, 2.0**700]), (50, [3 * 2.0**-700, 0.0]), (3, [0.0, 5e-324])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in forest.nearest(spark, vectors, every=50, cfg=forest.Settings(k=3, block=2, query_block=2)).collect())
    half = math.sqrt(0.5)
    want = [(0, 1, 50, 1.0), (0, 2, 1, half), (0, 3, 1, half)]  # 1, 1 and 50 tie: the smaller ids
    want += [(50, 1, 0, 1.0), (50, 1, 1, 1.0), (50, 2, 1, 1.0), (50, 2, 1, half), (50, 3, 1, half), (50, 3, 2, 3 / math.sqrt(10))]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])
    same = spark.createDataFrame([(k * 50, [1.0, 2.0, 3.0]) for k in range(300)], "vec_id long, embedding array<float>")
    got = forest.nearest(spark, same, every=50, cfg=forest.Settings(block=64, query_block=64)).collect()
    assert len(got) == 1500 and {r["vec_id"] for r in got if r["query_id"] > 250} == {0, 50, 100, 150, 200}


def test_language(spark, odd, none):
    f = langid.fit(spark, odd)
    got = langid.predict(spark, odd, f, ["doc_id", "text"]).collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(ch.isalpha() for ch in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert langid.predict(spark, odd, langid.fit(spark, none), ["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    clash = langid.predict(spark, odd, f, ["doc_id", "score", "lang_pred", "key"][:2] + ["key"])
    assert clash.columns == ["doc_id", "key", "lang_pred", "score"] and clash.schema["score"].dataType.typeName() == "double"
    many = langid.Filters([f"l{k}" for k in range(130)], [np.arange(k, k + 50, dtype=np.uint64) for k in range(130)], langid.Settings())
    assert len(many.slices) == 3 and many.shares(np.arange(100, 150, dtype=np.uint64)).argmax() == 100


def test_language_equals_plain_sets(spark, odd):
    """The sets are the commonest n-grams by plain counting; the filter's shares those of the sets, but for rare false hits."""
    cfg = langid.Settings(grams=40, least=2)
    rows = [r for r in odd.select("text", "lang").collect() if r["text"] is not None and r["lang"] is not None]

    def plain(text):
        runs = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        padded = f" {runs} "
        return [padded[k : k + 4] for k in range(len(padded) - 3)] if runs else []

    f = langid.fit(spark, odd, cfg)
    for lang in ("aa", "bb"):
        n = Counter(g for r in rows if r["lang"] == lang for g in plain(r["text"]))
        least = sorted(n.values(), reverse=True)[39]
        sure = {g for g, k in n.items() if k > least}
        bit = f.langs.index(lang)
        for text in ("kalo misonka treubi", rows[0]["text"], rows[5]["text"]):
            g = plain(text)
            low, high = sum(x in sure for x in g), sum(n[x] >= least for x in g)
            share = f.shares(langid.grams(text, 4))[bit] * len(g)
            assert low - 1 - 0.05 * len(g) <= share <= high + 1 + 0.05 * len(g)


def test_queries_keep_their_contracts(spark, tmp_path):
    """Every query on a small folder: rows, splits, types."""
    rs = random.Random(31)
    bad = "zwerkop"
    docs = [(k, words(rs, rs.randint(1, 60)) + (f" {bad} " if k % 6 == 0 else " ") + "end.", "aa" if k % 2 else None, f"s{k % 3}", 1) for k in range(200)] + [(500, None, "aa", None, 0), (501, "", None, "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 6 == 0)) for k in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(rs, 20))], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, [float(rs.random()) for _ in range(8)], 0) for k in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "https://A.example.net/en/x?q", "<a href='http://b.org/'>"), (2, None, None), (3, "b.org/fr/", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {name: q(spark, str(tmp_path)).toPandas() for name, q in QUERIES.items()}
    crc = lambda i: zlib.crc32(str(i).encode())
    for name, n, k in (("op1_toxicity", 5, 0), ("op4_language_model", 7, 2), ("op10_language", 3, 1)):
        out = got[name]
        assert sorted(out["doc_id"]) == sorted(d[0] for d in docs) and (out["held_out"] == [crc(i) % n == k for i in out["doc_id"]]).all()
    assert got["op1_toxicity"]["score"].between(0, 1).all() and (got["op1_toxicity"]["predicted"] == (got["op1_toxicity"]["score"] >= 0.5)).all()
    train = [d[1] or "" for d in docs if crc(d[0]) % 7 != 2]
    n = Counter(w for t in train for w in t.lower().split())
    total, distinct = sum(n.values()) + len(train), len(n) + 1
    for r in got["op4_language_model"].itertuples():
        w = (dict((d[0], d[1]) for d in docs)[r.doc_id] or "").lower().split()
        base = sum(math.log10((n[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((len(train) + 1) / (total + distinct + 1))
        assert r.train_tokens == total and r.n_tokens == len(w) + 1 and r.n_known == 1 + sum(n[x] > 0 for x in w) and abs(r.base_score - base) < 1e-6
    langs = dict(zip(got["op10_language"]["doc_id"], got["op10_language"]["lang_pred"]))
    assert langs[500] == langs[501] == "und" and set(langs.values()) == {"aa", "und"}
    assert sorted(got["op7_neighbours"]["query_id"].unique()) == list(range(0, 300, 50)) and len(got["op7_neighbours"]) == 30
    pages = {r.page_id: r for r in got["op2_url_filters"].itertuples()}
    assert (pages[1].host, pages[1].path, pages[1].rule, pages[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow") and pages[2].host == pages[3].host == ""
    mix_ = got["op5_mixing"]
    assert abs(mix_["taken"].sum() / mix_["size"].sum() - 1.5) < 0.1 and (mix_["taken"] <= 2 * mix_["size"]).all()


def test_resampling(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    rows = resample.select(spark, odd, labels).collect()
    assert len(rows) == odd.count() and sum(r["kept"] for r in rows) == int(len(rows) / 2 + 0.5)
    cut = sorted((r["key"] for r in rows), reverse=True)[int(len(rows) / 2 + 0.5) - 1]
    assert all(r["kept"] for r in rows if r["key"] > cut) and not any(r["kept"] for r in rows if r["key"] < cut)
    assert resample.select(spark, none, labels).count() == 0
    assert {r["log_weight"] for r in resample.select(spark, odd, labels.limit(0)).collect()} == {0.0}


def test_exactly_k_rows_are_kept(spark, tmp_path):
    rows = [(k, float(k // 10)) for k in range(40)] + [(100, 7.25)] * 5 + [(None, 1.0)] * 6 + [(200 + k, -0.5) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, key double").repartition(3).write.parquet(f"{tmp_path}/rows")
    written = spark.read.parquet(f"{tmp_path}/rows")
    for k in (0, 1, 3, 5, 15, 27, 28, 31, 53, 54, 60):
        out = resample.top(written, k).collect()
        kept = sorted((r["key"] for r in out if r["kept"]), reverse=True)
        assert len(out) == 54 and kept == sorted((x for _, x in rows), reverse=True)[:k], k
    assert {r["doc_id"] for r in resample.top(written, 15).filter("kept and doc_id < 40").collect()} == set(range(30, 40))


def test_resampling_equals_brute_force(spark, odd):
    """The models' counts and every document's weight against plain counting of hashed words and pairs."""
    cfg = resample.Settings(buckets=1 << 8, share=0.3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(0, 1)], "doc_id long, quality int")
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.select("doc_id", "text").collect()]
    good = {0, *range(1, 20, 2)}

    def grams(t):
        h = [int(x) for x in Block(0, [t]).words(0)]
        pairs = [int(mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:])]
        return [x >> 56 for x in h + pairs]

    count = [Counter(), Counter()]
    for i, t in texts:
        count[0].update(grams(t))
        if i in good:
            count[1].update(grams(t))
    total = [sum(c.values()) + 256 for c in count]
    ratio = [math.log((count[1][g] + 1) / total[1]) - math.log((count[0][g] + 1) / total[0]) for g in range(256)]
    want = sorted(((i is None, i or 0), round(sum(ratio[g] for g in grams(t)), 6)) for i, t in texts)
    out = resample.select(spark, odd, labels, cfg).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), round(r["log_weight"], 6)) for r in out) == want
    assert sum(r["kept"] for r in out) == int(len(out) * 0.3 + 0.5)


@pytest.fixture(scope="module")
def insults(spark):
    rs = random.Random(21)
    bad = ["zwerkop", "miflunt"]
    rows, labels = [], []
    for k in range(400):
        t = words(rs, 60).split()
        if k % 4 == 0:
            t[rs.randrange(60)] = rs.choice(bad)
        rows.append((k, " ".join(t)))
        labels.append((k, int(k % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0), (None, 1), (2, None)], "doc_id long, toxic int")


def test_toxicity(spark, insults, odd, none):
    docs, labels = insults
    model = toxicity.fit(spark, docs, labels)
    tries = ["so Zwerkop here", "you z-w-e-r-k-o-p", "a zwerrkop", "zwerxkop now", "z w e r k o p!", "m1flunt", "miflunts", "kalo misonka treubi", "", None]
    out = model.score(toxicity.views([t.encode() if t is not None else None for t in tries], model))
    assert [x >= 0.5 for x in out] == [True] * 7 + [False] * 3
    got = toxicity.score(spark, odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r["_gt_score"] < 0.5 for r in got)
    plain = toxicity.fit(spark, docs, labels.limit(0))
    assert plain.base == 0.0 and {r["_gt_score"] for r in toxicity.score(spark, odd, plain, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(spark, none, model, ["doc_id"]).count() == 0
    alone = toxicity.fit(spark, none, labels)
    assert alone.weights is None and 0 < alone.base < 1


def test_views_do_not_depend_on_neighbours(spark, insults):
    model = toxicity.fit(spark, *insults)
    other = toxicity.fit(spark, insults[0], insults[1], toxicity.Settings(decay=0.5))
    texts = [b"so zwerkop here", None, b"z w e r k o p " + b"lo " * 2000, "é è ê kalo".encode(), b"", b"kalo z w e"]
    together = toxicity.views(texts, model)
    toxicity.views(texts, other)  # another model in the same worker
    assert np.array_equal(together, np.concatenate([toxicity.views([t], model) for t in texts]))
    assert together[1].tolist() == together[4].tolist() == [-2.0, 0.0] and together[2, 0] > 0


def test_families_of_rare_insults_are_learned(spark):
    """Each form of a family is rare, and clean texts of another alphabet have parts of it."""
    rs = random.Random(22)
    parts = ["жу", "ки", "ло", "ма", "но", "пе", "ра", "су"]
    word = lambda: "".join(rs.choice(parts) for _ in range(rs.randint(2, 5)))
    rows, labels = [], []
    for k in range(2400):
        t = [word() for _ in range(60)]
        if k % 6 == 0:
            for at in rs.sample(range(60), 3):
                t[at] = "фыгло" + word()
        rows.append((k, " ".join(t)))
        labels.append((k, int(k % 6 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(spark, docs.filter("doc_id % 5 <> 0"), labels.filter("doc_id % 5 <> 0"))
    out = toxicity.score(spark, docs.filter("doc_id % 5 = 0"), model, ["doc_id"])
    assert out.filter("(_gt_score >= 0.5) <> (doc_id % 6 = 0)").count() <= 5


def test_many_rare_insults_are_learned(spark):
    rs = random.Random(22)
    bad = list(dict.fromkeys("".join(rs.choice(c) for c in ("zxw", "yu", "pfg", "yeu", "zxw", "gbp", "uy", "tnd")) for _ in range(140)))
    rows, labels = [], []
    for k in range(8000):
        t = words(rs, 40).split()
        if k % 8 == 0:
            t[rs.randrange(40)] = bad[k // 8 % 71] if k % 5 else bad[0]  # one common and 70 rare ones, one a document
        rows.append((k, " ".join(t)))
        labels.append((k, int(k % 8 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, labels, toxicity.Settings(per_label=400))
    assert toxicity.score(spark, docs, model, ["doc_id"]).filter("(_gt_score >= 0.5) <> (doc_id % 8 = 0)").count() <= 8


def test_kernel_equals_brute_force():
    cfg = toxicity.Settings()
    strings = ["idiotic", "banana", "aaaa", "xyz", "idxiotic", "жуки"]

    def brute(s):
        s, out = "^" + s + "$", Counter()
        for a in range(len(s)):
            for b in range(a + 1, len(s)):
                for c in range(b + 1, len(s)):
                    for d in range(c + 1, min(len(s), a + cfg.span)):
                        out[s[a] + s[b] + s[c] + s[d]] += cfg.decay ** (d - a - 3)
        return out

    want = np.array([[sum(x[k] * y[k] for k in x) for y in map(brute, strings)] for x in map(brute, strings)])
    norm = toxicity.norms(strings, cfg)
    land = toxicity.Landmarks(strings, toxicity.Settings())
    got = land.kernel(strings)
    assert np.allclose(got, want / norm[:, None] / norm[None, :], atol=2e-3)
    assert np.allclose(toxicity.project(strings, land.expand(np.ones(6)), toxicity.Settings()), got.sum(axis=1), atol=1e-5)
    assert np.isclose(want[3, 3], norm[3] ** 2)  # no letter repeated


def test_shingles_of_short_texts():
    b = Block(0, [b"one two", b"", b"a b c d e f"])
    assert [len(shingles(b.words(i), 5)) for i in range(3)] == [1, 0, 2]
    assert zlib.crc32(b"7") >= 0
