"""Each corpus operator on small fixtures: plain cases, edges and a brute-force version."""

import hashlib
import random
import re
import zlib
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat_format, decontaminate, fitting, line_dedup, ngram_join, piece_bpe, quality, sharding, tables, topk, toxicity, url_filter
from tidewatch.sources import shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, score string")


def _words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1 -------------------------------------------------------------------------------------


def test_preference_format(spark):
    t = "array<struct<role:string,text:string>>"
    a, b, c = ("user", "q"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [a, b], [a, c]), (2, [a, b], [a, b]), (3, [a], [a, b]), (4, None, [a]), (5, [], []), (6, [b], [c])]
    pairs = spark.createDataFrame(rows, f"id int, chosen {t}, rejected {t}").withColumn("prompt", F.lit("clash"))
    got = {r["id"]: r for r in chat_format.format_pairs(pairs).collect()}
    assert [got[k]["n_prompt_turns"] for k in range(1, 7)] == [1, 2, 1, 0, 0, 0]
    assert got[1]["prompt"] == "<|user|>\nq<|end|>\n" and got[1]["chosen"] == "<|assistant|>\nyes<|end|>\n"
    (s,) = got[1]["rejected_spans"]
    assert got[1]["rejected"][s["start"] : s["end"]] == "no<|end|>"
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["chosen_spans"] == []
    assert got[4]["rejected_spans"] == [] and got[4]["rejected"].startswith("<|user|>")


def test_conversations_order_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (1, None, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (one,) = chat_format.conversations(turns).collect()
    assert [(t["role"], t["text"]) for t in one["turns"]] == [("system", "s"), ("user", ""), ("assistant", "b")]
    assert chat_format.format_pairs(chat_format.replies_borrowed(turns)).count() == 1
    assert chat_format.format_pairs(chat_format.replies_borrowed(turns.limit(0))).count() == 0


def test_every_conversation_makes_a_pair(spark):
    rows = [(k, i, role, f"{role} {k}") for k in (2, 4, 5, 8, None) for i, role in enumerate(("user", "assistant"))] + [(6, 0, "user", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.format_pairs(chat_format.replies_borrowed(turns)).collect()}
    assert set(got) == {2, 4, 5, 6, 8, None}
    assert "assistant 5" in got[4]["rejected"] and "assistant 4" in got[5]["rejected"]
    for k in (2, 8, None):
        assert got[k]["chosen"] == f"<|assistant|>\nassistant {k}<|end|>\n" and got[k]["rejected"].startswith("<|assistant|>\nassistant ") and got[k]["rejected"] != got[k]["chosen"]
    assert got[6]["chosen"] == got[6]["rejected"] == "" and got[6]["n_prompt_turns"] == 1
    (one,) = chat_format.format_pairs(chat_format.replies_borrowed(turns.where("conv_id = 2"))).collect()
    assert one["chosen"] and one["rejected"] == "" and one["n_prompt_turns"] == 1


# 2 -------------------------------------------------------------------------------------


def _bm25(items, passage_terms, k1=decontaminate.K1, b=decontaminate.B):
    """Shares of all items for a set of words, by the formula."""
    lists = {i: WORD.findall(t.lower()) for i, t in items.items()}
    lists = {i: w for i, w in lists.items() if w}
    n, average = len(lists), sum(map(len, lists.values())) / len(lists)
    df: dict[str, int] = {}
    for w in lists.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = {}
    for i, w in lists.items():
        impact = {x: np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (k1 + 1) / (w.count(x) + k1 * (1 - b + b * len(w) / average)) for x in set(w)}
        out[i] = sum(v for x, v in impact.items() if x in passage_terms) / sum(impact.values())
    return out


@pytest.mark.parametrize("slice_items", [20_000, 7])
def test_leaks_equal_brute_force(spark, slice_items):
    rng = random.Random(5)
    items = {k: _words(rng, rng.randrange(3, 40)) + ". " + _words(rng, rng.randrange(1, 6)) + "." for k in range(24)} | {90: "", 91: "one two."}
    texts = [_words(rng, 90) for _ in range(30)]
    texts += [_words(rng, 30) + " " + items[k].upper() + " " + _words(rng, 30) for k in range(12)]
    texts += [" ".join(items[k].split()[:-4]) for k in range(6)] + [None, "", "one two. three", _words(rng, 3000) + " " + items[3] + " " + _words(rng, 3000)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    split = {r["item_id"]: (r["question"], r["answer"]) for r in decontaminate.split_items(bench).collect()}
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(_docs(spark, enumerate(texts)), decontaminate.split_items(bench), slice_items=slice_items).collect()}
    longest = max(len(WORD.findall(t)) for t in items.values())
    width = 2 * max(64, longest)
    want = {}
    for d, text in enumerate(texts):
        w = WORD.findall((text or "").lower())
        for a in range(0, max(1, -(-(len(w) - width) // (width // 2)) + 1) * (width // 2), width // 2) if w else []:
            p = w[a : a + width]
            for i, share in _bm25(items, set(p)).items():
                q, an = (WORD.findall(x.lower()) for x in split[i])
                n = min(5, len(q))
                qs, ps = ({tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (q, p))
                if share >= 0.6 and len(qs & ps) / len(qs) >= 0.75 and len(set(an) & set(p)) / len(set(an)) >= 0.75:
                    want[d, i] = max(share, want.get((d, i), 0))
    assert set(got) == set(want) and len(want) >= 13
    assert all(abs(got[k]["bm25_share"] - v) < 1e-9 for k, v in want.items())


def test_leaks_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c.")], "item_id long, text string")
    assert decontaminate.find_leaks(_docs(spark, []), decontaminate.split_items(bench)).count() == 0
    assert decontaminate.find_leaks(_docs(spark, [(1, "a b c.")]), decontaminate.split_items(bench.limit(0))).count() == 0


# 3 -------------------------------------------------------------------------------------


def test_quality_learns_and_scores_edges(spark):
    rng = random.Random(3)
    rows = [(k, _words(rng, 60)) if k % 3 else (k, " ".join(w + "%%%" for w in _words(rng, 60).split())) for k in range(240)]
    edges = [(1000, None), (1001, ""), (1002, "   "), (1003, "x" * 300_000), (1003, "x" * 300_000), (None, "w1 w2")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(240)], "doc_id long, quality int")
    docs = _docs(spark, rows + edges)
    machine = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = quality.score(docs, machine).collect()
    assert len(got) == 246 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 5 == 0]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= len(held) - 1
    assert len({r["score"] for r in got if r["doc_id"] == 1003}) == 1


def test_pairs_by_sum_of_squares_equal_pairs_one_by_one():
    m = quality.Machine(np.zeros(quality.STATS), np.ones(quality.STATS))
    rng = np.random.default_rng(1)
    m.w, m.v = rng.normal(size=m.w.shape).astype(np.float32), rng.normal(size=m.v.shape).astype(np.float32)
    index, value = np.array([3, 70, 900, (1 << quality.BITS) + 2], np.int32), np.array([0.5, -1.0, 2.0, 0.25], np.float32)
    x = m._standard(index, value)
    want = sum(m.w[i] * v for i, v in zip(index, x, strict=True)) + sum(float(m.v[index[a]] @ m.v[index[b]]) * x[a] * x[b] for a in range(4) for b in range(a))
    assert abs(m.parts(index, value, np.array([0, 4]))[3][0] - want) < 1e-3


def test_quality_without_labels(spark):
    docs = _docs(spark, [(1, "a b"), (2, None)])
    machine = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality.score(docs, machine).count() == 2 and quality.score(docs.limit(0), machine).count() == 0


# 4 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [{}, {"shapes": 0}, {"shapes": 0, "broadcast_rules": 0}])
def test_url_rules_equal_brute_force(spark, limits):
    rng = random.Random(2)
    hosts = ["example.org", "a.b.example.ORG", "org", "x.com", "badexample.org", "de.com", "com", "", "a..org", "org.", ".".join("abcdefghij")]
    paths = ["/", "", "/es/x", "/en/1", "/en/12?q=/de/", "/fr/a#b", "/de/", "/de", "/en/\n1", "//fr/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "ab://c") for h in hosts for p in paths] + [None, "", "example.org/es/", "http:/example.org/", "x://org?u=://com/fr/", "http://example.org/es/" + "y" * 5000]
    urls += [rng.choice(urls) for _ in range(10)]
    pages = spark.createDataFrame([(k % 50 if k % 7 else None, u, "x") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = sorted(((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rules_table(spark), **limits).collect()), key=str)
    want = []
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([len(rest)] + [rest.index(c) for c in "/?#" if c in rest])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([len(tail)] + [tail.index(c) for c in "?#" if c in tail])]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        want.append((str(k % 50 if k % 7 else None), host, path, best[2], best[3]))
    assert got == sorted(want, key=str)


def test_url_filter_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://org/"), (1, "http://org/")], "page_id long, url string")
    got = url_filter.judge(pages, url_filter.rules_table(spark).limit(0), default="block").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [(None, "block")] * 2
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).count() == 0


# 5 -------------------------------------------------------------------------------------


def _components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def _corpus(seed, n=40):
    rng = random.Random(seed)
    base = [_words(rng, rng.randrange(4, 120), 3000).split() for _ in range(n)]
    passage = _words(rng, 60, 3000).split()
    out = []
    for k, w in enumerate(base):
        out.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 2, 4])):
                v[rng.randrange(len(v))] = f"z{rng.randrange(99)}"
            out.append(" ".join(v))
        if k % 2:
            out.append(" ".join(w[: rng.randrange(0, 30)] + passage))
    out += [None, "", "  ", "A b", "a  B", "one", "x " * 3000]
    big = _words(rng, 100, 3000).split()
    for _ in range(60):  # more than a small row: pivots and rounds take over
        v = list(big)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            v[rng.randrange(len(v))] = f"q{rng.randrange(9999)}"
        out.append(" ".join(v))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components_equal_brute_force(spark, seed):
    rows = _corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(_docs(spark, rows)).collect()}
    assert got == _components(rows)


def test_ngram_join_edges(spark):
    assert ngram_join.near_duplicates(_docs(spark, [])).count() == 0
    got = ngram_join.near_duplicates(_docs(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [("4", 0, "4"), ("5", 2, "5"), ("5", 2, "5"), ("None", 2, "None")]


def test_ngram_join_tells_texts_of_one_doc_id_apart(spark):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, one), (5, two), (7, one + " more"), (6, two + " more")]
    for order in (rows, rows[::-1]):
        got = ngram_join.near_duplicates(_docs(spark, order)).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (5, 5), (6, 5), (7, 5)]


def test_every_ngram_is_counted(spark):
    text = " ".join(f"w{k}" for k in range(100))
    grams, _ = ngram_join.frequent(_docs(spark, [(k, f"{text} x{k}") for k in range(10)]), 4)
    assert len(grams) == 96


def test_passes_and_parts_change_nothing(spark, monkeypatch):
    for name, value in (("PASS_BYTES", 100), ("MOST_PASSES", 2), ("TASKS_BYTES", 60_000), ("BLOCK_NODES", 32), ("RUN_PAIRS", 50), ("BLOCK_GRAMS", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = _corpus(3, 6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(_docs(spark, rows)).collect()}
    assert got == _components(rows)


def test_copies_are_not_sent(spark):
    """Of equal sets one text is read for the product, and few tables stay."""
    text = " ".join(f"w{k}" for k in range(100))
    docs = _docs(spark, [(k, text) for k in range(30)] + [(None, "a b c d e f")]).repartition(5)
    nodes = ngram_join._distinct(ngram_join.members(docs))[0]
    kept = spark.sparkContext.broadcast(ngram_join._filter_bits(nodes))
    grams, _ = ngram_join.frequent(docs, 4, kept=kept)
    packed = ngram_join.incidence(docs, (grams, grams[:0].view("u1")), 4, 75, kept=kept)
    assert len(grams) == 0 and packed.agg(F.sum(F.length("grams"))).first()[0] == 8 * (96 - 72 + 1)
    with shared.scope(spark):
        ngram_join.near_duplicates(docs)
        assert sum(shared.exists(spark, path) for path in shared._scopes[-1]) <= 5


def test_prefixes_fill_all_blocks(spark):
    docs = _docs(spark, [(k, " ".join(f"w{k}x{j}" for j in range(300))) for k in range(20)])
    sizes = {r["block"]: len(r["grams"]) for r in ngram_join.incidence(docs.coalesce(1), (np.zeros(0, "u8"), np.zeros(0, "u1")), 8, 75).collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 2 * min(sizes.values())


def test_components_of_long_chains(spark):
    rows = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}


def test_components_by_levels(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LAST_EDGES", 3)
    monkeypatch.setattr(ngram_join, "FOREST_EDGES", 5)
    rng = random.Random(3)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1001 + k) for k in range(150)]
    root = {x: x for r in rows for x in r}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(rows, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root}


def test_sets_of_one_name_stay_apart(spark, monkeypatch):
    import hashlib

    def names(grams):
        d = hashlib.blake2b(grams.tobytes(), digest_size=8).digest()
        return len(grams) % 3, int.from_bytes(d, "little", signed=True)

    monkeypatch.setattr(ngram_join, "_names", names)
    monkeypatch.setattr(ngram_join, "_node", lambda grams, clashes: names(grams)[names(grams)[0] in clashes])
    rows = _corpus(5, 12)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(_docs(spark, rows)).collect()}
    assert got == _components(rows)


def test_hot_keys_are_salted(spark):
    rows = spark.range(100).selectExpr("id as v", "if(id < 70, 1, id) as k")
    lookup = spark.createDataFrame([(1, "a"), (80, "b")], "k long, w string")
    parts = tables.hot(rows, "k", 20)
    assert [tuple(r) for r in parts.collect()] == [(1, 4)]
    got = {r["v"]: r["w"] for r in tables.salted(rows, lookup, "k", F.col("v"), parts, "left").collect()}
    assert got == {v: "a" if v < 70 else "b" if v == 80 else None for v in range(100)}


# 6 -------------------------------------------------------------------------------------


def test_bounded_ring(spark):
    rng = random.Random(4)
    rows = [(k, _words(rng, rng.randrange(0, 60))) for k in range(600)] + [(1000 + k, "hot text " * 9) for k in range(500)] + [(None, "n"), (7, "n"), (2000, None), (2001, ""), (2002, "é" * 2000)]
    got = sharding.bounded_shards(_docs(spark, rows), shards=6, vnodes=16).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    loads, slots = [0] * 6, {}
    for r in got:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        if r["doc_id"] not in (None, 7):
            raw = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(loads) / 6
    assert max(loads) <= mean * 1.02 + 4008 and min(loads) >= mean * 0.9
    assert sharding.bounded_shards(_docs(spark, [])).count() == 0


def test_equal_texts_stay_together_where_a_shard_has_room(spark):
    rng = random.Random(6)
    texts = [_words(rng, 40, 3000) for _ in range(700)]
    rows = [(20 * k + j, t) for k, t in enumerate(texts) for j in range(rng.choice([1, 2, 3]))]
    got = sharding.bounded_shards(_docs(spark, rows), shards=8, vnodes=16).collect()
    where, loads = {}, [0] * 8
    for r in got:
        where.setdefault(r["doc_id"] // 20, set()).add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert len(got) == len(rows) and all(len(s) == 1 for s in where.values())
    assert max(loads) <= sum(loads) / 8 * 1.02 + 1 and min(loads) >= sum(loads) / 8 * 0.9


def test_groups_move_whole_or_not_at_all():
    pieces = [(0, 100, 0), (100, 200, 1), (200, 300, 2)]
    room = np.array([5, 20, 0])
    assert sharding.keep_groups(pieces, room, [(90, 110, 7)]) == {7: 1} and room.tolist() == [15, 10, 0]  # the shard of its head has no room
    room = np.array([0, 0, 0])
    assert sharding.keep_groups(pieces, room, [(90, 110, 7), (120, 140, 8)]) == {} and room.tolist() == [0, 0, 0]


def test_walk_keeps_capacity_and_order():
    ring = sharding.Ring(4, 8)
    loads = np.random.default_rng(2).integers(0, 1000, len(ring.owner))
    loads[5] = 20_000
    capacity = -(-int(loads.sum()) // 4)
    pieces = sharding.walk(ring, loads, capacity)
    held = [0] * 4
    for a, b, s in pieces:
        held[s] += b - a
    assert max(held) <= capacity and sum(held) == loads.sum()
    assert all(x[1] == y[0] for x, y in zip(pieces, pieces[1:], strict=False))


def test_ring_moves_little_when_a_shard_joins():
    place = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    few, more = sharding.Ring(8, 64), sharding.Ring(9, 64)
    a, b = few.owner[few.arcs(place)], more.owner[more.arcs(place)]
    assert set(b[a != b].tolist()) == {8} and 0.04 < (a != b).mean() < 0.25


# 7 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup_equals_brute_force(spark, limit):
    rng = random.Random(6)
    common = [f"  This Is A Common Line number {k} that is rather long indeed " + "é" * k for k in range(12)]
    rows = []
    for d in range(60):
        lines = [rng.choice(common) for _ in range(rng.randrange(0, 5))] + [f"own line {d} " * rng.randrange(1, 6), "short"]
        lines = [x.upper() if rng.random() < 0.3 and x.isascii() else x for x in lines]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "é" * 40), (59, rows[59][1])]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    held: dict[str, set] = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != d)]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(_docs(spark, rows).withColumn("n_lines", F.lit("clash")), shard_keys=4, broadcast_bytes=limit).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == sorted(want)
    assert any(w[2] for w in want) and line_dedup.dedup_lines(_docs(spark, [])).count() == 0


def test_minimal_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64)
    mph = line_dedup.build(np.unique(keys))
    assert sorted(line_dedup.slots(mph, np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))
    assert len(line_dedup.slots(line_dedup.build(keys[:0]), keys)) == 5000


# 8 -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())


def test_piece_bpe_equals_the_library(spark, library):
    rng = random.Random(8)
    alphabet = "abcdeilnorstuAT .,=-_/\n\t▁()0189日漢éñ🎉̂"
    texts = [None, "", " ", "  a  ", "▁", "a▁b", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 70 + "x", "\x00", "日本語", "the quick brown fox\n\njumps", "https://a.example/b?c=1", "x" * 50_000, "ab" * 20_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    docs = _docs(spark, enumerate(texts)).withColumn("ids", F.lit("clash"))
    got = piece_bpe.decode(piece_bpe.encode(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
    for r in piece_bpe.round_trip(docs.limit(100)).collect():
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_bpe.encode(docs.limit(0)).count() == 0


def test_only_models_that_change_nothing_are_taken(tmp_path, monkeypatch):
    assert len(piece_bpe.supported(piece_bpe.default_model())) == len(piece_bpe.vocabulary(piece_bpe.default_model()))
    piece_bpe.supported.cache_clear()
    monkeypatch.setattr(piece_bpe, "_prepared", lambda column: column)  # as if the model put no blank in front
    with pytest.raises(ValueError):
        piece_bpe.supported(piece_bpe.default_model())
    piece_bpe.supported.cache_clear()


def test_decoding_of_any_ids(library):
    pieces, rng = piece_bpe.Pieces(piece_bpe.vocabulary(piece_bpe.default_model())), random.Random(9)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), 0, 1, 2, 259, 29_871]) for _ in range(rng.randrange(7))]
        assert pieces.decode(np.array(ids, np.int64)) == library.decode(ids)


# 9 -------------------------------------------------------------------------------------


def _inner(x, y):
    q = [[floor(256 * float(np.float32(v))) for v in w] for w in (x, y)]
    return sum(a * b for a, b in zip(*q, strict=True))


def test_top_k_keeps_rows_that_repeat_a_vec_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (3, [0.1, 5e9])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ranked = lambda rows: sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in topk.top_k(frame(rows)).collect())
    assert ranked(rows) == sorted(map(str, [(0, 1, 1, 65536), (0, 2, 1, 32768), (0, 3, 3, 6400)]))
    rows = [(50, [1.0]), (50, [1.0])] + [(k, [k / 100]) for k in range(1, 12)]
    best = [(50, 1, 50, 65536)] + [(50, r, v, 256 * (256 * v // 100)) for r, v in zip((2, 3, 4, 5), (11, 10, 9, 8), strict=True)]
    assert ranked(rows) == sorted(map(str, best * 2))  # each of two equal query rows has the other and four more


def test_top_k_of_very_large_components(spark):
    rows = [(0, [3e9, 1.0]), (1, [4e9, 0.0]), (2, [-4e9, 2.0]), (3, [0.0, 1.0]), (4, [1e6, 0.0]), (100, [0.0, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    q = {k: [floor(256 * x) for x in v] for k, v in rows}
    want = []
    for a in (0, 100):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a)[:5]
        want += [(a, k + 1, b, -s if abs(s) < 1 << 63 else None) for k, (s, b) in enumerate(best)]
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str) == sorted(want, key=str) and None in [w[3] for w in want]


def test_max_score_passes_over_what_cannot_compete():
    rng = np.random.default_rng(8)
    x = rng.integers(-40, 40, (4000, 32)) * (np.arange(32) < 6) + rng.integers(-3, 4, (4000, 32))
    for kind in (np.float64, np.int64):
        search = topk.Search(np.arange(20), x[:20].astype(kind), 5).seed()
        for k in range(0, len(x), 500):
            search.shard(np.arange(k, k + 500), np.arange(k, k + 500), x[k : k + 500].astype(kind))
        score = x[:20] @ x.T
        score[np.arange(20), np.arange(20)] = -(10**9)
        want = [sorted(zip(-row, range(4000), strict=True))[:5] for row in score]
        assert [[(-s, v) for s, v in zip(search.score[k].astype(int), search.held[k], strict=True)] for k in range(20)] == want
        assert search.work < 0.5 * 20 * x.size  # most components are never looked at


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 0.2, 12).astype(np.float32).tolist()) for k in range(400)] + [(k, [0.5] * 12) for k in range(400, 460)]
    bad = [(600, None), (650, [float("nan")] * 12), (700, [None] + [0.1] * 11), (750, [float("inf")] * 12), (None, [0.1] * 12), (800, []), (850, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    every = rows + rows[:3]
    want = {}
    for i, (a, x) in enumerate(every):
        if a % 50 == 0:
            pairs = sorted((-_inner(x, y), b) for j, (b, y) in enumerate(every) if j != i)[:5]
            want[a] = sorted([*want.get(a, []), *((k + 1, b, -s) for k, (s, b) in enumerate(pairs))])
    for limits in ({}, {"shard_rows": 7, "slice_bytes": 300}):
        got = {}
        for r in topk.top_k(vectors, **limits).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {k: sorted(v) for k, v in got.items()} == want
    assert topk.top_k(vectors.limit(0)).count() == 0 and topk.top_k(vectors.where("vec_id = 100")).count() == 0


# samples -------------------------------------------------------------------------------


def test_training_samples_are_bounded_in_rows_and_bytes(spark):
    docs = _docs(spark, [(k, "w" * (10 + k)) for k in range(200)] + [(7, "again " * 3)] * 300 + [(8, "x" * 5000)] + [(9, None), (None, "n")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(5, None)], "doc_id long, quality int")
    take = lambda **limits: fitting.sample(docs, labels, "quality", F.lit(True), **limits).collect()
    every = take(most=1000)
    assert len(every) == len({r["doc_id"] for r in every}) == 200 and {r["doc_id"]: r["y"] for r in every} == {k: k % 2 for k in range(200)}
    few = take(most=1000, most_bytes=4000)
    assert 0 < len(few) < 200 and sum(len(r["text"]) for r in few) <= 4000 and take(most=1000, most_bytes=4000) == few
    assert 20 < len(take(most=60)) < 120
    machine = quality.train(docs, labels, F.lit(True))
    rows = quality.score(docs.limit(50), machine).collect()
    data = ["".join(r["text"] or "") for r in rows]
    index, value, starts = quality.features(*(lambda d: (d[0], d[1]))(flat_texts(data)))
    for r, a, b in zip(rows, starts[:-1], starts[1:], strict=True):  # every pair of features, one by one
        x = machine._standard(index[a:b], value[a:b]).astype(float)
        v = machine.v[index[a:b]].astype(float) * x[:, None]
        pairs = sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i + 1, len(v)))
        z = machine.bias + float(machine.w[index[a:b]] @ x) + pairs
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-4


def flat_texts(texts):
    import pyarrow as pa

    from tidewatch.llm.text import flat

    return flat(pa.array(texts, pa.string()))


# 10 ------------------------------------------------------------------------------------


def test_gradients_of_the_network():
    net = toxicity.Network(seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x, windows = rng.normal(size=(9, 2 * toxicity.EMBED)), rng.integers(0, 9, (4, 6)).astype(np.int32)
    windows[1, 4:] = windows[2, 1:] = -1
    target = rng.normal(size=4)
    loss = lambda: 0.5 * ((net.run(x.astype(np.float64), windows) - target) ** 2).sum()
    logits, kept = net.run(x, windows, keep=True)
    grads, dx = net.gradients(x, windows, kept, logits - target)
    for name in ("out", "att_v", "att_w", "f_w", "f_u", "f_b", "b_w", "b_u", "b_b"):
        flat, at = net.p[name].reshape(-1), rng.integers(0, net.p[name].size, 4)
        for k in at:
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[k]) < 2e-2 * max(1, abs(grads[name].reshape(-1)[k])), name
    old = x[3, 2]
    x[3, 2] = old + 1e-3
    up = loss()
    x[3, 2] = old - 1e-3
    assert abs((up - loss()) / 2e-3 - dx[3, 2]) < 2e-2


def test_toxicity_learns_and_scores_edges(spark):
    rng = random.Random(7)
    rows = []
    for k in range(400):
        w = _words(rng, rng.randrange(5, 120)).split()
        if k % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["nastygram", "nastyish", "badword"])
        rows.append((k, " ".join(w)))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    docs = _docs(spark, rows + [(1000, None), (1001, ""), (1002, "y " * 30_000), (1003, "y" * 100_000), (None, "w1")])
    net = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    got = toxicity.score(docs, net).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 3 == 1]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (1000, 1001, 1002))
    empty = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_windows_cover_every_word():
    import pyarrow as pa

    from tidewatch.llm.text import flat

    batch = toxicity.Batch(*flat(pa.array([" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 31, 32, 33, 57, 200)])))
    for k, n in enumerate((0, 1, 31, 32, 33, 57, 200)):
        own = batch.windows[batch.first[k] : batch.first[k + 1]]
        assert len(own) >= 1 and len(set(own.ravel().tolist()) - {-1}) == n
