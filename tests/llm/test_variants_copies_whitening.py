"""Spelling variants, exact duplicates and whitening against brute force, and their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, spelling, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, word string, keep_id string")


# 11 ------------------------------------------------------------------------------------


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _variants(rows):
    """Every pair of words is compared."""
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n)


def _text(rng, words):
    out = []
    for _ in range(400):
        w = rng.choice(words)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé÷Z") + w[k:], w[:k] + rng.choice("abxÀ") + w[k + 1 :]])
        out += [w] * rng.choice([1, 1, 2, 30])
    return rng.choice([" ", ", ", "1"]).join(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 8, "slice_words": 5}])
def test_variants_equal_all_pairs(spark, sizes):
    rng = random.Random(7)
    words = ["abababab", "aaaaaaa", "aaaaaaaa", "bananaés", "international", "interactional", "Straße", "extraordinarily", "disestablishmentarianism", "Wörterbuch", "mitteleur", "zusammenhang"]
    rows = [(k, _text(rng, words)) for k in range(6)] + [(2, None), (None, _text(rng, words)), (9, ""), (10, "short words only"), (11, "x" * 300 + " " + "x" * 301), (12, "x" * 300 + " " + "x" * 301)]
    got = spelling.variant_groups(_docs(spark, rows), **sizes)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = _variants(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert any(w[3] for w in want) and any(w[5] not in (w[0], w[3]) for w in want)


def test_variants_of_an_empty_table(spark):
    assert spelling.variant_groups(_docs(spark, [])).count() == 0


def test_forms_are_followed_to_the_last(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)] + [("a", "w3")], "word string, root string")
    assert {r["word"]: r["root"] for r in spelling.followed(links).collect()} == {f"w{k}": "w11" for k in range(11)} | {"a": "w11"}


def test_automata_are_minimal_and_number_their_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(600)})
    made = spelling.Automaton(words)
    assert [made.number(w) for w in words] == list(range(len(words))) and made.number("zz") is None
    suffixes = {(w[:k] in set(words), tuple(v[k:] for v in words if v.startswith(w[:k]))) for w in words[:80] for k in range(len(w) + 1)}
    assert len({r for _, r in suffixes}) <= len(made.known)  # one state for each set of ends
    assert len(made.known) < sum(map(len, words))
    for w in words[:100]:
        for exact in range(len(w) + 1):
            assert made.near(w, exact) == {k for k, v in enumerate(words) if _near(w, v) and v[:exact] == w[:exact]}


# 12 ------------------------------------------------------------------------------------


def _copies(rows):
    strip = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(strip(t), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for x, members in groups.items():
        best = min(members)
        out += [(rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(x.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"prefix": 3}, {"bits": 32_768, "prefix": 1}])
def test_copies_equal_brute_force(spark, limits):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["é" * 70 + "x", "é" * 70 + "y", "z" * 20_000]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t.replace("a", " a\n\x0b")) for k, t in enumerate(base)] + [(300, None), (301, ""), (302, " \t\r\x0c"), (None, "ab"), (None, "ab"), (5, base[5]), (400, " ab")]
    docs = _docs(spark, rows).repartition(3)
    got = exact_dedup.exact_duplicates(docs, digests=True, **limits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == [w[:1] + w[1:] for w in _copies(rows)]
    alone = {r["doc_id"] for r in exact_dedup.exact_duplicates(docs, **limits).where("text_sha256 IS NULL").collect()}
    assert alone <= {w[0] for w in _copies(rows) if w[2] == 1}


def test_copies_carry_columns_and_refuse_clashes(spark):
    docs = _docs(spark, [(1, "a"), (2, " a"), (3, "b")])
    got = exact_dedup.exact_duplicates(docs, carry=("text", "word"))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text"], r["word"]) for r in got.collect()) == [(1, 2, 2, False, "a", "clash"), (2, 2, 2, True, " a", "clash"), (3, 3, 1, True, "b", "clash")]
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(docs, carry=("keep_id",))
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_a_group_of_a_third_of_the_rows(spark, monkeypatch):
    from tidewatch.llm import tables

    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tables.looked_up, "__defaults__", ("inner", 0))
    monkeypatch.setattr(tables.hot, "__defaults__", (20,))
    rows = [(k, "same text" if k % 3 == 0 else f"own {k % 70}") for k in range(300)]
    assert sorted((tuple(r) for r in exact_dedup.exact_duplicates(_docs(spark, rows), digests=True).collect()), key=str) == _copies(rows)


# 13 ------------------------------------------------------------------------------------


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, whitened string")


def _check(got, vectors, components=4):
    """got against exact sums and numpy's eigenvectors; vectors are the integer rows by vec_id."""
    fit = sorted({tuple(v) for v in vectors.values()})
    n, dims = len(fit), len(fit[0])
    total = [sum(v[k] for v in fit) for k in range(dims)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, total, strict=True)] for v in fit])
    cov = np.array([[float(sum(Fraction(n * v[i] - total[i], n) * Fraction(n * v[j] - total[j], n) for v in fit) / n) for j in range(dims)] for i in range(dims)])
    values, vectors_ = np.linalg.eigh(cov)
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9 and len(centred) == n
    for k in range(min(components, dims)):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        assert set(mine) == set(vectors)
        axis = vectors_[:, -1 - k]
        want = {i: sum((n * a - s) / n * c for a, s, c in zip(v, total, axis, strict=True)) / np.sqrt(values[-1 - k]) for i, v in vectors.items()}
        sign = np.sign(sum(want[i] * mine[i]["whitened"] for i in want))
        assert all(abs(sign * mine[i]["whitened"] - want[i]) < 1e-8 for i in want)
        assert all(abs(r["explained"] - values[-1 - k] / np.trace(cov)) < 1e-9 for r in mine.values())
        assert all(mine[i]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for i, v in vectors.items())


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_equals_exact_arithmetic(spark, parts, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(2)
    axes = rng.normal(size=(6, 6)) * np.array([3, 2, 1, 0.6, 0.3, 0.1])[:, None]
    rows = [(k, (rng.normal(size=6) @ axes).astype(np.float32).tolist()) for k in range(120)]
    rows += [(500 + k, rows[0][1]) for k in range(60)]  # copies count once in the fit
    bad = [(900, None), (901, [None] + [0.1] * 5), (902, [float("nan")] * 6), (903, [float("-inf")] * 6), (904, []), (905, [1.0, 2.0])]
    got = whitening.whiten(_vectors(spark, rows + bad).repartition(parts)).collect()
    assert len(got) == 4 * len(rows)
    _check(got, {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows})


def test_whitening_far_from_the_origin_loses_nothing(spark):
    """A mean of a hundred million and a spread of a few units: sums of plain squares would leave no digit."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in 2.0**30 + rng.integers(-4, 5, 3) * 128]) for k in range(80)]
    got = whitening.whiten(_vectors(spark, rows)).collect()
    _check(got, {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows}, 3)


def test_whitening_edges(spark):
    assert whitening.whiten(_vectors(spark, [])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector
    got = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (None, [2.0, 4.0]), (1, [1.0, 2.0])])).collect()  # rank one
    assert [r["component"] for r in got] == [1, 1, 1] and sorted(str(r["vec_id"]) for r in got) == ["1", "1", "None"]
    assert sorted(round(abs(r["whitened"]), 9) for r in got) == [1.0, 1.0, 1.0] and {round(r["explained"], 9) for r in got} == {1.0}
    wide = whitening.whiten(_vectors(spark, [(k, [2.0**31 * (k - 1), float(k)]) for k in range(3)])).collect()  # squares beyond a long
    assert {r["deviation"] for r in wide} == {None, 0}


@pytest.mark.parametrize("name", ["random", "identity", "zero", "rank", "repeated", "graded", "wilkinson"])
def test_divide_and_conquer(name):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 40))
    near = np.diag(np.abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    a = {"random": x @ x.T, "identity": np.eye(9), "zero": np.zeros((7, 7)), "rank": x[:, :2] @ x[:, :2].T, "repeated": np.kron(np.eye(3), x[:5] @ x[:5].T), "graded": np.diag(10.0 ** np.arange(-12, 13)), "wilkinson": np.kron(np.eye(2), near)}[name]
    d, e, q = whitening.tridiagonal(a)
    w, u = whitening.divide_and_conquer(d, e)
    u, size = q @ u, max(1e-300, np.abs(np.linalg.eigvalsh(a)).max())
    assert np.abs(w - np.linalg.eigvalsh(a)).max() / size < 1e-13 and np.abs(u.T @ u - np.eye(len(a))).max() < 1e-13 and np.abs(a @ u - u * w).max() / size < 1e-13


def test_products_are_exact_to_double_double():
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (1500, 4)) + np.array([10**9, 0, 7, 10**6])
    means = [Fraction(int(s), len(x)) for s in x.sum(axis=0)]
    mean = np.array([float(m) for m in means]), np.array([float(m - Fraction(float(m))) for m in means])
    high, low = whitening.outer_products(whitening.centred(x, mean))
    for i in range(4):
        for j in range(4):
            exact = sum((int(a[i]) - means[i]) * (int(a[j]) - means[j]) for a in x)
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) < Fraction(1, 10**18)


def test_all_columns_have_their_types(spark):
    from tidewatch.llm import queries

    made = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.0, 0.5])]))
    assert dict(made.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert {"op11_spelling_variants", "op12_exact_dedup", "op13_whitening"} <= set(queries.queries())
    assert dict(spelling.variant_groups(_docs(spark, [(1, "abcdefgh abcdefgh")])).dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    assert dict(exact_dedup.exact_duplicates(_docs(spark, [(1, "a")]).withColumn("x", F.lit(1))).dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
