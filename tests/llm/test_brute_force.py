"""Features, the recurrent network and the ring against plain loops, value by value."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import quality, sharding, toxicity
from tidewatch.llm.text import Words, flat

PUNCT = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _words(text):
    return [w for w in text.encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]


def _hash(word):
    return int(Words(*flat(pa.array([word.decode("utf-8", "replace")], pa.string()))).hash[0])


def _statistics(text):
    data, words = text.encode(), _words(text)
    letters = lambda w: [b for b in w if b >= 128 or chr(b).isalpha()]
    upper = lambda w: [b for b in w if 65 <= b <= 90]
    share = lambda test: sum(map(test, words)) / max(1, len(words))
    ends = lambda w, n: len(w) >= n and all(b in PUNCT for b in w[-n:])
    caps = lambda w: len(letters(w)) > 1 and len(letters(w)) == len(upper(w))
    low = [w.lower() for w in words]
    again = sum(k > 0 and low[k] == low[k - 1] or k > 1 and low[k] == low[k - 2] for k in range(len(low)))
    pairs = list(zip(low, low[1:], strict=False))
    size, some, count, lines = len(data), max(1, len(data)), len(words), data.count(b"\n")
    count_of = lambda test: sum(map(test, data))
    return [
        math.log1p(size), math.log1p(count), math.log1p(lines), size / max(1, count) / 10, count / (lines + 1) / 50, len(upper(data)) / some * 4, count_of(lambda b: 48 <= b <= 57) / some * 10, count_of(lambda b: b in PUNCT) / some * 4,
        count_of(lambda b: b >= 128) / some * 4, share(lambda w: ends(w, 1)), share(lambda w: ends(w, 2)), share(lambda w: ends(w, 3)), share(caps), share(lambda w: not letters(w)), again / max(1, count), share(lambda w: len(w) > 20),
        1 - len(set(pairs)) / max(1, len(pairs)), len({_hash(w) >> (64 - quality.BITS) for w in words}) / max(1, count), math.sqrt(share(lambda w: ends(w, 2))), math.sqrt(share(lambda w: not letters(w) or caps(w))),
    ]


def test_quality_features_equal_plain_loops():
    rng = random.Random(2)
    bits = ["the", "The", "THE", "a", "B2B", "end.", "what?!", "...", "42", "x" * 25, "naïve", "ÉTÉ", "(sic)", "--", "\n", "\n\n", "\t"]
    texts = ["", " \n", "one", None, "a a a"] + [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    index, value, starts = quality.features(*flat(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        own, x = index[starts[k] : starts[k + 1]], value[starts[k] : starts[k + 1]]
        dense = own >= 1 << quality.BITS
        assert own[dense].tolist() == [(1 << quality.BITS) + j for j in range(quality.STATS)]
        assert np.allclose(x[dense], _statistics(text or ""), atol=1e-5), text
        times = {}
        for w in _words(text or ""):
            b = _hash(w) >> (64 - quality.BITS)
            times[b] = times.get(b, 0) + 1
        norm = math.sqrt(sum(v * v for v in times.values()))
        assert dict(zip(own[~dense].tolist(), x[~dense].round(5).tolist(), strict=True)) == pytest.approx({b: v / norm for b, v in times.items()}, abs=2e-5)


def _mix(x):
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def _vector(net, word):
    low, grams = word.lower(), []
    for n in (3, 4, 5):
        for k in range(len(low) - n + 1):
            g = n
            for b in low[k : k + n]:
                g = (g * 257 + b) & ((1 << 64) - 1)
            grams.append(_mix(g * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) >> (64 - toxicity.BITS))
    if len(low) < 3:
        grams.append(_mix(_hash(word)) >> (64 - toxicity.BITS))
    whole = net.p["word"][_hash(word) >> (64 - toxicity.BITS)]
    return np.concatenate([whole, sum(net.p["gram"][g] for g in grams) / math.sqrt(len(grams))])


def _logit(net, vectors):
    """One window: two recurrences step by step, then attention."""
    p, h = net.p, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((len(vectors), 2 * h))
    for way, order in (("f", range(len(vectors))), ("b", reversed(range(len(vectors))))):
        s = np.zeros(h)
        for k in order:
            g, r = vectors[k] @ p[f"{way}_w"] + p[f"{way}_b"], s @ p[f"{way}_u"]
            z, reset = sigmoid(g[:h] + r[:h]), sigmoid(g[h : 2 * h] + r[h : 2 * h])
            s = (1 - z) * np.tanh(g[2 * h :] + reset * r[2 * h :]) + z * s
            states[k, (way == "b") * h : (way == "b") * h + h] = s
    weight = np.exp(np.tanh(states @ p["att_w"]) @ p["att_v"])
    return float((weight / weight.sum()) @ states @ p["out"] + p["out_b"][0])


@pytest.mark.parametrize("several", [False, True])
def test_toxicity_scores_equal_plain_loops(several, monkeypatch):
    if several:
        monkeypatch.setattr(toxicity, "SLICE", 3)  # more windows than a slice: each takes its own words
    rng = random.Random(4)
    net = toxicity.Network(5)
    for name in ("word", "gram"):
        net.p[name] *= 30
    net.slope, net.shift, net.floor = 1.7, -0.2, -3.0
    texts = ["", None, "ab", "You FOOL"] + [" ".join(rng.choice(["you", "are", "a", "Fool", "naïve", "x", "unbelievably", "!!"]) for _ in range(rng.randrange(1, 150))) for _ in range(25)]
    got = np.concatenate([net.score(b) for b in toxicity._parts(pa.array(texts, pa.string()))])
    for text, score in zip(texts, got, strict=True):
        words = _words(text or "")
        windows = [words[k * toxicity.STRIDE : k * toxicity.STRIDE + toxicity.WINDOW] for k in range(max(1, -(-(len(words) - toxicity.WINDOW) // toxicity.STRIDE) + 1))]
        most = max(_logit(net, [_vector(net, w) for w in window]) for window in windows) if words else net.floor
        assert abs(score - 1 / (1 + math.exp(-(net.slope * most + net.shift)))) < 1e-5, text


@pytest.mark.parametrize("seed", range(5))
def test_the_ring_is_walked_as_byte_by_byte(seed):
    rng = np.random.default_rng(seed)
    ring = sharding.Ring(5, 4)
    loads = rng.integers(0, 40, len(ring.owner)) * (rng.random(len(ring.owner)) < 0.8)
    capacity = -(-int(loads.sum()) // 5) + int(rng.integers(0, 3))
    room, want, rest, at = [capacity] * 5, {}, [], 0
    for k, load in enumerate(loads.tolist()):
        for _ in range(load):
            s = int(ring.owner[k])
            if room[s]:
                room[s] -= 1
                want[at] = s
            else:
                rest.append((k, at))
            at += 1
    for k, byte in rest:  # clockwise from its own arc to the first shard with room
        while not room[int(ring.owner[k])]:
            k = (k + 1) % len(ring.owner)
        room[int(ring.owner[k])] -= 1
        want[byte] = int(ring.owner[k])
    got = {byte: s for a, b, s in sharding.walk(ring, loads, capacity) for byte in range(a, b)}
    assert got == want and max(np.bincount(list(got.values()), minlength=5)) <= capacity
