"""The shared word kernel against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aAbB zZ\n\t\x0b日é. ")), max_size=40)), max_size=12)


def _lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_shingles_match_plain_python(texts):
    names: dict[int, str] = {}
    got = []
    for _, _, words in T.batches(pa.array(texts, pa.string())):
        for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
            own = [bytes(words.data[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)]
            got.append(own)
            for h, w in zip(words.hash[a:b].tolist(), own, strict=True):
                assert names.setdefault(h, w) == w
    assert got == [WORD.findall(_lower(x or "")) for x in texts]


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_set_sizes_match(texts):
    sizes = [len(s) for _, _, w in T.batches(pa.array(texts, pa.string())) for s in T.shingle_sets(w)]
    want = []
    for x in texts:
        w = WORD.findall(_lower(x or ""))
        want.append(0 if not w else 1 if len(w) < 5 else len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    assert sizes == want


def test_long_text_over_chunks_hashes_alike():
    text = " ".join(f"w{k % 1000}" for k in range(400_000))
    (_, _, words), = T.batches(pa.array([text]))
    assert len(words.hash) == 400_000
    assert np.array_equal(words.hash[:1000], words.hash[399_000:])
    assert len(np.unique(words.hash)) == 1000


def test_line_keys():
    assert T.line_keys("  A b\t\n\nÉ\x0b") == [b"a b", b"", "É".encode()]
