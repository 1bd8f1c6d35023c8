"""Vectorised words, hashes and shingles against plain Python."""

import random

import numpy as np
import pyarrow as pa

from touchline.llm import textkit as tk

TEXTS = ["", None, "a", " a  B\tc\n", "x" * 5000, "ä ö ü", "one two three four five six one two three four five",
         "\x1c a\x0bb", "A" * 3 + " " * 300 + "b", "é"]


def test_words_match_split():
    for _, _, data, offs in tk.documents(pa.array(TEXTS)):
        st, en, wo = tk.find_words(data, offs)
        got = [[data[a:b].tobytes() for a, b in zip(st[lo:hi], en[lo:hi])] for lo, hi in zip(wo[:-1], wo[1:])]
        assert got == [(t or "").encode().lower().split() for t in TEXTS]


def test_equal_words_have_equal_hashes_and_others_differ():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    data, offs = tk.buffers(pa.array([" ".join(words)]))
    st, en, _ = tk.find_words(data, offs)
    h = tk.hash_words(data, st, en)
    by = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_chunks_cover_all_rows():
    _, offs = tk.buffers(pa.array(TEXTS))
    for limit in (1, 7, 10_000):
        parts = list(tk.chunks(offs, limit))
        assert [i for lo, hi in parts for i in range(lo, hi)] == list(range(len(TEXTS)))


def test_shingle_sets_count_like_tuples():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 40, 300)]
    data, offs = tk.buffers(pa.array(texts))
    st, en, wo = tk.find_words(data, offs)
    for t, s in zip(texts, tk.shingle_sets(tk.hash_words(data, st, en), wo), strict=True):
        w = t.split()
        want = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(s) == len(want) and np.all(np.diff(s.astype(object)) > 0)
