"""Fingerprints of very long texts."""

import numpy as np

from sitelens.llm import minhash


def test_unrelated_long_texts_are_unlike():
    words = 100_000
    a, b = (" ".join(f"{side}{i}" for i in range(words)).encode() for side in "ab")
    half = b" ".join([*a.split()[: words // 2], *b.split()[: words // 2]])
    s = minhash.signatures([a, b, half])
    assert minhash.likeness(s[:1], s[1:2])[0] < 0.05
    # a half shared: Jaccard 1/3
    assert abs(minhash.likeness(s[:1], s[2:])[0] - 1 / 3) < 0.15
    places = [np.frombuffer(bytes.fromhex(f), ">u2") for f in minhash.fingerprints(s)]
    assert all(len(p) == minhash.PERMUTATIONS for p in places)
    assert (places[0] == places[1]).mean() < 0.05
    assert (places[0] == places[2]).mean() == minhash.likeness(s[:1], s[2:])[0]
