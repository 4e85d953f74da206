"""The numpy kernels against plain Python."""
import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from lodestone.llm import common, line_dedup, media, minhash, suffix_dedup

TEXTS = ["", " ", "one", "one Two", "a b c d", "É a\tb\nc  d e\r\n", "x" * 5000, None, "the end the end the end the end", " lead and trail \x0b", "Ünï cödé ✓ wörds hêre"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t, k):
    w = words(t)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_word_spans_and_shingles():
    raw, off = common.utf8(pa.array(TEXTS))
    for k in (1, 3, 5):
        h, o = minhash.shingle_sets(raw, off, k)
        assert np.diff(o).tolist() == [len(shingles(t, k)) for t in TEXTS]
    h, o = minhash.shingle_sets(*common.utf8(pa.array(["a b c d", "b c d a", "x a b c d"])), 3)
    sets = [set(h[a:b].tolist()) for a, b in zip(o[:-1], o[1:])]
    assert len(sets[0] & sets[1]) == 1 and len(sets[0] & sets[2]) == 2


def test_super_minhash_estimates_and_stops():
    rng = np.random.default_rng(1)
    m = 96
    for n in (1, 5, 40, 3000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = base.copy()
        other[: n // 5] = rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)
        sig = minhash.super_minhash(np.concatenate((base, other)), np.array([0, n, 2 * n]), m)
        assert (sig != np.uint64(2**64 - 1)).all()
        alone = minhash.super_minhash(base[::-1].copy(), np.array([0, n]), m)
        assert (alone[0] == sig[0]).all()
        true = len(set(base) & set(other)) / len(set(base) | set(other))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.2
    assert len(set(minhash.super_minhash(np.array([7], np.uint64), np.array([0, 1]), 16)[0] >> np.uint64(32))) == 16


def brute(texts, length):
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def test_interval_expansion():
    random.seed(3)
    for alphabet, n, length in (("ab", 300, 6), ("abc", 500, 12), ("a", 40, 5), ("abcdefgh", 900, 4), ("ab", 1, 3)):
        t = "".join(random.choice(alphabet) for _ in range(n))
        t += "|" + t[n // 3 : n // 2] + "#" + t[: n // 4] + "$"
        b = np.frombuffer(t.encode(), np.uint8)
        double = t + t
        got = suffix_dedup.repeated(b, length)
        count = {}
        for i in range(len(t)):
            count.setdefault((double * 3)[i : i + length], []).append(i)
        want = [len(count[(double * 3)[i : i + length]]) > 1 for i in range(len(t))]
        assert got.tolist() == want


def test_repeating_windows():
    random.seed(6)
    base = "".join(random.choice("abcd") for _ in range(400))
    raws = ["".join(random.choice("abcd") for _ in range(random.randint(30, 90))).encode() for _ in range(40)]
    raws += [(base[i : i + random.randint(30, 120)] + random.choice("xyz") * 3).encode() for i in range(0, 300, 11)] + [b"e" * 50, b"uvw" * 12]
    own, place, flag = suffix_dedup.repeating(raws, 30)
    assert len(own) == sum(len(r) - 29 for r in raws)
    from collections import Counter

    seen = Counter(r[i : i + 30] for r in raws for i in range(len(r) - 29))
    assert flag.tolist() == [seen[raws[r][i : i + 30]] > 1 for r, i in zip(own, place)] and flag.any() and not flag.all()


def test_anchor_runs_cover_each_window_once():
    random.seed(4)
    texts = ["".join(random.choice("abcd ") for _ in range(n)) for n in (0, 10, 400, 401, 3000)]
    raw, off = common.utf8(pa.array(texts))
    row, start, count, g = suffix_dedup.anchors(raw, off, 400, 64)
    seen = sorted((r, s - off[r] + i) for r, s, c in zip(row, start, count) for i in range(c))
    assert seen == [(r, i) for r, t in enumerate(texts) for i in range(len(t) - 399)]


def test_chunks_follow_content():
    rng = np.random.default_rng(5)
    body = rng.integers(0, 256, 200_000, dtype=np.uint8)
    moved = np.concatenate((rng.integers(0, 256, 999, dtype=np.uint8), body))
    raw, bounds = np.concatenate((body, moved)), np.array([0, len(body), len(body) + len(moved)])
    a, b = media.cuts(raw, bounds)
    first = {hashlib.sha256(raw[s:e]).digest() for s, e in zip([0, *a[:-1]], a)}
    second = {hashlib.sha256(raw[s:e]).digest() for s, e in zip([bounds[1], *b[:-1]], b)}
    assert a[-1] == len(body) and b[-1] == len(raw) and len(first & second) >= len(first) - 3
    assert all(e - s <= media.MOST for s, e in zip([0, *a[:-1]], a))
    h = 0
    for x in body[:100].tolist():
        h = ((h << 1) + int(media.GEAR[x])) & 0xFFFFFFFF
    assert media.gear(body[:100])[-1] == h


def test_lines_and_simhash():
    raw, off = common.utf8(pa.array(["a b\n\nc", None, "", "x\n"]))
    s, e, own, num = line_dedup.lines_of(raw, off)
    assert [(int(o), int(n), raw[a:b].tobytes()) for a, b, o, n in zip(s, e, own, num)] == [
        (0, 0, b"a b"), (0, 1, b""), (0, 2, b"c"), (1, 0, b""), (2, 0, b""), (3, 0, b"x"), (3, 1, b"")]
    rng = np.random.default_rng(1)
    sizes = [1, 9, 600, 255, 256]
    w = rng.integers(0, 1 << 64, sum(sizes), dtype=np.uint64)
    first = np.cumsum([0, *sizes[:-1]])
    got = line_dedup.simhashes(w, first)
    for a, n, h in zip(first, sizes, got):
        assert int(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in w[a : a + n]) > n)


def test_hashes_are_not_linear():
    """Two different texts that every polynomial modulo a power of two confuses."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    for x, y in ((a, b), (a[:128] * 2, b[:128] * 2)):
        raw, off = common.utf8(pa.array([x, y]))
        h = common.hash_spans(raw, off[:-1], off[1:])
        assert h[0] != h[1]
