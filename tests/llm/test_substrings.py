"""Repeated 100-byte strings against a dictionary of all of them."""
import hashlib

import numpy as np
import pytest

from quarrystat.llm import substrings


def brute(rows):
    first, texts = {}, [(2 ** 63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for d, b in texts:
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            first[w] = min(first.get(w, (d, s)), (d, s))
    out = []
    for (i, _), (d, b) in zip(rows, texts):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if first[b[s:s + 100]] < (d, s):
                gone[s:s + 100] = True
        n = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((-1 if i is None else i, len(b), int(gone.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_for(rng):
    words = ["alpha", "beta", "gamma", "delta", "été", "ß", "of", "the"]
    def text(n): return " ".join(rng.choice(words) + str(rng.integers(0, 50)) for _ in range(n))
    base, line = text(120), text(30)
    rows = [(0, base), (1, base), (2, base[:300] + "X" + base[301:]), (3, text(40) + line + text(40)),
            (4, text(10) + line + text(9)), (5, line), (6, "a" * 700), (7, "ab" * 300 + "a" * 150), (8, None), (9, ""),
            (10, "short"), (None, base), (5, line), (11, text(5) + line[:110] + text(5)), (12, (text(3) + line) * 4)]
    rows += [(20 + k, text(3) + line + text(3)) for k in range(40)]
    rows += [(100 + k, base[int(rng.integers(0, 400)):][:int(rng.integers(90, 260))]) for k in range(40)]
    return rows


@pytest.mark.parametrize("hot", [substrings.HOT, 5])
def test_against_brute_force(spark, rng, hot):
    rows = rows_for(rng)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, d string").repartition(5)
    got = [tuple(r) for r in substrings.substring_digests(docs, hot).collect()]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows)


def test_blocks_and_shards_change_nothing(rng, monkeypatch):
    text = ("".join(chr(97 + c) for c in rng.integers(0, 3, 4000))).encode()
    whole = substrings.segments(text)
    monkeypatch.setattr(substrings, "BLOCK", 500)
    cut = substrings.segments(text)
    def by_window(x): return [(int(h)) for h, s, e in zip(*x) for _ in range(e - s)]
    assert by_window(whole) == by_window(cut)


def test_suffix_array_and_prefixes(rng):
    b = rng.integers(1, 3, 600).astype(np.uint8)            # zeros would tie the shortest ends
    stop = np.full(len(b), len(b))
    w = substrings.words_at(b, stop)
    sa = substrings.suffix_array(w, stop)
    raw = b.tobytes()
    want = sorted(range(600), key=lambda i: (raw[i:i + 128], i))
    assert [raw[i:i + 100] for i in sa] == [raw[i:i + 100] for i in want]
    lcp = substrings.common_prefixes(w, stop, sa)
    for k in range(1, 600):
        x, y = raw[sa[k]:][:100], raw[sa[k - 1]:][:100]
        assert lcp[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_prefixes_where_strings_are_tied_beyond_the_sorted_depth(rng):
    """Long repeats that differ only after 128 bytes: their order among themselves is any."""
    wrong = 0
    for _ in range(40):
        base = rng.integers(0, 3, 400).astype(np.uint8)
        parts = []
        for _ in range(6):
            a = int(rng.integers(0, 200))
            parts += [base[a:a + int(rng.integers(129, 200))], rng.integers(0, 3, int(rng.integers(1, 9))).astype(np.uint8)]
        b = np.concatenate(parts)
        stop = np.full(len(b), len(b))
        w = substrings.words_at(b, stop)
        sa = substrings.suffix_array(w, stop)
        lcp, raw = substrings.common_prefixes(w, stop, sa), b.tobytes()
        for k in range(1, len(b)):
            x, y = raw[sa[k]:][:100], raw[sa[k - 1]:][:100]
            wrong += lcp[k] != next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert wrong == 0


def test_empty_table(spark):
    assert substrings.substring_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [substrings.HOT, 5])
def test_ids_with_several_texts(spark, rng, hot):
    """Null and repeated ids, texts of different lengths, the same string at the same start."""
    rows = rows_for(rng)
    base, line = rows[0][1], rows[5][1]
    rows += [(None if k % 2 else 5, base[int(rng.integers(0, 300)):][:int(rng.integers(90, 500))] + f" end {k}") for k in range(30)]
    rows += [(i, line + f" tail {k} " * k) for k in range(12) for i in (None, 5, 50)]
    rows += [(i, f"{'x' * k} " + base[:200 + 9 * k]) for k in range(12) for i in (None, 5)]
    rows += [(None, "short"), (5, None), (None, None), (5, base * 3), (None, base * 2), (200, base[:150]), (None, "no repeat " + str(list(range(60))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in substrings.substring_digests(docs, hot).collect()]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows)


def test_only_windows_that_may_repeat_are_suffixes(rng, monkeypatch):
    """Segments of one hash that differ nearly everywhere: the sort takes what their windows share."""
    def text(n): return bytes(rng.integers(97, 123, n).astype(np.uint8))
    shared = text(110)
    pieces = [text(400) for _ in range(50)] + [text(70) + shared + text(60) for _ in range(3)]
    taken, sort = [], substrings.suffix_array
    monkeypatch.setattr(substrings, "suffix_array", lambda words, stop: taken.append(len(words)) or sort(words, stop))
    piece, at, kind, first = substrings.repeated_windows(pieces, np.arange(53) << 40)
    assert sum(taken) == 3 * 110 and len(set(kind.tolist())) == 11
    assert sorted(zip(piece.tolist(), at.tolist(), first.tolist())) == [(p, a, p == 50) for p in (50, 51, 52) for a in range(70, 81)]


@pytest.mark.parametrize("bits", [64, 36, 33])
def test_texts_hashed_together_have_the_segments_of_each(rng, monkeypatch, bits):
    """Also where different hashes share their upper halves (all but a few bits)."""
    exact = substrings.gram_hashes
    monkeypatch.setattr(substrings, "gram_hashes", lambda b: exact(b) & np.uint64((1 << bits) - 1))
    texts = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(0, 900, 60)] + [b"a" * 500, b"", b"x" * 99, b"y" * 100]
    monkeypatch.setattr(substrings, "GROUP", 4000)
    got, places = [dict() for _ in texts], [dict() for _ in texts]
    for k, h, s, e in substrings._by_text(substrings.segments_of(texts)):
        for x, a, b in zip(h.tolist(), s.tolist(), e.tolist()):
            got[k].update({w: x for w in range(a, b)})
    for ks, hs, ms in substrings.anchors(texts):
        for k, h, m in zip(ks.tolist(), hs.tolist(), ms.tolist()):
            places[k][h] = places[k].get(h, 0) + m
    for k, raw in enumerate(texts):
        g = substrings.gram_hashes(np.frombuffer(raw, np.uint8))
        want = {w: int(g[w:w + 85].min().view(np.int64)) for w in range(len(raw) - 99)}
        assert got[k] == want
        here = {}
        for w in want:
            for p in np.flatnonzero(g[w:w + 85] == g[w:w + 85].min()).tolist():
                here.setdefault(want[w], set()).add(w + p)
        assert all(places[k][h] >= len(p) for h, p in here.items())
        if bits == 64:
            assert places[k] == {h: len(p) for h, p in here.items()}
