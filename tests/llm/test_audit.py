"""The filter audit against a plain count over every order."""
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from oddities import nothing, odd  # noqa: F401

from quarrystat.llm import audit

MARKS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """``rows`` are (doc_id, text, source)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        early = t in least and (d is None or least[t] < d)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), early]
        docs.append((s or "", {k for k, f in zip("ABCDE", fails) if f}, d in good, d in toxic))
    parts, c = sorted({p for p, *_ in docs}), Counter()
    for part, fails, g, x in docs:
        for order in permutations("ABCDE"):
            seen = False
            for step, f in enumerate(order, 1):
                hit = f in fails
                key = (part, "".join(order), step)
                c[key, "kept"] += not hit and not seen
                c[key, "removed"] += hit and not seen
                c[key, "redundant"] += hit and seen
                c[key, "unique_fails"] += fails == {f}
                c[key, "good_lost"] += hit and not seen and g
                c[key, "toxic_lost"] += hit and not seen and x
                c[part, f] += hit and not seen
                seen |= hit
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, "".join(o), k + 1, *[c[(p, "".join(o), k + 1), n] for n in names], c[p, o[k]])
                  for p in parts for o in permutations("ABCDE") for k in range(5))


def result(docs, labels, **kw):
    return sorted(map(tuple, audit.filter_audit(docs, labels, **kw).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))


@pytest.mark.parametrize("size", [40, audit.SLICE])
def test_odd_rows(spark, odd, size):
    texts = ["word " * 300, " ".join(f"w{i}" for i in range(250)), "UP " * 10 + " ".join(f"w{i}" for i in range(250)), "a # b", "a # b"]
    more = [(100 + i, texts[i % 5], "s" if i % 2 else None) for i in range(15)] + [(None, "a # b", "t"), (None, "a # b", "t"), (3, "a # b", "t")]
    docs = odd.select("doc_id", "text", "source").union(spark.createDataFrame(more, "doc_id long, text string, source string"))
    labels = [(100, 1, 0), (101, 0, 1), (101, 1, None), (102, None, None), (None, 1, 1), (3, 1, 1), (6, 1, 0)]
    rows = [tuple(r) for r in docs.collect()]
    assert result(docs, spark.createDataFrame(labels, MARKS), size=size) == brute(rows, labels)


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], MARKS)
    assert audit.filter_audit(nothing, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert result(one, labels) == brute([(1, None, None)], [])


def test_pass_and_table_against_patterns():
    rng = np.random.default_rng(3)
    pieces = ["a", "bb", "Ab", "é", "🙂", " ", "\n", "\t", "\x0b", "\x00", "#", "|", "longer-than-eight-bytes", "longer-than-eight-byteS", "", "日本"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 60))) for _ in range(400)] + ["", "x" * 500, " " * 200]
    raw = [t.encode() for t in texts]
    want = [[len(w := re.findall(rb"[^\x20\x09-\x0D]+", b)), len(set(w)), len(re.findall(rb"[A-Z]", b)), len(t), len(re.findall(rb"[#$%&*|]", b))]
            for b, t in zip(raw, texts)]
    ends = np.cumsum([len(b) for b in raw])
    for size in (1, 7, 64, 1 << 20):
        assert audit.count_texts(np.frombuffer(b"".join(raw), np.uint8), ends, size).tolist() == want


def test_table_verifies_words_of_one_hash(monkeypatch):
    """All words in one slot: only comparing bytes tells them apart."""
    monkeypatch.setattr(audit, "_hashes", lambda e, start, size, doc: np.zeros(len(start), np.uint64))
    raw = np.frombuffer(b"aa bb aa cc bb aa aaa aaa", np.uint8)
    assert audit.count_texts(raw, np.array([11, len(raw)]))[:, :2].tolist() == [[4, 3], [4, 3]]


def test_finite_state_table_knows_every_byte():
    assert [b for b in range(256) if not audit.CLASS[b] & audit.WORD] == [9, 10, 11, 12, 13, 32]
    assert sum(bool(audit.CLASS[b] & audit.POINT) for b in range(256)) == 192
