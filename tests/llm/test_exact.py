"""Exact dedup by block names against a dictionary of texts."""
import hashlib
from collections import defaultdict

import pytest
from oddities import nothing, odd  # noqa: F401

from quarrystat.llm import common, exact


def brute(rows):
    """Rows ``(doc_id, text)`` to the multiset of result rows."""
    groups, out = defaultdict(list), []
    for d, t in rows:
        groups[t or ""].append(d)
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        sha, left = hashlib.sha256(t.encode()).hexdigest(), 1
        for d in ids:
            stays = d == keep and left > 0
            left -= stays
            out.append((d, keep, len(ids), stays, sha))
    return sorted(out, key=repr)


def result(df, block):
    return sorted(map(tuple, exact.exact_copies(df, block).collect()), key=repr)


@pytest.mark.parametrize("block", [3, exact.BLOCK])
def test_blocks_of_every_size(spark, block):
    texts = ["", "a", "ab", "abc", "abcd", "abcabc", "abcab", "ababab", "é", "éé", "x" * 31, "x" * 32, "x" * 33, "ab" * 40, "ab" * 40 + "a"]
    rows = [(i, texts[(i * 7) % len(texts)]) for i in range(60)] + [(99, None), (None, "abc"), (None, None), (None, "only here"), (None, "only here"),
                                                                    (7, "abc"), (7, "abc"), (7, "other")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), block) == brute(rows)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for block in (16, exact.BLOCK):
        assert result(odd, block) == brute(rows)
    kept = exact.without_copies(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r[3] for r in brute(rows)) == len({t or "" for _, t in rows})
    assert exact.exact_copies(nothing).count() == exact.without_copies(nothing).count() == 0


def test_names_are_collision_free_when_hashes_are_not(spark, monkeypatch):
    """With every key in one bucket of one hash the names still tell contents apart."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: exact.F.lit(5).cast("long"))
    rows = [(i, "t" * (i % 9)) for i in range(40)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 2) == brute(rows)


def test_hot_texts_and_hot_rows(spark, monkeypatch):
    """Keys above the limit take the other way and give the same result."""
    for module in (exact, common):
        monkeypatch.setattr(module, "crowded", lambda total: 5)
    monkeypatch.setattr(exact, "CHUNK", 4)
    rows = [(i, "the common text " * 9) for i in range(40)] + [(i, f"own {i}") for i in range(40, 60)]
    rows += [(None, None)] * 23 + [(7, "same id, same text")] * 21
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, 16) == brute(rows)
    assert exact.without_copies(df, 16).count() == 23


def test_long_text_is_cut_whole(spark):
    text = "".join(chr(97 + i % 23) for i in range(3_000_000))
    df = spark.createDataFrame([(1, text), (2, text), (3, text + "x")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact.exact_copies(df).collect()}
    assert [got[i]["keep_id"] for i in (1, 2, 3)] == [2, 2, 3]
    parts = exact.text_blocks(df).where("d = 3").orderBy("pos").collect()
    assert b"".join(r["block"] for r in parts).decode() == text + "x" and len(parts) == parts[0]["n"]
    assert all(len(r["block"]) == exact.BLOCK for r in parts[:-1])
