"""Learnt operators: held-out accuracy, exact code lengths, odd rows."""
import math
from functools import cache

import numpy as np
import pandas as pd
import pytest
from oddities import nothing, odd  # noqa: F401

from quarrystat.llm import decontam, langid, quality, toxicity
from quarrystat.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def test_quality_held_out(docs, labels, odd, nothing):
    got = quality.quality_scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    h = got[got.held_out]
    assert len(h) > 40 and (h.predicted == h.quality).mean() >= 0.95 and got.score.between(0, 1).all()
    some = labels.limit(0)
    assert set(quality.quality_scores(odd, some).toPandas().score) == {0.5}
    kept = quality.good_documents(odd, some)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.quality_scores(nothing, labels).count() == 0


def test_non_negative_risk_needs_no_negatives(rng):
    pos = rng.normal(1, 0.5, (400, 5)).astype(np.float32)
    unl = np.concatenate([rng.normal(1, 0.5, (300, 5)), rng.normal(-1, 0.5, (100, 5))]).astype(np.float32)
    w, b, mean, scale = quality.fit(pos, unl, 0.75)
    s = ((unl - mean) / scale) @ w + b > 0
    assert s[:300].mean() > 0.97 and s[300:].mean() < 0.03


def test_risk_and_gradient(rng):
    """Against the definition, and against differences of the risk."""
    pos, unl, prior = rng.normal(0.4, 1, (40, 3)), rng.normal(0, 1, (70, 3)), 0.6
    w, bias = rng.normal(size=3), 0.3

    def loss(x, sign, w, b):
        return np.log1p(np.exp(-sign * (x @ w + b))).mean()

    def at(w, b, prior=prior):
        return quality.risk(quality.block_sums(pos, w, b), quality.block_sums(unl, w, b), pos.mean(0), w, b, prior)
    for p in (prior, 5.0):                                # with 5 the negative part is below zero
        value, part, g, slope = at(w, bias, p)
        negative = loss(unl, -1, w, bias) - p * loss(pos, -1, w, bias)
        assert part == pytest.approx(negative) and (part < 0) == (p == 5.0)
        assert value == pytest.approx(p * loss(pos, 1, w, bias) + max(0.0, negative))
        for k in range(4):
            e = np.eye(4)[k] * 1e-6
            up, down = (at(w + s * e[:3], bias + s * e[3], p) for s in (1, -1))
            assert g[k] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-5)
            assert slope[k] == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-5)


def test_quality_is_fitted_on_all_rows(spark, docs, labels, odd):
    """The scores are those of the same fit over arrays of all positives and unlabelled rows,
    nulls, empty, long and repeated texts among them."""
    import zlib

    more = odd.selectExpr("doc_id + 100000 as doc_id", "text").union(odd.where("doc_id is null").select("doc_id", "text"))
    table_ = docs.select("doc_id", "text").union(more)
    marks = labels.select("doc_id", "quality").union(spark.createDataFrame(
        [(None, 1), (100001, None), (100002, 1), (100003, 0), (100003, 1)], "doc_id long, quality int"))
    rows, y = table_.collect(), {}
    for d, q in marks.collect():
        y.setdefault(d, []).append(q)
    kept = [(d, t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 5]
    pos = np.array([quality.features(t) for d, t in kept if 1 in y.get(d, [])])
    unl = np.array([quality.features(t) for d, t in kept if d not in y])
    known = [q for d, qs in y.items() for q in qs if q is not None and d is not None and zlib.crc32(str(d).encode()) % 5]
    w, bias, mean, scale = quality.fit(pos, unl, min(np.mean(known), 0.98))
    want = {(d, t): 1 / (1 + np.exp(-np.clip(((quality.features(t) - mean) / scale) @ w + bias, -30, 30))) for d, t in rows}
    got = quality.quality_scores(table_, marks).select("doc_id", "score").collect()
    assert len(got) == len(rows)
    by_id = {}
    for (d, t), s in want.items():
        by_id.setdefault(d, []).append(s)
    for r in got:
        assert min(abs(r["score"] - s) for s in by_id[r["doc_id"]]) < 1e-4


def test_toxicity_of_all_labels_held_out(spark, odd, nothing):
    """Every toxic document that was held out of learning counts, whatever words it holds."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).toPandas().merge(labels.toPandas()[["doc_id", "toxic"]], on="doc_id", suffixes=("_p", ""))
    h = got[got.held_out & got.toxic.notna()]
    assert len(h) > 700 and (h[h.toxic == 1].toxic_p == 1).mean() >= 0.88 and (h[h.toxic == 0].toxic_p == 0).mean() >= 0.99
    assert got.severity.between(0, 3).all()
    none = labels.limit(0)
    assert set(toxicity.toxicity_scores(odd, none).toPandas().severity) == {0.0}
    assert toxicity.toxicity_scores(nothing, labels).count() == 0


def test_toxicity_scores_by_hand(spark, docs, labels, odd):
    """A trained model on odd rows: severity from plain counts of words and their beginnings."""
    import zlib
    weights, theta = toxicity.train(docs, labels)

    def severity(text):
        counts = {}
        for w in toxicity._WORD.findall((text or "").lower()):
            for part in [w] + [w[:k] + "-" for k in range(4, 9) if len(w) >= k]:
                b = zlib.crc32(part.encode()) % toxicity.BUCKETS
                counts[b] = counts.get(b, 0) + 1
        eta = sum(weights[b] * math.log1p(n) for b, n in counts.items())
        return sum(1 / (1 + math.exp(-min(max(eta - t, -30), 30))) for t in theta)
    sample = docs.where("doc_id < 60").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in sample] + [(1000 + i, r["text"]) for i, r in enumerate(odd.collect())]
    known = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.where("doc_id >= 60").select("doc_id", "text"))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(known, labels).collect()}
    for d, t in rows:
        assert got[d]["severity"] == pytest.approx(severity(t), abs=1e-4)
    base = sum(1 / (1 + math.exp(t)) for t in theta)
    assert severity(None) == severity("") == pytest.approx(base)


def test_ordinal_thresholds_stay_in_order(rng):
    grade = rng.integers(0, 4, 600)
    row, col = np.arange(600), grade + 1
    w, theta = toxicity.fit(row, col, np.ones(600), grade)
    assert (np.diff(theta) > 0).all() and w[1] < w[2] < w[4]


def test_language_held_out(docs, odd, nothing):
    got = langid.languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    h = got[got.held_out]
    assert (h.lang == h.lang_pred).mean() > 0.97
    r = {x["doc_id"]: x for x in langid.languages(odd).where("doc_id is not null and doc_id <> 6").collect()}
    assert [r[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and r[4]["lang_pred"] in ("en", "de")
    assert langid.languages(nothing).count() == 0


def test_rows_without_an_id_are_learnt_from(spark):
    rows = [(None, "aaaa", "x"), (None, None, "x"), (None, "aaaa", None)] + [(i, "aaaa", "x") for i in range(8)]
    import zlib
    learnt = 1 + sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(8))
    got = langid.gram_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r["n"] for r in got) == 4 * learnt and {r["lang"] for r in got} == {"x"}


def test_code_lengths_are_exact():
    """Against a tree walk byte by byte."""
    texts = {"a": b"abracadabra abracadabra", "b": b"banana bandana banana"}
    grams = {}
    for lang, raw in texts.items():
        for i in range(len(raw)):
            g = int.from_bytes((b"\0\0\0" + raw)[i:i + 4], "big")
            grams[lang, g] = grams.get((lang, g), 0) + 1
    counts = {}
    for k in range(4):
        t = {}
        for (lang, g), n in grams.items():
            key = (lang, (g & ((1 << 8 * (k + 1)) - 1)) >> 8, g & 255)
            t[key] = t.get(key, 0) + n
        counts[k] = pd.DataFrame([(*key, n) for key, n in t.items()], columns=["lang", "ctx", "byte", "n"])
    model = langid.Model(counts)

    nodes = {}
    for k, t in counts.items():
        for lang, ctx, byte, n in t.itertuples(index=False):
            nodes.setdefault((k, lang, ctx), {})[byte] = n

    @cache
    def p(lang, ctx, byte, order):
        if order < 0:
            return 1 / 256
        own = nodes.get((order, lang, int.from_bytes(ctx[3 - order:], "big")))
        if not own:
            return p(lang, ctx, byte, order - 1)
        total, distinct = sum(own.values()), len(own)
        if byte in own:
            return own[byte] / (total + distinct)
        rest = sum(p(lang, ctx, b, order - 1) for b in range(256) if b not in own)
        return distinct / (total + distinct) * p(lang, ctx, byte, order - 1) / rest
    for raw in (b"abra", b"bandanna", b"a z\xff"):
        padded = b"\0\0\0" + raw
        for j, lang in enumerate(model.langs):
            want = -sum(math.log2(p(lang, padded[i:i + 3], raw[i], 3)) for i in range(len(raw)))
            assert model.code_lengths([b"x", raw])[1, j] == pytest.approx(want, rel=1e-4)


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment(rng):
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(-1, 4, rng.integers(1, 30))
        score, matches, length, i, j = decontam.align(a, b)
        assert score == smith_waterman(a, b) and 0 <= i <= j <= len(b) and matches <= length


def test_leaks_are_found_and_others_left(spark, docs, odd, nothing):
    bench = table(spark, SF, "benchmark")
    items = {r["item_id"]: r["text"].split() for r in bench.collect()}
    w = items[1]
    edited = [x if i % 6 else "changed" for i, x in enumerate(w)]
    dropped = [x for i, x in enumerate(w) if i % 7 != 3]
    filler = docs.where("doc_id = 3").first()["text"]
    rows = [(1, filler + " " + " ".join(w) + " " + filler), (2, filler + " " + " ".join(edited)), (3, " ".join(dropped) + " " + filler),
            (4, " ".join(w[:len(w) // 2 + 2])), (5, filler), (6, " ".join(reversed(w))), (7, None), (8, "")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontam.contaminated(made, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert {r["doc_id"] for r in decontam.clean_documents(made, bench).collect()} == {5, 6, 7, 8}
    clean = decontam.clean_documents(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert decontam.contaminated(nothing, bench).count() == 0
    assert decontam.contaminated(odd, bench.where("false")).count() == 0


def test_every_full_copy_is_found(spark, docs):
    bench = table(spark, SF, "benchmark")
    items = [(r["item_id"], " ".join(decontam.words_of(r["text"]))) for r in bench.collect()]
    want = {(d["doc_id"], i) for d in docs.select("doc_id", "text").collect()
            for i, t in items if f" {t} " in f" {' '.join(decontam.words_of(d['text']))} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert want and want <= got
