"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule; policies are masks over those bits, so that a new policy,
or the effect of leaving a rule out, needs no second look at any text.

Defined cases: null or empty text has no words and fails ``few_words``; any other
measure of nothing is 0; very long texts are measured whole; repeated rows and ids
are judged row by row; an empty table gives an empty result; other columns are never
looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = re.compile(r"[^\W\d_]")
_CAPITALS = re.compile(rb"[A-Z]")
_SYMBOLS = b"#*$%&|<>"

#: name -> condition over the measurements under which a document fails. The
#: position is the bit; new rules go to the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "shouting": "2 * n_capitals > n_letters",
    "no_letters": "2 * n_letters < word_chars",
}
#: Versioned policies: the rules that decide.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": tuple(RULES),
    "lenient-1": ("few_words", "repeated_words", "symbols", "no_letters"),
}
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")


def _repeated_words(tokens: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(tokens) - 2
    if n < 2:
        return 0
    ids: dict = {}
    w = np.fromiter([ids.setdefault(t, len(ids)) for t in tokens], np.int64, len(tokens))
    pair = w[:-1] * len(ids) + w[1:]
    pair = np.unique(pair, return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(len(tokens), bool)
    twice = count[where] > 1
    for k in range(3):
        hit[k:n + k] |= twice
    return int(hit.sum())


def measure(text: str | None) -> tuple:
    """The measurements of one whole text, in the order of the ledger."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(tokens), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            _repeated_words(tokens), len(lines), len(_LETTERS.findall(text)), len(_CAPITALS.findall(raw)))


def ledger(docs: DataFrame) -> DataFrame:
    """``(doc_id, the measurements, failed)``: bit i of ``failed`` is rule i."""
    def batches(it):
        for b in it:
            rows = [measure(t) for t in b.column(1).to_pylist()]
            cols = np.array(rows, np.int64).reshape(len(rows), len(_MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(cols[:, k])) for k in range(cols.shape[1])]],
                                             ["doc_id", *_MEASURES])
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = src.mapInArrow(batches, "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURES))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed", bits)


def policy_mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def passes(policy: str, failed: Column | None = None) -> Column:
    """Whether a ledger row passes a policy."""
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """``(rule, failing, only)`` of a policy's rules: documents that fail the rule, and
    those that would be kept without it. One bitwise aggregation over the ledger."""
    mask, names = policy_mask(policy), list(RULES)
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    patterns = book.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))      # at most 2^rules rows
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
                      for r in POLICIES[policy]])
    return (patterns.select("hit", "n", F.inline(rules)).groupBy("rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("only")))


def rule_report(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    """The measurements and verdict of every document, its failure bits, and the one rule of the
    policy without which it would be kept (null: none)."""
    base = ~passes("base-1")
    hit = F.col("failed").bitwiseAND(F.lit(policy_mask(policy)).cast("long"))
    only = F.lit(None).cast("string")
    for i, rule in enumerate(RULES):
        only = F.when(hit == 1 << i, F.lit(rule)).otherwise(only)
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "failed", only.alias("only_rule"))


RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
            FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(l.n_lines, 0) AS n_lines, length(regexp_replace(text, '[^\pL]', '', 'g')) AS n_letters,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 4 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines,
        word_chars < 2 * n_words, word_chars > 15 * n_words, 2 * n_capitals > n_letters, 2 * n_letters < word_chars] AS f FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f[1] OR f[2] AS base_failed,
  NOT list_contains(f, true) AS kept, list_sum([x::BIGINT << (i - 1) for x, i in f])::BIGINT AS failed,
  CASE WHEN len(list_filter(f, lambda x: x)) = 1 THEN ['few_words', 'repeated_words', 'symbols', 'repeated_lines', 'short_words',
    'long_words', 'shouting', 'no_letters'][list_position(f, true)] END AS only_rule
FROM f
"""
