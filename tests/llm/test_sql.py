"""Operators with an SQL twin, on odd tables too."""
import duckdb
import pytest
from oddities import SF, nothing, odd  # noqa: F401

from check import connect, difference
from quarrystat.llm import chat, line_dedup, rules
from quarrystat.llm.queries import LLM_ORACLES, LLM_QUERIES


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_registered(spark, name):
    got = LLM_QUERIES[name](spark, SF).toPandas()
    assert difference(got, connect(SF).execute(LLM_ORACLES[name]).fetchdf()) is None


def on(df, sql, name="documents"):
    con = duckdb.connect()
    con.register(name, df.toPandas())
    return con.execute(sql).fetchdf()


def test_odd_documents(odd, nothing):
    rows = odd.where("doc_id is not null and doc_id <> 6").select("doc_id", "text")
    assert difference(line_dedup.line_digests(rows).toPandas(), on(rows, line_dedup.LINE_DEDUP_SQL)) is None
    plain = rows.where("doc_id <> 9")                     # a NUL ends a text in the other engine's patterns
    assert difference(rules.rule_report(plain).toPandas(), on(plain, rules.RULES_SQL)) is None
    assert line_dedup.line_digests(odd).count() == odd.count() == rules.rule_report(odd).count()
    kept = line_dedup.without_repeated_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert line_dedup.line_digests(nothing).count() == rules.ledger(nothing).count() == 0


def test_hot_lines_leave_no_trace(spark, monkeypatch):
    rows = [(i, f"a line that all have\nown line number {i}\n{'a line that all have' if i % 2 else 'x'}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup._hot(line_dedup._line_hashes(docs, 10)).count() == 1
    assert difference(line_dedup.line_digests(docs).toPandas(), on(docs, line_dedup.LINE_DEDUP_SQL)) is None


def test_ledger_policies(odd):
    book = rules.ledger(odd).cache()
    for policy, names in rules.POLICIES.items():
        kept = book.where(rules.passes(policy)).count()
        for r in rules.ablations(book, policy).collect():
            bit, mask = 1 << list(rules.RULES).index(r["rule"]), rules.policy_mask(policy)
            rows = [x["failed"] & mask for x in book.collect()]
            assert r["failing"] == sum(bool(x & bit) for x in rows) and r["only"] == sum(x == bit for x in rows)
        assert kept == sum(x["failed"] & rules.policy_mask(policy) == 0 for x in book.collect())


NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] <\\s>", "<<SYS>> <</SYS>> <\\<SYS>>", "[", "<", "a[", "[[INST]]", "\\", None, "",
         "[TURN]user\nx[/TURN]", "<<</SYS>>", "🙂<s>"]


def reread(formatted):
    """Turns of a whole conversation: control strings in the order they come."""
    import re
    from urllib.parse import unquote_plus
    pieces = re.split(f"({chat.CONTROL})", formatted)
    assert len(pieces) % 4 == 1 and all(p == "" for p in pieces[::4])
    names = {m: role for role, m in chat.MARKS.items()}
    for a, body, b in zip(pieces[1::4], pieces[2::4], pieces[3::4]):
        role = names.get((a, b))
        if role is None:
            assert (a, b) == chat.OTHER
            role, body = body.split("\n", 1)
            role = unquote_plus(role)
        yield role, re.sub(r"([\[<])\\(\\*)" + chat._TAIL, r"\1\2\3", body)


def test_chat_odd_rows(spark, odd, nothing):
    """Repeated rows, very long texts, clashing names, and one conversation of many turns."""
    rows = odd.selectExpr("doc_id % 2 as conv_id", "doc_id as turn", "case when doc_id % 3 = 0 then 'assistant' else 'user' end as role", "*")
    plain = rows.select("conv_id", "turn", "role", "text").where("turn is null or turn <> 9")      # NUL: see above
    got = chat.chat_digests(rows.where("turn is null or turn <> 9")).toPandas()
    sql = chat.CHAT_SQL.replace("UNION ALL SELECT -7, n, ['user', 'assistant'][n + 1], '</s>[INST] ok [/INST]' FROM range(2) t(n)", "")
    assert difference(got, on(plain, sql, "conversations")) is None
    assert chat.chat_digests(nothing.selectExpr("doc_id as conv_id", "doc_id as turn", "text as role", "text")).count() == 0
    n = 20_000
    many = spark.range(n).selectExpr("cast(null as long) as conv_id", "id as turn",
                                     "case when id % 2 = 0 then 'user' else 'assistant' end as role", "concat('turn [INST] ', id) as text")
    r = chat.chat_format(many).collect()
    assert len(r) == 1 and len(r[0]["turns"]) == n and len(r[0]["mask"]) == n // 2
    m = r[0]["mask"][-1]
    assert r[0]["formatted"][m["start"]:m["start"] + m["length"]] == "turn [\\INST] 19999"


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "system", "tool\n[/TURN]", None, "User"]
    rows = [(i, k, roles[(i + k) % 6], NASTY[(i * 5 + k) % len(NASTY)]) for i in range(40) for k in range(i % 7 + 1)]
    rows += [(None, None, None, None), (None, 1, "user", "x"), (99, 1, "assistant", "b"), (99, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.chat_format(df).collect()}
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == want
    import re
    for c, r in got.items():
        spans = [r["formatted"][m["start"]:m["start"] + m["length"]] for m in r["mask"]]
        plain = [re.sub(r"([\[<])\\(\\*)" + chat._TAIL, r"\1\2\3", s) for s in spans]
        assert plain == [t for role, t in want[c] if role == "assistant"]
        assert all(not re.search(chat.CONTROL, s) for s in spans)
    assert chat.chat_format(df.where("false")).count() == 0
    # the whole text, read by a plain parser, gives the same turns
    for c, r in got.items():
        assert [(role, x) for role, x in reread(r["formatted"])] == want[c]
    assert got[4]["escaped"] in (True, False) and any(r["escaped"] for r in got.values()) and not all(r["escaped"] for r in got.values())
