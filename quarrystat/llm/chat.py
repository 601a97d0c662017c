"""Chat formatting that is proved by reading it back.

Template: ``[INST]user[/INST]``, ``<s>assistant</s>``, ``<<SYS>>system<</SYS>>`` and
``[TURN]role(url-encoded) newline text[/TURN]`` for any other role. Grammar: the text
between control strings alternates between nothing and one turn; a turn holds no
control string.

Escaping puts a backslash after the first character of a control string, and one
more where there are backslashes already, so it can always be undone. A turn is
rendered plainly and parsed; if what is read back is not the turn of the source it
is rendered with escapes and parsed again. A difference that survives this raises
an error. All of this happens in the turn's own row, in time proportional to its
length; a mark's end is a boundary that no control string crosses, so the turns
read back from a conversation are those of its parts.

A conversation is assembled whole, which its digest needs; nothing else is. Its text
must fit one value (2 GB).

Defined cases: null text and null role are empty strings; very long texts are one
value like any other; turns are ordered by turn, nulls last, then role and text, and
repeated rows are repeated turns; null conv_id is one conversation; an empty table
gives an empty result; other columns, whatever their names, are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[TURN]", "[/TURN]")
_TAIL = r"(/?INST\]|/?TURN\]|/?s>|<SYS>>|</SYS>>)"
CONTROL = r"\[/?INST\]|\[/?TURN\]|</?s>|<</?SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + _TAIL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + _TAIL, r"$1$2$3")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def _render(role: Column, text: Column) -> Column:
    """One turn between its marks."""
    out = F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit("\n"), text, F.lit(OTHER[1]))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(a), text, F.lit(b))).otherwise(out)
    return out


def _parse(rendered: Column) -> Column:
    """The turn that a rendered text holds, ``struct<role, text, start, length>``, start and
    length (code points) of the text as rendered; null where the grammar finds anything but
    one turn: an opening mark at the start, its closing mark at the end and none between.

    No control string reaches over the end of a mark, so turns that are read back one by one
    are read back from their concatenation too, in the same order.
    """
    def read(x):
        p, m = x["p"], x["m"]
        a, b, body = F.get(m, F.lit(0)), F.get(m, F.lit(1)), F.get(p, F.lit(1))
        sound = (F.size(p) == 3) & (F.get(p, F.lit(0)) == "") & (F.get(p, F.lit(2)) == "")
        other = (a == OTHER[0]) & (b == OTHER[1]) & (F.instr(body, "\n") > 0)
        role = F.when(other, F.try_url_decode(F.substring_index(body, "\n", 1)))
        for name, (first, last) in MARKS.items():
            role = F.when((a == first) & (b == last), F.lit(name)).otherwise(role)
        skip = F.when(other, F.instr(body, "\n")).otherwise(F.lit(0))
        said = F.when(other, F.substring(body, skip + 1, F.length(body))).otherwise(body)
        turn = F.struct(role.alias("role"), unescape(said).alias("text"),
                        (F.length(a) + skip).alias("start"), F.length(said).alias("length"))
        return F.when(sound & role.isNotNull(), turn)
    return _let(F.struct(F.split(rendered, CONTROL, -1).alias("p"),
                         F.regexp_extract_all(rendered, F.lit(f"({CONTROL})"), 1).alias("m")), read)


def turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, out, escaped, read)``: each turn rendered and read back, in its row.

    A turn whose plain form is not read back as it was is rendered with escapes; where that is
    not read back either, an error is raised. ``place`` sorts the turns of a conversation.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = rows.select("conv_id", F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"),
                                          role.alias("role"), text.alias("text")).alias("place"))
    role, text = F.col("place.role"), F.col("place.text")

    def same(read):
        return F.coalesce((read["role"] == role) & (read["text"] == text), F.lit(False))

    def tried(body):
        return _let(_render(role, body), lambda out: _let(_parse(out), lambda read: F.struct(
            out.alias("out"), read.alias("read"), same(read).alias("same"))))
    proved = _let(tried(text), lambda plain: F.when(plain["same"], F.struct(
        plain["out"].alias("out"), F.lit(False).alias("escaped"), plain["read"].alias("read"))).otherwise(
        _let(tried(escape(text)), lambda safe: F.when(safe["same"], F.struct(
            safe["out"].alias("out"), F.lit(True).alias("escaped"), safe["read"].alias("read"))).otherwise(F.raise_error(
                F.concat(F.lit("not read back: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))))
    return src.select("conv_id", "place", proved.alias("t")).select("conv_id", "place", "t.out", "t.escaped", "t.read")


def _assembled(parts: DataFrame, *more: Column) -> DataFrame:
    """The turns of each conversation in order, as one array ``t``."""
    turn = F.struct("place", "out", "escaped", "read", *more)
    return parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))


def chat_format(rows: DataFrame) -> DataFrame:
    """``(conv_id, formatted, escaped, turns, mask)``: the text, whether it needed escapes,
    the turns read back, and ``array<struct<start, length>>`` of what is trained on."""
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns(rows).withColumn("at", F.coalesce(F.sum(F.length("out")).over(before), F.lit(0)).cast("int"))
    turn = F.struct("place", "at", "out", "escaped", "read")       # equal turns keep the order of their places
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    read = F.transform("t", lambda x: F.struct(
        x["read"]["role"].alias("role"), x["read"]["text"].alias("text"),
        (x["at"] + x["read"]["start"]).alias("start"), x["read"]["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"),
                        F.exists("t", lambda x: x["escaped"]).alias("escaped"), read.alias("turns")).select(
        "*", F.transform(F.filter("turns", lambda t: t["role"] == "assistant"),
                         lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("mask"))


def chat_digests(rows: DataFrame) -> DataFrame:
    """The digest columns of every conversation, all from what was read back."""
    c = _assembled(turns(rows)).select("conv_id", F.transform("t", lambda x: x["read"]).alias("turns"),
                                       F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + F.length(x["out"])).alias("chars"))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.withColumn("said", said).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"))


#: The conversation that every run formats as well.
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def with_extra(rows: DataFrame) -> DataFrame:
    cols = rows.select("conv_id", "turn", "role", "text")
    extra = rows.sparkSession.range(2).select(
        F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return cols.unionByName(extra)


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, ['user', 'assistant'][n + 1], '</s>[INST] ok [/INST]' FROM range(2) t(n)),
e AS (SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?TURN\]|/?s>|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS safe,
  CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + length(url_encode(role)) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
