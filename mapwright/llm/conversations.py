"""Repair of the structure of conversations: cheapest edits that make the roles take turns.

A conversation is told by its signature, one character a row for role and fault. Every distinct signature is solved
once, by memoised recursion, in whatever task it lands; the audits go back to the conversations by a join. Texts take
no part in that: edits are replayed over the rows as they stream by, sorted by conversation and place.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.storage import materialize

#: Prices of the edits; a truncated row that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: U+0020 and U+0009 to U+000D
SPACES = " \t\n\x0b\x0c\r"
NEVER = 1 << 40
#: States of what has been put out: nothing, a system row, a user row, an assistant row; and where a user or assistant row leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits; of equally cheap ones the audit that is least in ASCII.

    A signature has for each row ``x`` where it must go, else its role (s, u, a, other: o), in upper case where it is
    truncated. An audit has D, K and R for rows that are deleted, kept and given the other role, and I for inserted ones.
    Options at a point differ in their letter, so a tie is settled there. More than two inserts in a row never pay.
    """
    n = len(signature)
    costs, letters = array("q", [-1]) * (12 * (n + 1)), bytearray(12 * (n + 1))

    def best(k: int, state: int, inserts: int) -> int:
        at = 12 * k + 3 * state + inserts
        if costs[at] < 0:
            options = []
            if k == n:
                options.append((0 if state in (START, ASSISTANT) else NEVER, ""))
            else:
                row, more = signature[k].lower(), TRUNCATED if signature[k].isupper() else 0
                options.append((DELETE + best(k + 1, state, 0), "D"))
                if (to := _KEPT.get(row, {}).get(state)) is not None:
                    options.append((more + best(k + 1, to, 0), "K"))
                if row != "x":
                    options.append((REROLE + more + best(k + 1, NEXT[state], 0), "R"))
            if inserts < 2:
                options.append((INSERT + best(k, NEXT[state], inserts + 1), "I"))
            costs[at], letter = min(options)
            letters[at] = ord(letter or "\0")
        return costs[at]

    for k in range(n, -1, -100):  # from the end, so that recursion stays shallow
        for state in range(4):
            best(k, state, 0)
    cost, k, state, inserts, audit = best(0, START, 0), 0, START, 0, []
    while letter := chr(letters[12 * k + 3 * state + inserts]).strip("\0"):
        audit.append(letter)
        if letter == "I":
            state, inserts = NEXT[state], inserts + 1
            continue
        state = _KEPT[signature[k].lower()][state] if letter == "K" else NEXT[state] if letter == "R" else state
        k, inserts = k + 1, 0
    return cost, "".join(audit)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])


def damage(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text`` of the rows, damaged by a hash of conversation and turn: for trials of the repair.

    Of 20 rows about one each is dropped, loses its text, loses its full stops and marks, is there twice, or is a user's.
    Null roles and texts, and nulls in the hash, are one space; null turns stay null.
    """
    conv, turn, role, text = (F.col(c) for c in (conv_col, turn_col, role_col, text_col))
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), F.coalesce(text.cast("string"), F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    texts = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.where("kind <> 0").select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), texts.alias("text"), F.explode(times).alias("_time"))
    return rows.drop("_time")


def _initial(role: str) -> Column:
    return F.substring(role, 1, 1)


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with ``pos`` in their conversation from 1, ``fault`` and ``symbol``; written to the shared folder.

    Ordered by turn, null first, then by role and text. One exchange: everything is a window of the conversation.
    """
    whole = W.partitionBy("conv")
    ordered = whole.orderBy(F.asc_nulls_first("turn"), "role", "text")
    bare = F.rtrim("text", F.lit(SPACES))
    rows = rows.withColumns({"pos": F.row_number().over(ordered), "before": F.lag("turn").over(ordered), "prior": F.lag(_initial("role")).over(ordered)})
    again = F.row_number().over(W.partitionBy("conv", "role", "text").orderBy("pos")) > 1
    fault = F.when(bare == "", "blank").when(again, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.when(_initial("role").isin("s", "u", "a"), _initial("role")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    illegal = F.col("prior").isNotNull() & ~F.concat("prior", _initial("role")).isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("turn")))
    out = rows.withColumn("fault", fault).select("conv", "turn", "role", "text", "pos", "fault", symbol.alias("symbol"), illegal.alias("illegal"), new_turn.alias("new_turn"))
    return materialize(out, "conversations-rows")


def audits(rows: DataFrame) -> DataFrame:
    """For each conversation of :func:`marked` rows: counts of faults, cost and audit."""
    by_conv = rows.groupBy("conv").agg(
        F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1) - F.count_if("new_turn")).alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.count_if("illegal").alias("illegal"),
        F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("symbols"),
    )
    by_conv = by_conv.select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.array_join("symbols.symbol", "").alias("signature"))
    by_conv = materialize(by_conv, "conversations-signatures")
    solved = by_conv.select("signature").distinct().mapInArrow(_solved, "signature string, cost long, audit string")
    return materialize(by_conv.join(solved, "signature").drop("signature"), "conversations-audits")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, None, None) where one begins, then (conversation, role, text) of each row of its repaired form."""
    conv, left, state = None, iter(()), START

    def inserted(letter):
        nonlocal state
        while letter == "I":
            state = NEXT[state]
            yield conv, ROLES[state], ""
            letter = next(left, None)
        return letter

    for batch in batches:
        for one, pos, audit, role, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if pos == 0:
                yield from inserted(next(left, None))
                conv, left, state = one, iter(audit), START
                yield conv, None, None
                continue
            letter = yield from inserted(next(left, None))
            if letter == "K":
                state = _KEPT[role[0]][state]
                yield conv, role, text
            elif letter == "R":
                state = NEXT[state]
                yield conv, ROLES[state], text
    yield from inserted(next(left, None))


def _replay(rows: DataFrame, audited: DataFrame, run, schema: str) -> DataFrame:
    """Audits, each before the rows of its conversation, through ``run``: a task holds an audit and a batch at a time."""
    heads = audited.select("conv", F.lit(0).alias("pos"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(rows.select("conv", "pos", F.lit(None).cast("string").alias("audit"), "role", "text"))
    return both.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(run, schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows):
        convs, places, roles, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "place", "role", "text"])

    held, place = [], 0
    for conv, role, text in _events(batches):
        place = place + 1 if role is not None else 0
        if role is not None:
            held.append((conv, place, role, text))
        if len(held) >= 5_000:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv", "repaired_sha256"])

    held, now, digest, first = [], None, None, True
    for conv, role, text in _events(batches):
        if role is None:
            if digest is not None:
                held.append((now, digest.hexdigest()))
            now, digest, first = conv, hashlib.sha256(), True
        else:
            digest.update(("" if first else "\n").encode() + role.encode() + b":" + text.encode())
            first = False
        if len(held) >= 5_000:
            yield batch(held)
            held = []
    if digest is not None:
        held.append((now, digest.hexdigest()))
    if held:
        yield batch(held)


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))


def repaired_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, role, text``: the rows of every repaired conversation, ``place`` from 1. See :func:`repair_report`."""
    rows = marked(_rows(conversations, conv_col, turn_col, role_col, text_col))
    return _replay(rows, audits(rows), _turns, "conv_id long, place long, role string, text string")


def repair_report(conversations: DataFrame, rows: DataFrame | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    The first fault of a row counts: blank; a duplicate of an earlier row's role and text; truncated, when its last
    character other than white space is none of ``.!?``. Cheapest edits give roles that begin with s, u and a either
    nothing or a system row, if any, and user and assistant in turn.

    ``rows`` (conv, turn, role, text) are looked at in place of the table's own, as after :func:`damage`; conversations
    without any are still returned, with zeros. Null roles and texts are one space, so a null text is blank; rows without
    an id are one conversation; an empty role is none of s, u and a; null turns come first and leave no gap. Rows of one turn go by role, then text, and equal
    rows are duplicates. Gaps that no 64-bit number holds are 0. An empty table gives no row; other columns are not looked
    at. Long texts stream by; of a conversation only one symbol a row, its prices and its audit are in one task's memory.
    """
    rows = marked(_rows(conversations, conv_col, turn_col, role_col, text_col) if rows is None else rows.withColumn("conv", F.col("conv").cast("long")))
    audited = audits(rows)
    digests = _replay(rows, audited, _digests, "conv long, repaired_sha256 string")
    every = conversations.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    found = audited.withColumnRenamed("conv", "own").join(digests, F.col("own").eqNullSafe(F.col("conv"))).drop("conv")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLE_SQL = r"""
with recursive crcs as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) tab),
c as (
  select dense_rank() over (order by conv_id nulls first) k, conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') "text",
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
      lambda a, b: xor(tab[xor(a % 256, b) + 1], a // 256))) % 20 kind
  from conversations, crcs),
d as (
  select k, turn, case when kind = 4 then 'user' else role end role,
    case kind when 1 then '' when 2 then translate("text", '.!?', '') else "text" end "text"
  from c, (select unnest([1, 2]) time) where kind <> 0 and (time = 1 or kind = 3)),
p as (select *, row_number() over (partition by k order by turn nulls first, role, "text") pos, count(*) over (partition by k) n from d),
f as (
  select *, rtrim("text", chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) bare, left(role, 1) r,
    lag(left(role, 1)) over (partition by k order by pos) || left(role, 1) two, row_number() over (partition by k, role, "text" order by pos) nth from p),
g as (select *, case when bare = '' then 'blank' when nth > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end fault from f),
stats as (
  select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 'blank') blank, count(*) filter (where fault = 'duplicate') duplicate,
    count(*) filter (where fault = 'truncated') truncated, count(*) filter (where two not in ('su', 'ua', 'au')) illegal
  from g group by k),
-- backward: prices from here on by state (nothing, system, user, assistant), without inserts, with up to one, with up to two
b as (
  select distinct k, n + 1 pos, [0, 99999999, 99999999, 0] w, [0, 99999999, 5, 0] w1, [0, 10, 5, 0] w0 from g
  union all
  select k, pos, w, w1, [least(w[1], 5 + w1[3]), least(w[2], 5 + w1[3]), least(w[3], 5 + w1[4]), least(w[4], 5 + w1[3])] from (
    select k, pos, w, [least(w[1], 5 + w[3]), least(w[2], 5 + w[3]), least(w[3], 5 + w[4]), least(w[4], 5 + w[3])] w1 from (
      select g.k, g.pos, list_transform([1, 2, 3, 4], lambda s: least(
          2 + b.w0[s],
          case when fault in ('blank', 'duplicate') then 99999999 else
            case when fault = 'truncated' then 5 else 0 end + least(
              1 + b.w0[case when s = 3 then 4 else 3 end],
              case when r = 's' and s = 1 then b.w0[2] when r = 'u' and s <> 3 then b.w0[3] when r = 'a' and s = 3 then b.w0[4] else 99999999 end) end)) w
      from b join g on g.k = b.k and g.pos = b.pos - 1))),
o as (
  select g.k, g.pos, g.r, g.role, g."text", b.w, b.w1, n.w0 after, case when fault in ('blank', 'duplicate') then 99999999 when fault = 'truncated' then 5 else 0 end more
  from g join b using (k, pos) join b n on n.k = g.k and n.pos = g.pos + 1
  union all select k, pos, '', '', '', w, w1, [0, 0, 0, 0], 99999999 from b where pos = (select max(g.n) + 1 from g where g.k = b.k)),
-- forward: the cheapest option, of equal ones the least letter
a as (
  select k, 1::bigint pos, 1 s, 0 ins, '' audit, null::varchar repaired, false ended from stats
  union all
  select k, case when pick in ('I', '') then pos else pos + 1 end,
    case when pick in ('I', 'R') then case when s = 3 then 4 else 3 end when pick = 'K' then case r when 's' then 2 when 'u' then 3 else 4 end else s end,
    case when pick = 'I' then ins + 1 else 0 end, audit || pick,
    case when pick in ('D', '') then repaired else coalesce(repaired || chr(10), '') || case when pick = 'K' then role when s = 3 then 'assistant' else 'user' end || ':' || case when pick = 'I' then '' else "text" end end,
    pick = ''
  from (
    select a.k, a.pos, a.s, a.ins, a.audit, a.repaired, o.r, o.role, o."text",
      list_sort([
        struct_pack(c := case when o.pos = last and o.w[a.s] = 0 then 0 else 99999999 end, l := ''),
        struct_pack(c := case when o.pos = last then 99999999 else 2 + after[a.s] end, l := 'D'),
        struct_pack(c := case a.ins when 0 then 5 + w1[case when a.s = 3 then 4 else 3 end] when 1 then 5 + w[case when a.s = 3 then 4 else 3 end] else 99999999 end, l := 'I'),
        struct_pack(c := more + case when o.r = 's' and a.s = 1 then after[2] when o.r = 'u' and a.s <> 3 then after[3] when o.r = 'a' and a.s = 3 then after[4] else 99999999 end, l := 'K'),
        struct_pack(c := more + 1 + after[case when a.s = 3 then 4 else 3 end], l := 'R')])[1].l pick
    from a join o on o.k = a.k and o.pos = a.pos join (select k, max(n) + 1 last from g group by k) e on e.k = a.k where not a.ended))
select conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, coalesce(b.w0[1], 0)::bigint "cost", coalesce(audit, '') audit, sha256(coalesce(repaired, '')) repaired_sha256
from (select distinct k, conv_id from c) ids left join stats using (k) left join (select * from a where ended) using (k) left join (select * from b where pos = 1) b using (k)
"""
