"""Likeness of names: the share of a longest common subsequence after their words are sorted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import normalized

#: So many characters fit the 64-bit state; where both names are longer, :func:`common_length` goes row by row.
STATE_CHARS = 60


def sorted_words(name: Column) -> Column:
    """The name's normalised words in order, joined by one space."""
    return F.array_join(F.array_sort(F.filter(F.split(normalized(name), " "), lambda w: w != "")), " ")


def common_length(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two string columns, ``a`` being the shorter.

    Up to STATE_CHARS characters of ``a``, one bit for each of them says where the length grows; a step takes one
    character of ``b``. The masks of a character's places in ``a`` are built once for each pair. Longer ones, which are
    rare, go by the plain recurrence, a row for each character of ``b``.
    """
    chars = f"filter(split({a}, ''), c -> c <> '')"
    places = f"map_from_entries(transform(array_distinct(m.x), c -> struct(c, aggregate(sequence(0, size(m.x) - 1), 0L, (s, i) -> s | if(m.x[i] = c, shiftleft(1L, i), 0L)))))"
    full = f"(shiftleft(1L, char_length({a})) - 1L)"
    step = f"aggregate(array(coalesce(try_element_at(q.m, c), 0L)), s, (t, k) -> ((t + (t & k)) | (t & ~k)) & {full})"
    run = f"aggregate(filter(split({b}, ''), c -> c <> ''), {full}, (s, c) -> {step}, s -> int(char_length({a}) - bit_count(s & {full})))"
    inner = f"transform(array(named_struct('x', {chars})), m -> named_struct('m', {places}))"
    short = f"get(transform({inner}, q -> {run}), 0)"
    row = "aggregate(sequence(1, size(m.x)), array(0), (new, i) -> array_append(new, if(m.x[i - 1] = c, old[i - 1] + 1, greatest(new[i - 1], old[i]))))"
    rows = f"aggregate(filter(split({b}, ''), c -> c <> ''), array_repeat(0, size(m.x) + 1), (old, c) -> {row}, old -> element_at(old, -1))"
    long = f"get(transform(array(named_struct('x', {chars})), m -> {rows}), 0)"
    return F.expr(f"case when {a} = '' or {b} = '' then 0 when char_length({a}) <= {STATE_CHARS} then {short} else {long} end")


def score(a: str, b: str) -> Column:
    """200 times the common length over both lengths, for columns of sorted words; 100 for equal ones."""
    common = F.when(F.char_length(a) <= F.char_length(b), common_length(a, b)).otherwise(common_length(b, a))
    return F.when(F.col(a) == F.col(b), F.lit(100.0)).otherwise(200.0 * common / (F.char_length(a) + F.char_length(b)))


def method_text(value: Column) -> Column:
    """``fuzzy:<score>``, rounded half to even."""
    return F.concat(F.lit("fuzzy:"), F.bround(value, 0).cast("int").cast("string"))


def lcs(a: str, b: str) -> int:
    """The same length for texts of any size."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & places.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def long_score(a: str, b: str) -> float:
    return 100.0 if a == b else 200.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0
