"""Line dedup by a segment-partition edit join, in DataFrame and SQL functions only.

A line is cut into ``edits + 1`` segments. If two lines are within ``edits`` edits, some segment of the shorter occurs
in the longer at a place that their lengths allow. So each line files its segments by (length, number, content) and
probes the entries of its own length and of up to ``edits`` less with the few substrings that can match. Only hashes
travel, and only the first place of a line probes. Lines that share a key are paired if their letter counts allow it;
these pairs are verified by a banded edit automaton whose states, one bit for each diagonal and number of edits, fit one
64-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mapwright.storage import materialize

from .words import fresh, inner_id

EDITS = 2
#: Two edits change too much of a shorter line for it to be called the same: such lines are compared for equality only.
MIN_CHARS = 12
#: So many keys or lines, of under 250 bytes each in a hash table, are broadcast at most (125 MB); with more, they meet
#: in a shuffle join, which moves the texts.
BROADCAST_ROWS = 500_000

#: Letters whose counts are compared before a pair is verified: one edit changes them by two in all at most.
_LETTERS = "etanoirshldu"
#: Steps by which a common prefix or suffix is found.
_STEPS = "array(" + ",".join(str(1 << k) for k in range(13, -1, -1)) + ")"


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, tag, at, line, h1, h2``: the lines of each text that are not blank, with a 128-bit hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(inner_id(id_col).alias("id"), F.xxhash64(text).alias("tag"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return rows.where(F.trim("line") != "").select("id", "tag", "at", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("wide"), "line").alias("h2"))


def _probes(edits: int) -> list[tuple[int, int, int]]:
    """(length less, segment, shift) at which a segment of a line that is so much shorter may occur."""
    return [
        (less, seg, shift)
        for less in range(edits + 1)
        for seg in range(edits + 1)
        for shift in range(max(-seg, less - (edits - seg)), min(seg, less + edits - seg) + 1)
    ]


def _keyed(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``h1, h2, key, filed``: the lines' probes; the unshifted ones at their own length are also their entries.

    Each line meets the short list of probes first, so that one small expression makes all keys.
    """
    parts = edits + 1
    probes = ", ".join(f"named_struct('less', {less}, 'seg', {seg}, 'shift', {shift})" for less, seg, shift in _probes(edits))
    long = lines.select("h1", "h2", "line", F.char_length("line").alias("n")).where(F.col("n") >= max(min_chars, parts))
    probed = long.select("h1", "h2", "line", "n", F.inline(F.expr(f"array({probes})")))
    sized = probed.withColumn("size", F.expr(f"int((n - less) div {parts})")).withColumn("rest", F.expr(f"int((n - less) % {parts})"))
    placed = sized.withColumn("start", F.expr(f"seg * size + greatest(0, seg - ({parts} - rest)) + shift")).withColumn("long", F.expr(f"size + if(seg >= {parts} - rest, 1, 0)"))
    fits = placed.where("size > 0 and start >= 0 and start + long <= n")
    key = F.xxhash64("seg", F.col("n") - F.col("less"), F.substring("line", F.col("start") + 1, F.col("long")))
    return fits.select("h1", "h2", key.alias("key"), F.expr("if(less = 0 and shift = 0, 1, 0)").alias("filed"))


def within(a: str, b: str, edits: int) -> Column:
    """Whether the edit distance of two string columns is at most ``edits`` (up to 4); ``a`` is not longer than ``b``.

    The common prefix and suffix are cut off. Over the rest of ``b``, bit k of the vector for d edits says that the
    prefix of ``a`` on diagonal k is reached with d edits; the vectors lie side by side in one integer.
    """
    if not 0 <= edits <= 4:
        raise ValueError("edits must lie between 0 and 4")
    width = 2 * edits + 1
    full = (1 << width) - 1

    def pick(state: str, d: int) -> str:
        return f"(shiftright({state}, {d * width}) & {full}L)"

    def common(x: str, y: str, side: str) -> str:
        return f"aggregate({_STEPS}, 0, (p, s) -> if(p + s <= char_length({x}) and p + s <= char_length({y}) and {side}({x}, p + s) = {side}({y}, p + s), p + s, p))"

    def tail(x: str, cut: str) -> str:
        return f"substring({x}, {cut} + 1)"

    def head(x: str, cut: str) -> str:
        return f"left({x}, char_length({x}) - {cut})"

    eq = " | ".join(f"if(coalesce(get(z.x, j + {k - edits}) = get(z.y, j), false), {1 << k}L, 0L)" for k in range(width))
    # new vectors in order of d, each from the one before
    new = [f"({pick('s.v', 0)} & s.e)"]
    for d in range(1, edits + 1):
        less = pick("s.v", d - 1)
        new.append(f"((({pick('s.v', d)} & s.e) | {less} | shiftright({less}, 1) | shiftleft({new[d - 1]}, 1)) & {full}L)")
    joined = " | ".join(f"shiftleft({v}, {d * width})" for d, v in enumerate(new))
    start = sum((((1 << (d + 1)) - 1) << edits & full) << (d * width) for d in range(edits + 1))
    step = f"aggregate(array(named_struct('v', v, 'e', {eq})), 0L, (acc, s) -> {joined})"
    end = f"(shiftright({pick('v', edits)}, int(size(z.x) - size(z.y) + {edits})) & 1L) = 1L"
    run = f"aggregate(sequence(0, size(z.y) - 1), {start}L, (v, j) -> {step}, v -> {end})"
    # each stage is bound to a name once, by a lambda over a one-element array
    cut_1 = f"transform(array(named_struct('a', {a}, 'b', {b}, 'p', {common(a, b, 'left')})), q -> named_struct('a', {tail('q.a', 'q.p')}, 'b', {tail('q.b', 'q.p')}))"
    cut_2 = f"transform({cut_1}, q -> named_struct('a', q.a, 'b', q.b, 'p', {common('q.a', 'q.b', 'right')}))"
    cut_3 = f"transform({cut_2}, q -> named_struct('a', {head('q.a', 'q.p')}, 'b', {head('q.b', 'q.p')}))"
    split = f"transform({cut_3}, q -> named_struct('x', filter(split(q.a, ''), c -> c <> ''), 'y', filter(split(q.b, ''), c -> c <> '')))"
    test = f"transform({split}, z -> if(size(z.y) - size(z.x) > {edits}, false, if(size(z.x) = 0, true, {run})))"
    return F.expr(f"get({test}, 0)")


def _meet(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that have a match in ``keys``, which are broadcast while they are few."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")


def _repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``h1, h2, first``: the first place of each line that has several."""
    places = lines_of(docs, id_col, text_col).select("id", "tag", "at", "h1", "h2")
    again = places.groupBy("h1", "h2").agg(F.min(F.struct("id", "tag", "at")).alias("first"), F.count("*").alias("times"))
    return materialize(again.where("times > 1").drop("times"), "lines-repeated")


def _bag(line: str) -> Column:
    return F.array(*[F.char_length(line) - F.char_length(F.replace(F.col(line), F.lit(c), F.lit(""))) for c in _LETTERS])


def line_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, repeated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between different lines within ``edits`` edits, and the lines that may have one.

    ``links``: ``a1, a2, b1, b2`` (hashes; each pair once). ``found``: ``h1, h2, line, first`` (its first place: id,
    tag, at). Copies of a line are one line here.
    """
    repeated = _repeated(docs, id_col, text_col) if repeated is None else repeated
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lines = lines_of(docs, id_col, text_col).withColumn("place", F.struct("id", "tag", "at"))
    firsts = lines.join(F.broadcast(repeated) if few else repeated, ["h1", "h2"], "left").where("first is null or first = place")
    keyed = _keyed(firsts, edits, min_chars)
    by_key = W.partitionBy("key")
    met = keyed.select("*", F.min("h1").over(by_key).alias("low"), F.max("h1").over(by_key).alias("high"), F.max("filed").over(by_key).alias("entry"))
    cand = materialize(met.where("low <> high and entry = 1").select("key", "h1", "h2", "filed"), "lines-candidates")
    ids = cand.select("h1", "h2").distinct()
    # rows with equal id, text and place are alike
    found = materialize(_meet(firsts, ids, ["h1", "h2"]).select("h1", "h2", "line", F.col("place").alias("first")).dropDuplicates(["h1", "h2"]).withColumn("bag", _bag("line")).withColumn("n", F.char_length("line")), "lines-found")
    bagged = cand.join(found.select("h1", "h2", "bag", "n"), ["h1", "h2"])
    short = bagged.where("filed = 1").select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("bag").alias("x_bag"), F.col("n").alias("x_n"))
    other = bagged.select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("bag").alias("y_bag"), F.col("n").alias("y_n"))
    apart = sum((F.abs(F.col("x_bag")[k] - F.col("y_bag")[k]) for k in range(len(_LETTERS))), F.lit(0))
    # the entries are the shorter line's; of two lines of one length, those of the one with the lesser hash
    turn = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & ((F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2")))))
    near = (short["key"] == other["key"]) & turn & (apart <= 2 * edits) & (F.col("y_n") - F.col("x_n") <= edits)
    pairs = short.join(other, near).select("a1", "a2", "b1", "b2").distinct()
    text_a = found.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("x"))
    text_b = found.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("y"))
    both = pairs.join(text_a, ["a1", "a2"]).join(text_b, ["b1", "b2"])
    links = both.where(within("x", "y", edits)).select("a1", "a2", "b1", "b2")
    return materialize(links, "lines-links"), found


def _removed(docs: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int) -> DataFrame:
    """``id, tag, gone (line numbers), n_near, n_links`` for the texts that have a line to remove or a linked one."""
    repeated = _repeated(docs, id_col, text_col)
    links, found = line_links(docs, id_col=id_col, text_col=text_col, edits=edits, min_chars=min_chars, repeated=repeated)
    both = links.union(links.select("b1", "b2", "a1", "a2")).toDF("h1", "h2", "o1", "o2")
    place = found.select("h1", "h2", "first")
    near = (
        both.join(place, ["h1", "h2"])
        .join(place.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("other")), ["o1", "o2"])
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("links"), F.max((F.col("other") < F.col("first")).cast("int")).alias("near"))
    )
    places = lines_of(docs, id_col, text_col).select("id", "tag", "at", "h1", "h2")
    marked = materialize(repeated.join(near, ["h1", "h2"], "full"), "lines-marked")
    few = marked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hit = places.join(F.broadcast(marked) if few else marked, ["h1", "h2"])
    copy = F.coalesce(F.struct("id", "tag", "at") != F.col("first"), F.lit(False))
    gone = copy | (F.coalesce("near", F.lit(0)) == 1)
    per_row = hit.groupBy("id", "tag").agg(
        F.collect_set(F.when(gone, F.col("at"))).alias("gone"),
        F.count_if(~copy & gone).alias("n_near"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
    )
    return materialize(per_row, "lines-gone")


# the text is split once, and bound to a name by a lambda over a one-element array
_REBUILT = "get(transform(array(split(`{text}`, '\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), {gone}), i -> l[i]), '\n')), 0)"


def _joined(docs: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int) -> tuple[DataFrame, DataFrame, str]:
    """The rows of ``docs`` that are touched, with a column (its name comes last) of what to do (gone, n_near, n_links),
    and the rows left as they are."""
    pre = fresh(docs)
    one, tag, marks = f"{pre}id", f"{pre}tag", f"{pre}marks"
    gone = _removed(docs, id_col, text_col, edits, min_chars).select(F.col("id").alias(one), F.col("tag").alias(tag), F.struct("gone", "n_near", "n_links").alias(marks))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    on = (inner_id(id_col) == F.col(one)) & (F.xxhash64(text) == F.col(tag))
    ids = gone.select(one, tag)
    if ids.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return docs.join(gone, on, "left"), docs.limit(0), marks
    touched = docs.join(F.broadcast(ids), on, "left_semi").join(gone, on)
    return touched, docs.join(F.broadcast(ids), on, "left_anti"), marks


def _kept_text(text_col: str, marks: str) -> Column:
    return F.when(F.size(F.col(marks)["gone"]) > 0, F.expr(_REBUILT.format(text=text_col, gone=f"{marks}.gone"))).otherwise(F.col(text_col))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col`` (and ``chars_col``, if named, set to its length).

    A line goes if it occurs earlier (in a smaller id, or further up), or if its first place comes after the first
    place of a line within ``edits`` edits; whether that one stays does not matter. Blank lines stay and are never
    compared; lines under ``min_chars`` characters go only as exact copies. A text none of whose lines goes, null and
    empty ones among them, stays as it is; one that loses all becomes empty. Rows with equal id and text are treated
    alike; a null id counts as the smallest. A text of any length is split whole, a line of any length compared whole.
    An empty table gives an empty table.
    """
    touched, same, marks = _joined(docs, id_col, text_col, edits, min_chars)
    out = touched.withColumn(text_col, _kept_text(text_col, marks)).select(docs.columns)
    if chars_col:
        out = out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return out.union(same.select(docs.columns))


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_removed, n_near, n_links, kept_sha256``.

    Lines that are not blank, those removed and those of them removed as near copies, the links of its lines to other
    lines, and the digest of the text that :func:`dedup_lines` leaves (a null text as empty).
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    touched, same, marks = _joined(d, "doc_id", "text", edits, min_chars)
    mark = F.col(marks)
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")).cast("long")
    def digest(text: Column) -> Column:
        return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("kept_sha256")
    zero = F.lit(0).cast("long")
    changed = touched.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size(mark["gone"]).cast("long"), zero).alias("n_removed"), F.coalesce(mark["n_near"], zero).alias("n_near"), F.coalesce(mark["n_links"], zero).alias("n_links"), digest(_kept_text("text", marks)))
    rest = same.select("doc_id", n_lines.alias("n_lines"), zero.alias("n_removed"), zero.alias("n_near"), zero.alias("n_links"), digest(F.col("text")))
    return changed.union(rest)
