"""Document fingerprints: a canonical exact digest.

A text's canonical form is its NFKC form, case-folded, with runs of white space as one space and none at the ends. The
fingerprint is two chained 64-bit xxhashes of it. Inside a bucket of equal hashes the canonical forms are compared
byte by byte; should different ones meet, the later ones (by bytes) get a number at the end of their fingerprint, so
equal fingerprints always mean equal canonical forms.

All of it is DataFrame functions; normalisation and case folding call the ICU library that comes with Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mapwright.storage import materialize

from .words import inner_id, outer_id

#: A bucket's row is repeated so many times to meet a hot bucket's members in as many tasks.
SALTS = 16


def _icu(name: str, method: str, text: Column) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{name}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC, and white space folded; null becomes the empty text."""
    folded = _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", F.coalesce(text.cast("string"), F.lit(""))))
    return F.btrim(F.regexp_replace(_icu("text.Normalizer", "compose", folded), r"(?U)\s+", " "))


def _hashes(form: Column) -> list[Column]:
    return [F.xxhash64(form).alias("h1"), F.xxhash64(F.lit("wide"), form).alias("h2")]


def _printed(h1: str = "h1", h2: str = "h2") -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in (h1, h2)])


def _collisions(forms: DataFrame) -> DataFrame:
    """``(h1, h2, form, number)`` for the buckets of ``forms`` (h1, h2, form) that hold different forms, numbered from 1.

    Equal forms become one where they are, before any of them moves, so a hot bucket is as small as its forms are few.
    """
    unlike = materialize(forms.distinct(), "fingerprints-forms")
    apart = unlike.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    return unlike.join(apart, ["h1", "h2"]).withColumn("number", F.row_number().over(W.partitionBy("h1", "h2").orderBy("form")))


def _repeated(hashed: DataFrame) -> DataFrame:
    """The rows of ``hashed`` (h1, h2, ...) whose bucket has more than one; hot buckets are salted."""
    many = hashed.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return hashed.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(many, ["h1", "h2", "salt"], "left_semi").drop("salt")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", collisions: bool = True) -> DataFrame:
    """``doc_id, fingerprint``, one row per row of ``docs``.

    A null text counts as empty; texts equal in canonical form have equal fingerprints, others never. A null
    ``doc_id`` stays null; rows that share one have a row each. A text of any length is one value of a column. An empty
    table gives no row. Other columns are not looked at.
    """
    d = docs.select(inner_id(id_col).alias("id"), canonical(F.col(text_col)).alias("form"))
    hashed = d.select("id", *_hashes(F.col("form")), "form")
    if not collisions:
        return hashed.select(outer_id("id").alias("doc_id"), _printed().alias("fingerprint"))
    small = materialize(hashed.select("id", "h1", "h2"), "fingerprints")
    twice = materialize(_repeated(small), "fingerprints-repeated")
    forms = hashed.join(twice.distinct(), ["id", "h1", "h2"], "left_semi").select("h1", "h2", "form")
    odd = materialize(_collisions(forms), "fingerprints-collisions")
    if odd.isEmpty():
        return small.select(outer_id("id").alias("doc_id"), _printed().alias("fingerprint"))
    tagged = hashed.join(odd, ["h1", "h2", "form"], "left")
    return tagged.select(outer_id("id").alias("doc_id"), F.when(F.col("number") > 1, F.concat(_printed(), F.lit("-"), F.col("number").cast("string"))).otherwise(_printed()).alias("fingerprint"))


def duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, class_id``: the class of equal canonical forms, named by its least ``doc_id``."""
    prints = fingerprints(docs, id_col=id_col, text_col=text_col)
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    return prints.join(least, "fingerprint").select("doc_id", "fingerprint", "class_id")


def likeness(a: Column, b: Column) -> Column:
    """1.0 for equal fingerprints, else 0.0: an exact digest knows no degrees."""
    return F.when(a == b, 1.0).otherwise(0.0)


def successors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, next, n, need``: the id after each in ascending order (after the last: the first), code points, and how
    many leading ones the id before it asks for. Ids are dealt out by range; only each range's ends meet."""
    ids = docs.select(inner_id(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(ids.groupBy("id").agg(F.min("n").alias("n")).repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "successors")
    ends = dealt.groupBy("part").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max_by("n", "id").alias("high_n"))
    every = W.orderBy("low")  # one row for each partition
    around = W.orderBy("low").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ring = ends.select(
        "part",
        F.coalesce(F.lead("low").over(every), F.first("low").over(around)).alias("after"),
        F.coalesce(F.lag("high_n").over(every), F.last("high_n").over(around)).alias("before_n"),
    )
    inside = W.partitionBy("part").orderBy("id")
    linked = dealt.select("id", "n", "part", F.lead("id").over(inside).alias("next"), F.lag("n").over(inside).alias("prev_n")).join(F.broadcast(ring), "part")
    return linked.select("id", F.coalesce("next", "after").alias("next"), "n", F.floor(F.coalesce("prev_n", "before_n") / 4).cast("long").alias("need"))


def edited_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the start of the next document's text.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Of rows that
    share a ``doc_id`` the least text counts. Nulls, empty texts and tables: as for :func:`fingerprints`.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(inner_id(id_col).alias("id"), text.alias("text"))
    if not d.groupBy("id").count().where("count > 1").isEmpty():
        d = d.groupBy("id").agg(F.min("text").alias("text"))
    links = materialize(successors(d, id_col="id"), "successors-links")
    lead = d.join(links.select("id", "need"), "id").select("id", F.expr("left(text, int(need))").alias("lead"))
    given = lead.join(links.select(F.col("next").alias("id"), F.col("id").alias("of")), "id").select(F.col("of").alias("id"), "lead", F.col("id").alias("next"))
    both = d.join(given, "id").withColumn("n", F.char_length("text").cast("long"))
    edited = F.concat(F.expr("left(text, int(n - floor(n / 4)))"), F.col("lead"))
    forms = both.select("id", "next", "n", F.col("text").alias("own"), edited.alias("edited"))
    own, other = canonical(F.col("own")), canonical(F.col("edited"))
    hashed = forms.select("id", "next", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), own.alias("f"), other.alias("g"))
    small = hashed.select("id", "next", "n", "edited_sha256", F.xxhash64("f").alias("f1"), F.xxhash64(F.lit("wide"), "f").alias("f2"), F.xxhash64("g").alias("g1"), F.xxhash64(F.lit("wide"), "g").alias("g2"))
    small = materialize(small, "fingerprints-edited")

    # byte comparison inside equal buckets, over own and edited forms together
    keys = small.select("id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("f1").alias("h1"), F.col("f2").alias("h2")), F.struct(F.lit(1).alias("kind"), F.col("g1").alias("h1"), F.col("g2").alias("h2")))).alias("k")).select("id", "k.*")
    twice = materialize(_repeated(keys), "fingerprints-repeated")
    own_forms = d.join(twice.where("kind = 0").select("id"), "id", "left_semi").select(canonical(F.col("text")).alias("form"))
    again = links.join(twice.where("kind = 1").select("id"), "id", "left_semi")
    start = again.select("id", "next").join(d.select(F.col("id").alias("next"), F.col("text").alias("next_text")), "next")
    edited_again = d.join(start, "id").withColumn("n", F.char_length("text")).select(F.concat(F.expr("left(text, int(n - floor(n / 4)))"), F.expr("left(next_text, int(floor(n / 4)))")).alias("text"))
    forms = own_forms.union(edited_again.select(canonical(F.col("text")).alias("form"))).select(*_hashes(F.col("form")), "form")
    odd = _collisions(forms)
    numbers = materialize(odd.select("h1", "h2", "form", "number"), "fingerprints-collisions")
    if not numbers.isEmpty():
        return _numbered(hashed, numbers)
    f, g = _printed("f1", "f2"), _printed("g1", "g2")
    prints = small.select("id", F.col("n").alias("n_chars"), "next", "edited_sha256", f.alias("fingerprint"), g.alias("edited_fingerprint"))
    return _with_next(prints)


def _numbered(hashed: DataFrame, numbers: DataFrame) -> DataFrame:
    """The report where some bucket holds different forms."""
    for form in ("f", "g"):
        side = numbers.select(F.col("form").alias(form), F.col("number").alias(f"{form}_number"))
        hashed = hashed.join(side, form, "left")
    def printed(form: str) -> Column:
        both = F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(form), F.xxhash64(F.lit("wide"), form))])
        return F.when(F.col(f"{form}_number") > 1, F.concat(both, F.lit("-"), F.col(f"{form}_number").cast("string"))).otherwise(both)
    return _with_next(hashed.select("id", F.col("n").alias("n_chars"), "next", "edited_sha256", printed("f").alias("fingerprint"), printed("g").alias("edited_fingerprint")))


def _with_next(prints: DataFrame) -> DataFrame:
    other = prints.select(F.col("id").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    return prints.join(other, "next").select(
        outer_id("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
