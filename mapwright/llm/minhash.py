"""Near duplicates by MinHash with odd sketches.

Each distinct shingle set gets MinHash samples. Bands of samples deal sets into buckets; the samples folded into a
parity bitmap (an odd sketch) give the likeness of a pair from the population count of an XOR. Pairs of a bucket
whose sketches are too far apart are dropped, and those left are confirmed on the full sets.

Copies meet as one set first. A bucket is not paired up: everyone is compared with one member, the set with the most
copies, then with the least id, and those linked become one component. What is left of a bucket that still holds several
components is compared in blocks of bounded size, by longer sketches, and a block gives only those pairs of different
components that the sketches do not rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.storage import materialize

from .graph import components
from .words import NULL_ID, Block, WordHashes, blocks, fresh, inner_id, keyed_texts, mapped, mixed, outer_id, space_words, text_print, windows, without

SHINGLE = 5
PERCENT = 75
#: 36 bands of 4: a pair at 0.75 meets in no band with a chance of about 1e-6.
BANDS, ROWS = 36, 4
SKETCH_WORDS = 8
#: Samples and 64-bit words of the longer sketches, and the members of a block.
LONG_SAMPLES, LONG_WORDS, BLOCK = 1536, 96, 1500
#: How many standard deviations from what the threshold gives a sketch may lie. The deviations of pairs at the threshold
#: are normal (of 20,000 the largest was 3.7), so that one is ruled out with a chance of about 3e-7.
SLACK = 5
BROADCAST_IDS = 1_000_000
#: A bucket's members are joined with its row in so many parts.
SALTS = 32

SIGNATURE = "id long, n long, set_a long, set_b long, bands array<long>, odd array<long>"


def _sets(rows: dict, cache: WordHashes, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text; of a text under ``size`` words, its whole sequence as one."""
    b = Block(rows["id"], rows["text"], [space_words(t, lower=True) for t in rows["text"]], cache)
    shingles, out = windows(b.hashes, size), []
    for lo, n in zip(b.starts.tolist(), b.counts.tolist(), strict=True):
        out.append(np.unique(shingles[lo : lo + n - size + 1]) if n >= size else np.unique(windows(b.hashes[lo : lo + n], n)) ^ np.uint64(n) if n else b.hashes[:0])
    return out


def _hash_functions(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    flips = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
    return flips, rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(sets: list[np.ndarray], flips: np.ndarray, times: np.ndarray) -> np.ndarray:
    """By set (none empty) and hash function, the least hash; in pieces that stay in the processor's cache."""
    least, at = np.empty((len(sets), len(flips)), dtype=np.uint64), 0
    while at < len(sets):
        upto, total = at, 0
        while upto < len(sets) and (upto == at or total + len(sets[upto]) < 1 << 15):
            total += len(sets[upto])
            upto += 1
        flat = np.concatenate(sets[at:upto])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:upto]])[:-1]])
        for j in range(len(flips)):
            least[at:upto, j] = np.minimum.reduceat((flat ^ flips[j]) * times[j], starts)
        at = upto
    return least


def _odd_bits(least: np.ndarray, flips: np.ndarray, words: int) -> np.ndarray:
    """The samples folded into parity bitmaps of so many 64-bit words."""
    bits = words * 64
    spots = (mixed(least ^ flips[None, :]) % np.uint64(bits)).astype(np.int32)
    odd = np.empty((len(least), words), dtype=np.int64)
    for k, own in enumerate(spots):
        odd[k] = np.packbits((np.bincount(own, minlength=bits) & 1).astype(np.uint8)).view(np.int64)
    return odd


def _signatures(size: int, bands: int, per_band: int, seed: int = 7):
    flips, times = _hash_functions(bands * per_band, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in blocks(batches):
            sets = _sets(rows, cache, size)
            full = [k for k, s in enumerate(sets) if len(s)]
            least = _least([sets[k] for k in full], flips, times)
            keys = np.zeros((len(full), bands), dtype=np.uint64)
            for j in range(per_band):
                keys = mixed(keys * np.uint64(31) + least[:, j::per_band][:, :bands])
            keys, odd = mixed(keys ^ np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64), _odd_bits(least, flips, SKETCH_WORDS)
            there = np.zeros(len(sets) + 1, dtype=np.int32)
            there[1:][full] = 1
            ends = np.cumsum(there, dtype=np.int32)
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            signed = np.array([[d >> 64, d & 0xFFFFFFFFFFFFFFFF] for d in digests], dtype=np.uint64).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(ends * v.shape[1]), pa.array(v.ravel())) for v in (keys, odd)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed[:, 0]), pa.array(signed[:, 1]), *lists], names=["id", "n", "set_a", "set_b", "bands", "odd"])

    return run


def _shingle_rows(size: int):
    """(id, shingles) by text: its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in blocks(batches):
            sets = _sets(rows, cache, size)
            ends = np.cumsum([0, *(len(s) for s in sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "shingles"])

    return run


def _most_bits(bits: int, percent: int, samples: int) -> float:
    """Bits that the XOR of two odd sketches may have if the sets can have the likeness asked for.

    Samples that differ leave two odd ones each, binomially many; those that meet in a bit cancel, about Poisson many.
    """
    j = percent / 100
    odd, stay = 2 * samples * (1 - j), 1 - 2 / bits
    mean = bits * (1 - stay**odd) / 2
    drawn = 2 * (samples * j * (1 - j)) ** 0.5 * stay**odd
    met = 2 * (odd * odd / (2 * bits)) ** 0.5
    return mean + SLACK * (drawn**2 + met**2) ** 0.5


def _close(a: str, b: str, percent: int, samples: int) -> Column:
    """Whether two odd sketches, and the sizes of the sets, leave a chance of the likeness asked for."""
    most = _most_bits(SKETCH_WORDS * 64, percent, samples)
    count = sum((F.bit_count(F.col(f"{a}_odd")[k].bitwiseXOR(F.col(f"{b}_odd")[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    sizes = (100 * F.col(f"{a}_n") >= percent * F.col(f"{b}_n")) & (100 * F.col(f"{b}_n") >= percent * F.col(f"{a}_n"))
    return sizes & (count <= most)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: its set's size, the component it lies in, and whether it is the one that stays.

    Returns ``doc_id, n_shingles, component_id, kept``. Documents are linked whose sets of distinct shingles have
    ``100 * intersection >= percent * union``; a component's id is the least ``doc_id`` in it.

    Words are runs of characters other than U+0020 and U+0009 to U+000D, after A-Z became a-z. A text under
    ``shingle`` words has its whole sequence as its one shingle; a null or empty text has none, is linked with nothing
    and stays. Rows that share a ``doc_id`` are one document with one result row; the least of their texts counts.
    A null ``doc_id`` counts as less than any other. A text of any length is read whole, in the memory of one block, and
    its distinct shingles are one value of a column. An empty table gives no row. Other columns are not looked at.
    """
    d = docs.select(inner_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not d.groupBy("id").count().where("count > 1").isEmpty():
        d = d.groupBy("id").agg(F.min("text").alias("text"))
    sig = materialize(mapped(d, _signatures(shingle, bands, rows), SIGNATURE), "minhash-signatures")
    full, key = sig.where("n > 0"), ["set_a", "set_b", "n"]
    reps = materialize(full.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "minhash-sets")
    copies = full.select("id", *key).join(reps.select(F.col("id").alias("a"), *key), key).where("a <> id").select("a", F.col("id").alias("b"))
    links = materialize(copies.union(_links(d, reps, shingle, percent, bands * rows)), "minhash-links")
    comp = components(links)
    out = sig.select("id", "n").join(comp, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return out.select(outer_id("id").alias("doc_id"), F.col("n").alias("n_shingles"), outer_id("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _links(d: DataFrame, reps: DataFrame, shingle: int, percent: int, samples: int) -> DataFrame:
    """Links between different sets: all that join components, found bucket by bucket."""
    buckets = reps.select("id", "copies", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p <> q")
    met = materialize(buckets.join(shared.select("bucket"), "bucket").distinct(), "minhash-buckets")
    ids = materialize(met.select("id").distinct(), "minhash-met")
    look, sets = _only(reps, ids).select("id", "n", "odd"), materialize(mapped(_only(d, ids), _shingle_rows(shingle), "id long, shingles array<long>"), "minhash-shingles")
    found, comp = None, None
    for pivot in (F.max_by("id", F.struct("copies", -F.col("id"))), F.min("id")):
        pairs = _pairs(met, comp, pivot).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = pairs.join(_side(look, "a"), "a").join(_side(look, "b"), "b").where(_close("a", "b", percent, samples)).select("a", "b")
        new = materialize(_confirmed(near, sets, percent), "minhash-pairs")
        found = new if found is None else found.union(new)
        comp = components(found)
        if _mixed(met, comp).isEmpty():
            return found
    near = materialize(_block_pairs(sets, reps, met, comp, shingle, percent), "minhash-left")
    return found.union(materialize(_confirmed(near, sets, percent), "minhash-pairs"))


def _with_component(met: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return met.withColumn("component", F.col("id"))
    return met.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed(met: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Buckets whose members lie in more than one component."""
    return _with_component(met, comp).groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("bucket")


def _pairs(met: DataFrame, comp: DataFrame | None, pivot: Column) -> DataFrame:
    """The pivot of each bucket with its members in other components."""
    now = _with_component(met, comp)
    if comp is not None:
        now = now.join(_mixed(met, comp), "bucket", "left_semi")
    chosen = now.groupBy("bucket").agg(pivot.alias("a"))
    of = chosen if comp is None else chosen.join(comp.select(F.col("id").alias("a"), F.col("component").alias("component_a")), "a", "left")
    component_a = F.col("a") if comp is None else F.coalesce("component_a", "a")
    return now.withColumnRenamed("id", "b").join(of, "bucket").where(F.col("component") != component_a).select("a", "b")


def _long_sketches(seed: int = 11):
    flips, times = _hash_functions(LONG_SAMPLES, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):
                own = [np.asarray(x).view(np.uint64) for x in sets.slice(at, 256).to_numpy(zero_copy_only=False)]
                odd = _odd_bits(_least(own, flips, times), flips, LONG_WORDS)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array([x.tobytes() for x in odd], pa.binary())], names=["id", "sketch"])

    return run


def _alike(percent: int):
    """Of two blocks of a bucket, the pairs in different components that the long sketches do not rule out.

    A pair that meets in several buckets is given by the first of them only.
    """
    most = _most_bits(LONG_WORDS * 64, percent, LONG_SAMPLES)

    def run(table: pa.Table) -> pa.Table:
        ids, comp, n, block = (table.column(c).to_numpy() for c in ("id", "component", "n", "block"))
        bucket = table.column("bucket")[0].as_py()
        bands = np.array(table.column("bands").to_pylist(), dtype=np.int64)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(ids), LONG_WORDS)
        lo, hi = block.min(), block.max()
        left, right, out = np.flatnonzero(block == lo), np.flatnonzero(block == hi), []
        for i in left.tolist():
            other = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (lo != hi)) & (100 * n[right] >= percent * n[i]) & (100 * n[i] >= percent * n[right])]
            other = other[np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1) <= most]
            if len(other):
                first = np.argmax(bands[other] == bands[i], axis=1)
                out += [(min(ids[i], x), max(ids[i], x)) for x in ids[other[bands[i][first] == bucket]].tolist()]
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _block_pairs(sets: DataFrame, reps: DataFrame, met: DataFrame, comp: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components left in buckets, from blocks of bounded size."""
    now = materialize(_with_component(met, comp).join(_mixed(met, comp), "bucket", "left_semi").select("bucket", "id", "component"), "minhash-open")
    ids = materialize(now.select("id").distinct(), "minhash-open-ids")
    sketches = materialize(mapped(_only(sets, ids), _long_sketches(), "id long, sketch binary"), "minhash-long")
    counts = now.groupBy("bucket").agg(F.expr(f"int(ceil(count(*) / {BLOCK}.0))").alias("parts"))
    # a hot bucket's members are dealt to many tasks, each with its own copy of the bucket's one row
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = now.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(counts, ["bucket", "salt"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a block goes to its meetings with every block of the bucket, itself included
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", "id", "component", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    full = rows.join(_only(reps, ids).select("id", "n", "bands"), "id").join(sketches, "id")
    return full.groupBy("bucket", "low", "high").applyInArrow(_alike(percent), "a long, b long").distinct()


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "id"])


def _confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    full = near.join(_side(sets, "b"), "b").join(_side(sets, "a"), "a")
    both, total = F.size(F.array_intersect("a_shingles", "b_shingles")).cast("long"), (F.size("a_shingles") + F.size("b_shingles")).cast("long")
    return full.where(100 * both >= percent * (total - both)).select("a", "b")


def _only(d: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``d`` whose id is in ``ids``, without moving the other texts while there are few ids."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return d.join(F.broadcast(ids), "id", "left_semi")
    return d.join(ids, "id", "left_semi")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns as they are.

    Rows that share an id, or have none, are documents of their own if their texts differ; of a component the row with
    the least id stays, then with the least digest of its text. Of rows equal in id and text one stays.
    """
    if docs.select(inner_id(id_col).alias("id")).groupBy("id").count().where("count > 1").isEmpty():
        gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("not kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(f"{fresh(docs)}gone"))
        gone = materialize(gone, "minhash-gone")
        return docs.join(_small(gone), inner_id(id_col) == F.col(gone.columns[0]), "left_anti")
    rows = keyed_texts(docs, id_col, text_col, "minhash-rows")
    comp = near_duplicates(rows, id_col="key", **options).select(F.col("doc_id").alias("key"), "component_id")
    placed = materialize(rows.select("key", "own", "print").join(comp, "key"), "minhash-placed")
    stays = placed.groupBy("component_id").agg(F.min(F.struct("own", "print")).alias("first")).select("first.*")
    gone = materialize(placed.select("own", "print").join(stays, ["own", "print"], "left_anti"), "minhash-gone")
    left = without(docs, _small(gone), id_col, text_col)
    key = [inner_id(id_col).alias(f"{fresh(docs)}own"), text_print(text_col).alias(f"{fresh(docs)}print")]
    if left.groupBy(*key).count().where("count > 1").isEmpty():
        return left
    # partial sums of equal rows meet, not the rows themselves
    plain = [c for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    one = left.groupBy(*key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(f"{fresh(docs)}row"))
    return one.select(f"{fresh(docs)}row.*")


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
