"""Near duplicates by one-permutation hashing with optimal densification.

A document's set is its distinct 5-word shingles (ASCII letters in lower case); fewer words are one shingle together; no
words, or null, are the empty set, which is linked with nothing. One permutation spreads a set over bins and keeps the
least hash of each; an empty bin takes the value of the first filled bin in an order of its own, the same for every set.
Bands of bins are buckets. A bucket proposes a star, each member with the bucket's least document, so that pairs grow with
the members. Every proposed pair is confirmed on the full sets. Members that a star leaves in another component than
others of their bucket get further stars, and in the end whatever is still apart in a bucket is compared block by block,
without a row for a pair, so a bucket loses no link. Equal sets are one node from the start.

A row is judged by its own text. Texts that one doc_id comes with are each compared, and where that doc_id is the least of
their sets they are one node. A row with a null doc_id is never a class's first: it is kept only if no other row has its
set. An empty table gives no rows. Only ``doc_id`` and ``text`` are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import words as W
from .shared import Scope

SHINGLE = 5
SIMILAR_PERCENT = 75
BANDS, BAND_BINS = 36, 4
BINS = BANDS * BAND_BINS
#: Rounds of stars before what is left apart in a bucket is compared in full.
STARS = 3
#: Bytes of sets that a task holds at once in that comparison.
BLOCK_BYTES = 4 << 20

#: For each bin, the order in which it looks for a filled one.
_LOOKS = np.argsort(W.mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(12345)).reshape(BINS, BINS), axis=1)
_BAND_SEEDS = W.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(777))


def shingle_sets(text: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its shingles."""
    words = W.Words(W.LOWER[text], at)
    hashes = words.hashes()
    runs = W.rolled(hashes, width)
    out = []
    for first, n in zip(words.first[:-1].tolist(), words.counts.tolist()):
        if n >= width:
            out.append(np.unique(runs[first : first + n - width + 1]))
        elif n:
            out.append(W.mix(W.rolled(hashes[first : first + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The bins of a sorted, non-empty set."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    at = bins[first].astype(np.int64)
    out[at], filled[at] = hashes[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        looks = _LOOKS[empty]
        out[empty] = out[looks[np.arange(len(empty)), np.argmax(filled[looks], axis=1)]]
    return out


def band_keys(bins: np.ndarray) -> np.ndarray:
    grouped, keys = bins.reshape(BANDS, BAND_BINS), _BAND_SEEDS.copy()
    for k in range(BAND_BINS):
        keys = W.mix(keys * np.uint64(0xA0761D6478BD642F) + grouped[:, k])
    return keys.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches):
    for batch in batches:
        for rows, text, at in W.slices(batch):
            sets = shingle_sets(text, at)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            bands = [band_keys(signature(s)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNED)


_SETS = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("hashes", pa.binary())])


def _full_sets(batches):
    for batch in batches:
        for rows, text, at in W.slices(batch):
            sets = [s.tobytes() for s in shingle_sets(text, at)]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], schema=_SETS)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm(batches):
    for batch in batches:
        a, b, one, other = (batch.column(k) for k in range(4))
        good = []
        for x, y in zip(one, other):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            # both are sorted and without repeats
            joint = np.concatenate([x, y])
            joint.sort(kind="stable")
            common = int((joint[1:] == joint[:-1]).sum())
            good.append(100 * common >= SIMILAR_PERCENT * (len(joint) - common))
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], schema=_LINKS)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets. Sizes alone rule some out before sets are moved."""
    size = sets.select("doc_id", (F.length("hashes") / 8).alias("n"))
    fits = (
        pairs.join(size.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a")
        .join(size.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
        .where(100 * F.least("na", "nb") >= SIMILAR_PERCENT * F.greatest("na", "nb"))
    )
    full = fits.select("a", "b").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("other")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("one")), "a")
    return full.select("a", "b", "one", "other").mapInArrow(_confirm, "a long, b long")


class _Block:
    """Some members of a bucket, which others are compared with."""

    def __init__(self):
        self.ids, self.labels, self.sets, self.hashes = [], [], [], None

    def add(self, doc_id: int, label: int, hashes: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.labels.append(label)
        self.sets.append(hashes)

    def links(self, doc_id: int, label: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """A link to each other component that has one here; further links would join nothing more."""
        if self.hashes is None:
            sizes = np.array([len(s) for s in self.sets])
            joint = np.concatenate(self.sets)
            order = np.argsort(joint, kind="stable")
            self.hashes, self.owners, self.sizes = joint[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
            self.labels = np.array(self.labels)
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = high - low
        met = self.owners[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        common = np.bincount(met, minlength=len(self.sizes))
        good = np.flatnonzero((100 * common >= SIMILAR_PERCENT * (self.sizes + len(hashes) - common)) & (self.labels != label))
        return [(doc_id, self.ids[k]) for k in good[np.unique(self.labels[good], return_index=True)[1]]]


def _compare(batches):
    at, block = None, _Block()
    for batch in batches:
        found = []
        for key, part, far, doc_id, label, hashes in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if (key, part) != at:
                at, block = (key, part), _Block()
            hashes = np.frombuffer(hashes, np.uint64)
            if far:
                found += block.links(doc_id, label, hashes) if block.ids else []
            else:
                block.add(doc_id, label, hashes)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], schema=_LINKS)


def _compared(apart: DataFrame, sets: DataFrame, scope: Scope) -> DataFrame:
    """The links between components in each bucket, however many members it has, without a row for each pair.

    A bucket's members are dealt to blocks of bounded size; those outside the bucket's largest component go by every
    block, one after another."""
    main = apart.groupBy("key", "label").count().groupBy("key").agg(F.expr("max_by(label, struct(count, -label))").alias("main"))
    rows = apart.drop("main").join(main, "key").join(sets, "doc_id")
    blocks = apart.join(sets.select("doc_id", F.length("hashes").alias("bytes")), "doc_id").groupBy("key").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    rows = scope.store(rows.join(blocks, "key"), "compared")
    one = rows.select("key", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("part"), F.lit(False).alias("far"), "doc_id", "label", "hashes")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    far = rows.where("label <> main").select("key", every.alias("part"), F.lit(True).alias("far"), "doc_id", "label", "hashes")
    dealt = one.unionByName(far).repartition("key", "part").sortWithinPartitions("key", "part", "far")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    with Scope(docs.sparkSession) as scope:
        return scope.result(_components_of(docs, scope), "near-duplicates")


def _components_of(docs: DataFrame, scope: Scope) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scope.store(texts.mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signed")
    nodes = scope.store(signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node")), "nodes")
    member = signed.join(nodes.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    rows = member.select("doc_id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub < top").select("key", "hub")
    buckets = scope.store(rows.join(shared, "key").distinct(), "buckets")
    wanted = scope.store(buckets.select("doc_id").distinct(), "wanted")
    # a doc_id that comes with several texts has a set for each
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, set_key binary, hashes binary")
    sets = scope.store(sets.dropDuplicates(["doc_id", "set_key"]).select("doc_id", "hashes"), "sets")

    pairs = buckets.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    links, labels = None, None
    for star in range(STARS + 1):
        found = scope.store(_confirmed(pairs, sets) if star < STARS else _compared(apart, sets, scope), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links, scope=scope)
        if star == STARS:
            break
        apart = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
        # buckets whose members are in one component have nothing left to tell
        split = apart.groupBy("key").agg(F.min("label").alias("main"), F.max("label").alias("last")).where("main < last").select("key", "main")
        apart = scope.store(apart.join(split, "key"), "apart")
        if apart.limit(1).count() == 0:
            break
        hubs = apart.where("label <> main").groupBy("key").agg(F.expr(f"min_by(struct(doc_id, label), xxhash64(doc_id, {star}))").alias("hub"))
        pairs = apart.join(hubs, "key").where("label <> hub.label").select(F.greatest("doc_id", "hub.doc_id").alias("a"), F.least("doc_id", "hub.doc_id").alias("b")).distinct()
    classes = nodes.join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    first = F.when(F.col("component").isNull(), True).otherwise(F.coalesce(F.col("component") == F.col("doc_id"), F.lit(False)))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), first.alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their group, with all their columns. A doc_id is kept with all its rows, null
    like any other; an empty table stays empty."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
