"""MinHash near-dedup (3): an LSH forest over sorted signature orders, confirmed on full shingle sets.

Texts of equal shingle sets are one class, so groups of copies of any size are one row from there on. Each of
``TREES`` orders sorts the classes by its own ``DEPTH`` MinHash values (one range shuffle for all orders);
a class's neighbours in the sorted order are those with the longest common prefixes, so the depth at
which it is compared follows the density of its region: sparse regions go down to ``LEAST`` values, dense ones stop at
the ``REACH`` nearest. Candidates are confirmed on full sets in two rounds: first the nearest neighbours in two
orders, then, from all orders, the pairs that the first round's links don't already join. A region, the classes of equal
``LEAST`` first values in one order, with more members than ``REACH`` covers and not yet one component is then compared
in full, on full sets, in blocks of bounded size: so every pair that shares a region is confirmed or already joined.
The forest itself misses a pair at the threshold once in 2,000 (no common region in ``TREES`` orders).

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; the set holds the distinct 5-word shingles, for fewer words the whole
sequence; null, empty and blank texts have an empty set and no link. Rows of equal doc_id are told apart by their
sets; a null doc_id never names a group that has another; repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, lean, partitions, small
from .words import U, binaries, hashes, mix, seeded, slices, split, windows

TREES, DEPTH, LEAST, REACH = 14, 8, 3, 3
SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
ROUGH = 0.5
#: Members and shingles of a block of a large region.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
_SIDES = seeded(2, 5)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, end to end, and how many it has."""
    w = split(texts)
    h = hashes(w, lower=True)
    whole = windows(h, SHINGLE)
    parts = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= SHINGLE:
            parts.append(np.unique(whole[a : b - SHINGLE + 1]))
        else:
            parts.append(windows(np.append(h[a:b], U(b - a)), b - a + 1) if b > a else h[:0])
    return np.concatenate([h[:0], *parts]), np.array([len(x) for x in parts], np.int64)


def signed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, a and b (128 bits of the set's hash), sig (big-endian uint32 MinHash values)."""
    multipliers = seeded(TREES * DEPTH, 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, counts = shingle_sets(batch["text"])
            full = np.flatnonzero(counts)
            at = (np.cumsum(counts) - counts)[full]
            sig = np.zeros((len(counts), TREES * DEPTH), ">u4")
            a, b = np.zeros(len(counts), U), np.zeros(len(counts), U)
            if len(full):
                for i, m in enumerate(multipliers):
                    sig[full, i] = np.minimum.reduceat(flat * m, at) >> U(32)
                a[full] = np.add.reduceat(mix(flat * _SIDES[0]), at)
                b[full] = np.add.reduceat(mix(flat * _SIDES[1]), at)
            arrays = [batch["doc_id"], batch["row"], pa.array(counts), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), binaries(sig.reshape(-1).view("<u4"), np.full(len(counts), TREES * DEPTH))]
            yield pa.record_batch(arrays, names=["doc_id", "row", "n_shingles", "a", "b", "sig"])

    rows = lean(docs).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, n_shingles long, a long, b long, sig binary")


class _Sweep:
    """Pairs each row with the ``REACH`` rows before it that share ``LEAST`` values at least; keeps ``REACH`` rows between batches."""

    def __init__(self):
        self.held = None

    def __call__(self, tree: np.ndarray, keys: np.ndarray, *ids: np.ndarray) -> Iterator[tuple]:
        columns = (tree, keys, *ids)
        old = 0 if self.held is None else len(self.held[0])
        if old:
            columns = tuple(np.concatenate([x, y]) for x, y in zip(self.held, columns))
        tree, keys, ids = columns[0], columns[1], columns[2:]
        for step in range(1, REACH + 1):
            if len(tree) > step:
                common = np.cumprod(keys[step:] == keys[:-step], axis=1).sum(1)
                hit = np.flatnonzero((tree[step:] == tree[:-step]) & (common >= LEAST))
                hit = hit[hit + step >= old]
                yield (step, tree[hit], [x[hit] for x in ids], [x[hit + step] for x in ids])
        self.held = tuple(x[-REACH:] for x in columns)


_PAIR = "u long, v long, near boolean, part int, place long, tree int, key binary, id long"


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(batch["key"].to_pylist()), ">u4").reshape(-1, DEPTH)
    return batch["tree"].to_numpy(), keys, batch["id"].to_numpy()


def _pairs(step: int, tree: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    n = len(left)
    near = pa.array((tree < 2) & (step == 1))
    return pa.record_batch([pa.array(left), pa.array(right), near, *(pa.nulls(n, k) for k in (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))], names=[x.split()[0] for x in _PAIR.split(", ")])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs inside one partition, and its first and last rows for the seams."""
    from pyspark import TaskContext

    part, sweep, place, ends = TaskContext.get().partitionId(), _Sweep(), 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        for step, tree, (left,), (right,) in sweep(*_numbers(batch)):
            yield _pairs(step, tree, left, right)
        spots = np.arange(place, place + batch.num_rows)
        ends += [(p, batch.slice(p - place, 1)) for p in spots[:REACH].tolist() + spots[-REACH:].tolist()]
        ends = list({p: (p, x) for p, x in ends if p < REACH or p >= place + batch.num_rows - REACH}.values())
        place += batch.num_rows
    if ends:
        rows = pa.Table.from_batches([x for _, x in ends]).combine_chunks()
        n = len(ends)
        nothing = [pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.bool_())]
        arrays = [*nothing, pa.array([part] * n, pa.int32()), pa.array([p for p, _ in ends], pa.int64()), *(rows[c].combine_chunks() for c in ("tree", "key", "id"))]
        yield pa.record_batch(arrays, names=[x.split()[0] for x in _PAIR.split(", ")])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across partitions, from their first and last rows in order."""
    sweep = _Sweep()
    for batch in batches:
        for step, tree, (left, p), (right, q) in sweep(*_numbers(batch), batch["part"].to_numpy()):
            across = p != q
            yield _pairs(step, tree[across], left[across], right[across])


def candidates(classes: DataFrame) -> DataFrame:
    """u, v (ids of classes), near: from the forest over id, sig."""
    keys = F.array(*[F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH) for t in range(TREES)])
    trees = classes.select("id", F.posexplode(keys).alias("tree", "key"))
    order = ["tree", "key", "id"]
    swept = cut(trees.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_within, _PAIR))
    # The few rows at the partitions' ends are dealt to one task after the filter, not the scan before it.
    seams = swept.filter("part is not null").repartition(1).sortWithinPartitions("part", "place").mapInArrow(_seams, _PAIR)
    pairs = swept.filter("part is null").unionByName(seams)
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "near").groupBy("u", "v").agg(F.max("near").alias("near"))


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in ``ROUGH`` of the values; a pair at the threshold misses that once in 10**8."""
    met = pairs.join(classes.select(F.col("id").alias("u"), F.col("sig").alias("x")), "u").join(classes.select(F.col("id").alias("v"), F.col("sig").alias("y")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(-1, TREES * DEPTH) for c in ("x", "y"))
            yield batch.select(["u", "v"]).filter(pa.array((x == y).mean(1) >= ROUGH))

    return met.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 75 * union on full sets."""
    met = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("y")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) * DENOMINATOR >= NUMERATOR * max(len(x), len(y)) else 0
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return met.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """id, shingles of the classes in ``wanted`` (id, first): their first documents' full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, counts = shingle_sets(batch["text"])
            full = np.flatnonzero(counts)
            a = np.zeros(len(counts), U)
            if len(full):
                a[full] = np.add.reduceat(mix(flat * _SIDES[0]), (np.cumsum(counts) - counts)[full])
            yield pa.record_batch([pa.array(a.view(np.int64)), binaries(flat, counts)], names=["id", "shingles"])

    rows = lean(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    firsts = small(cut(wanted.select("first").distinct()))
    found = rows.join(firsts, rows.doc_id.eqNullSafe(firsts["first"]), "left_semi").mapInArrow(run, "id long, shingles binary")
    return cut(found.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]))


def _forest(ids: np.ndarray, block: np.ndarray, label: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Links (two ids) that join all labels with a pair of sets within the threshold: all pairs of two blocks, or of one.

    Sets with the most common shingles come first, and pairs of one label are left out, so that an original joins its variants at once.
    """
    _, shingle, often = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(ids)), counts)
    holders = owner[np.argsort(shingle, kind="stable")]
    begin = np.cumsum(often) - often
    at = np.cumsum(counts) - counts
    common = np.add.reduceat(often[shingle], at) / counts
    apart = block[0] != block[-1] or (block != block[0]).any()
    out = []
    for p in np.argsort(-common, kind="stable").tolist():
        open_ = (label != label[p]) & (np.minimum(counts, counts[p]) * DENOMINATOR >= NUMERATOR * np.maximum(counts, counts[p]))
        if apart:
            open_ &= block != block[p]
        if not open_.any():
            if (label == label[0]).all():
                break
            continue
        own = shingle[at[p] : at[p] + counts[p]]
        own = own[often[own] > 1]
        n = often[own]
        places = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holders[places], minlength=len(ids))
        hit = np.flatnonzero(open_ & (DENOMINATOR * both >= NUMERATOR * (counts + counts[p] - both)))
        if len(hit):
            met, first = np.unique(label[hit], return_index=True)
            out += [(ids[p], ids[q]) for q in hit[first].tolist()]
            label[np.isin(label, met)] = label[p]
    return out


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by (region, i, j); one such group at a time is held."""
    held: list[pa.RecordBatch] = []

    def links() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), U) for x in table["shingles"]]
        ids, block, label = (table[c].to_numpy() for c in ("id", "block", "label"))
        found = _forest(ids, block, label.copy(), np.concatenate(sets), np.array([len(x) for x in sets]))
        if found:
            u, v = zip(*found)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy() for c in ("region", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield from links()
                held.clear()
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield from links()


def crowded(classes: DataFrame, sets: DataFrame, label: DataFrame) -> DataFrame:
    """u, v: links inside regions that hold more than ``REACH`` covers and several groups; label (id, group): the groups so far.

    Members of a region's most frequent group need no comparison with each other: only blocks of the others are dealt with all blocks.
    """
    starts = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 4 * DEPTH * t + 1, 4 * LEAST)) for t in range(TREES)])
    known = classes.join(label, "id", "left").select("id", "sig", F.coalesce("group", "id").alias("label"))
    members = cut(known.join(sets.select("id", (F.octet_length("shingles") / 8).cast("long").alias("size")), "id").select("id", "label", "size", F.explode(starts).alias("region")))
    per = members.groupBy("region", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    regions = per.groupBy("region").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "label", "s")).alias("most"), F.count("*").alias("labels"))
    regions = regions.filter((F.col("labels") > 1) & (F.col("n") > REACH + 1))
    regions = cut(regions.select("region", F.col("most.label").alias("main"), blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("few"), blocks(F.col("most.n"), F.col("most.s")).alias("many")))
    spot = F.pmod(F.xxhash64("id"), F.when(F.col("label") == F.col("main"), F.col("many")).otherwise(F.col("few"))).cast("int")
    placed = members.join(small(regions), "region").withColumn("cell", F.when(F.col("label") == F.col("main"), F.col("few") + spot).otherwise(spot))
    # A block of others (i) meets itself and every later block (j); a region of few members is one group.
    one = (F.col("few") == 1) & (F.col("many") == 1)
    every = F.transform(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1), lambda k: F.struct(F.least(k, "cell").alias("i"), F.greatest(k, "cell").alias("j")))
    dealt = F.when(one, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.filter(every, lambda x: x["i"] < F.col("few")))
    rows = cut(placed.select("region", "id", "label", F.when(one, 0).otherwise(F.col("cell")).alias("block"), F.explode(dealt).alias("x")).select("region", "x.i", "x.j", "id", "label", "block"))
    key = ["region", "i", "j"]
    return rows.join(sets, "id").select(*key, "id", "label", "block", "shingles").repartition(partitions(classes.sparkSession), *key).sortWithinPartitions(*key).mapInArrow(_in_blocks, "u long, v long").distinct()


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return clustered(docs, text, key).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def survivors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one of each group stays: that with the least doc_id (null last), then the least hash of its text.

    Rows are told apart by doc_id and text, so rows of one id are decided on each; of equal ones, one stays. Rows without words all stay.
    """
    each = cut(clustered(docs, text, key).filter("n_shingles > 0").groupBy("doc_id", "row").agg(F.min("cluster").alias("cluster"), F.count("*").alias("n")))
    best = each.groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row")).alias("best")).select("best.*")
    same = F.col("e.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("e.row") == F.col("b.row"))
    decided = each.alias("e").join(best.alias("b"), same, "left").filter(F.col("b.row").isNull() | (F.col("n") > 1))
    decided = small(cut(decided.select("e.doc_id", "e.row", F.col("b.row").isNotNull().alias("twin"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    mine = F.col("d").getField(key).cast("long").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64(F.col("d").getField(text)) == F.col("x.row"))
    left = rows.join(decided.alias("x"), mine, "left").select("d", "x.doc_id", "x.row", "x.twin")
    return left.filter("twin is null").select("d.*").unionByName(left.filter("twin").dropDuplicates(["doc_id", "row"]).select("d.*"))


def clustered(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, row, n_shingles, component_id, cluster (names the connected group; null without words)."""
    each = cut(signed(docs, text, key))
    full = each.filter("n_shingles > 0")
    firsts = full.groupBy("a", "b").agg(F.min("doc_id").alias("first"))
    classes = cut(full.join(firsts, ["a", "b"]).filter(F.col("doc_id").eqNullSafe(F.col("first"))).dropDuplicates(["a", "b"]).select(F.col("a").alias("id"), "b", "first", "sig"))
    pairs = cut(candidates(classes))
    rough = cut(_likely(pairs.filter("near"), classes))
    sets = _sets(docs, _ends(pairs).join(classes.select("id", "first"), "id"), text, key)
    named = classes.select("id", F.struct("first", "id").alias("node"))
    first_links = cut(_named(_confirmed(rough, sets), named))
    joined = components(first_links)
    label = joined.select(F.col("node.id").alias("id"), F.col("component.id").alias("group"))
    rest = pairs.filter(~F.col("near")).join(label.toDF("u", "g"), "u", "left").join(label.toDF("v", "h"), "v", "left").filter("not (g <=> h) or g is null").select("u", "v")
    more = cut(_named(_confirmed(_likely(rest, classes), sets), named))
    joined = cut(components(joined.toDF("u", "v").unionByName(more)))
    label = joined.select(F.col("node.id").alias("id"), F.col("component.id").alias("group"))
    last = cut(_named(crowded(classes, sets, label), named))
    whole = components(joined.toDF("u", "v").unionByName(last))
    component = classes.join(whole.select(F.col("node.id").alias("id"), F.col("component.first").alias("least"), F.col("component.id").alias("cluster")), "id", "left")
    component = component.select(F.col("id").alias("a"), "b", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"), F.coalesce("cluster", "id").alias("cluster"))
    linked = each.filter("n_shingles > 0").join(component, ["a", "b"]).select("doc_id", "row", "n_shingles", "component_id", "cluster")
    alone = each.filter("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("cluster"))
    return linked.unionByName(alone)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def _named(pairs: DataFrame, named: DataFrame) -> DataFrame:
    return pairs.join(named.toDF("u", "x"), "u").join(named.toDF("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
