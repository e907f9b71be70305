"""MinHash near-dedup as a chosen-path set similarity join.

Documents with the same set of word shingles are one class from the start, so groups of copies never
meet in a task. Class representatives go down independent trees: at a node, a hash of the node
chooses one of the SLOTS minhash values (sometimes two, 1/threshold of them on average) and a document moves to the
child named by its own value there. A similar pair stays together at a slot with a probability of its
similarity, so the expected number of nodes that it shares doesn't fall with depth, while others part. Small nodes
are compared exhaustively; larger ones branch on in several forks, as many as bring a linked pair's chance of never meeting
in TREES trees to at most MISS, even if all its nodes stay large down to the last level.

Members of a large node that are close to one another would never part. Hubs stand for them: members of a sample of the node to which
many of the sample are near. Every member is compared with its node's hubs by estimate and joins the neighbourhoods of those that it's
near. As distances of sets obey the triangle inequality, who is as close to a hub as a linked pair can be linked only with what is at least
2 * threshold - 1 similar to the hub, which lies above the bound of neighbourhoods (by more than a standard deviation, at a hub of each tree); it
goes no further. Who is near a hub otherwise goes on without forks, and only if somebody in the node stands neither near the hub nor too far from it to be
linked. Nodes whose members are all in one neighbourhood end. So a group of near copies costs a row for each member and tree, not one for each path.

Within nodes, minhash estimates (well below the threshold, so that no link is lost to their spread) make
neighbourhoods by connected components. Inside a neighbourhood links are then confirmed on the full sets:
small ones each in one task, by exhaustive comparison that leaves out pairs that already hang together; large ones by
all tasks: for a few rounds all members are compared with a hub, and what isn't linked with the largest component
then is compared with all members, in cells of a bounded number of bytes, where distances to the hubs rule most pairs out. Which links within a component
were confirmed doesn't change the component, so none is lost by leaving pairs out.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing and kept; a text of fewer words than a
shingle is one shingle; rows that repeat a doc_id are one document if their texts agree, and are linked like any others if not; a
null doc_id's row is linked with nothing, kept, with a null component; an empty table gives an empty one; extra columns
are ignored by `groups` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Windows, byte_classes, hash_words, maybe_broadcast, mix, scratch, shared_table, ship, signed, slices, text_bytes
from .components import components

SHINGLE, SLOTS, TREES = 5, 64, 16
#: Levels of a tree; chance of missing a linked pair, at most.
DEPTH, MISS = 6, 1e-6
#: Rows of a task in stages whose rows are counted beforehand; the fewest tasks of these.
TASK_ROWS, TASKS = 50_000, 8
#: Members of a node that is compared exhaustively, and how many of them at once with all; how far below the threshold an estimate may lie, in
#: standard deviations.
NODE, BLOCK, DEVIATIONS = 2048, 256, 5
#: Members of a sample; hubs of a node; share of its sample that is near a hub, at least.
SAMPLE, HUBS, SHARE = 48, 4, 1 / 12
#: Members and shingles of a neighbourhood that one task confirms; hub rounds of larger ones; bytes of sets of each side of a cell.
MEMBERS, SHINGLES, ROUNDS, CELL = 256, 400_000, 3, 4 << 20
_CLASSES = byte_classes("space", lower=True)
_NODES = "node long, doc_id long, near long"
_A = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_B = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another; where each begins (one more at the end)."""
    words, first = hash_words(*text_bytes(column), _CLASSES)
    counts = np.diff(first)
    runs = Windows(words)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(n)])
    start = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], n)
    hashes = runs.of(start, np.minimum(start + size, np.repeat(first[1:], n)))
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begins[:-1][n > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[begins]


def minhashes(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SLOTS minima of 32 bits for each non-empty set."""
    heads = begins[:-1][np.diff(begins) > 0]
    out = np.empty((len(heads), SLOTS), np.uint32)
    for j in range(SLOTS if len(heads) else 0):
        out[:, j] = np.minimum.reduceat((hashes * _A[j] + _B[j]) >> np.uint64(32), heads)
    return out


def _sketch(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            hashes, begins = shingle_sets(batch.column("text"), size)
            n = np.diff(begins)
            full = n > 0
            keys = np.zeros((2, len(n)), np.uint64)
            sig: list[bytes | None] = [None] * len(n)
            if full.any():
                heads = begins[:-1][full]
                keys[0, full] = np.add.reduceat(mix(hashes), heads)
                keys[1, full] = np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0x6A09E667F3BCC909)), heads)
                for i, row in zip(np.flatnonzero(full).tolist(), minhashes(hashes, begins), strict=True):
                    sig[i] = row.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), signed(keys[0]), signed(keys[1]), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SLOTS)


def missed(threshold: float, trees: int, forks: int, depth: int = DEPTH) -> float:
    """Chance that a pair just at the threshold never meets, if all its nodes are large for so many levels.

    The slots that trees choose count as independent draws from the SLOTS values that all share; how many of these agree is binomial.
    """
    twice, total = min(1.0, 1 / threshold - 1), 0.0
    for agree in range(SLOTS + 1):
        s, apart = agree / SLOTS, 0.0
        for level in reversed(range(depth)):
            one = 1 - s + s * apart
            apart = ((1 - twice) * one + twice * one * one) ** (forks if level else 1)
        total += comb(SLOTS, agree) * threshold**agree * (1 - threshold) ** (SLOTS - agree) * apart**trees
    return total


def forks_for(threshold: float, trees: int, depth: int = DEPTH) -> int:
    """The fewest forks of a large node with which a pair at the threshold is missed with a chance of at most MISS."""
    return next((n for n in range(1, 64) if missed(threshold, trees, n, depth) <= MISS), 64)


def _descend(threshold: float, trees: int, depth: int = DEPTH) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Children of (node, doc_id, near, sig) rows; without a node, of the trees' roots. near: the neighbourhood that the document is in already."""
    second = np.uint64(min(1.0, 1 / threshold - 1) * (2**64 - 1025))
    forks = forks_for(threshold, trees, depth)

    def step(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children, and the rows that they come from."""
        slot = (mix(node ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(SLOTS)).astype(np.int64)
        twice = mix(node ^ np.uint64(0xBB67AE8584CAA73B)) < second
        other = (slot + 1 + (mix(node ^ np.uint64(0x510E527FADE682D1)) % np.uint64(SLOTS - 1)).astype(np.int64)) % SLOTS
        rows, chosen = np.concatenate([np.arange(len(node)), np.flatnonzero(twice)]), np.concatenate([slot, other[twice]])
        child = mix(node[rows] + np.uint64(0x9B05688C2B3E6C1F) * (chosen.astype(np.uint64) + np.uint64(1))) ^ mix(sig[rows, chosen].astype(np.uint64) + np.uint64(1))
        return mix(child), rows

    def batch_of(node: np.ndarray, doc: np.ndarray, near: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([signed(node), pa.array(doc, pa.int64()), near], ["node", "doc_id", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, sig = batch.column("doc_id").to_numpy(), _matrix(batch.column("sig"))
            if "node" not in batch.schema.names:
                for t in range(trees):
                    node, row = step(np.full(len(doc), mix(np.full(1, t + 1, np.uint64))[0]), sig)
                    yield batch_of(node, doc[row], pa.nulls(len(row), pa.int64()))
                continue
            above = batch.column("node").to_numpy().view(np.uint64)
            free = np.flatnonzero(batch.column("near").is_null().to_numpy(zero_copy_only=False))
            for j in range(1, forks + 1):
                some = free if j > 1 else np.arange(len(doc))  # who is in a neighbourhood has most of its links there
                node, row = step(mix(above[some] + np.uint64(0xD1B54A32D192ED03 * j % 2**64)), sig[some])
                yield batch_of(node, doc[some[row]], batch.column("near").take(pa.array(some[row])))

    return run


def _near(lowest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spanning links of the members of a node whose estimates reach the lowest similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            sizes = np.diff(batch.column("members").offsets.to_numpy())
            flat = batch.column("members").flatten()
            docs = flat.field(0).to_numpy(zero_copy_only=False)
            sigs = np.frombuffer(b"".join(flat.field(1).to_pylist()), np.uint8).reshape(len(docs), SLOTS)
            at = 0
            for n in sizes.tolist():
                own, sig = docs[at : at + n], sigs[at : at + n]
                at += n
                root = np.arange(n)
                for k in range(0, n, BLOCK):
                    close = (sig[k : k + BLOCK, None] == sig[None, k:]).mean(2) >= lowest
                    for i, row in enumerate(close, k):
                        others = np.flatnonzero(row[i - k + 1 :]) + i + 1
                        others = others[root[others] != root[i]]
                        while len(others):
                            a.append(own[i])
                            b.append(own[others[0]])
                            root[root == root[others[0]]] = root[i]
                            others = others[root[others] != root[i]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, sig) with a byte of each slot, enough for estimates."""
    for batch in batches:
        small = _matrix(batch.column("sig")).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in small], pa.binary())], ["doc_id", "sig"])


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            hashes, begins = shingle_sets(batch.column("text"), size)
            raw = hashes.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("area"), batch.column("doc_id"), pa.array([raw[8 * a : 8 * b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], pa.binary())], ["area", "doc_id", "shingles"])

    return run


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = _common(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact components of whole small neighbourhoods: (id, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roots = [], []
            for row in batch.column("members"):
                members = sorted((m["doc_id"], m["shingles"]) for m in row.as_py())
                sets = [_as_set(raw) for _, raw in members]
                root = np.arange(len(sets))
                for i in range(len(sets)):
                    for j in range(i + 1, len(sets)):
                        if root[i] != root[j] and linked(sets[i], sets[j], percent):
                            lo, hi = sorted((root[i], root[j]))
                            root[root == hi] = lo
                ids += [d for d, _ in members]
                roots += [members[r][0] for r in root.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], ["id", "root"])

    return run


def _node_hubs(lowest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, hubs): of each sample, the members that most others are near, as long as these are many; nodes without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, hubs = [], []
            for node, row in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True):
                members = sorted(row.as_py(), key=lambda m: m["doc_id"])
                sig = np.frombuffer(b"".join([m["sig"] for m in members]), "<u4").reshape(-1, SLOTS).astype(np.uint8)
                close, left, chosen = (sig[:, None] == sig[None]).mean(2) >= lowest, np.ones(len(members), bool), []
                while len(chosen) < HUBS:
                    many = (close & left).sum(1)
                    best = int(many.argmax())
                    if many[best] < max(2, SHARE * len(members)):
                        break
                    left &= ~close[best]
                    m = members[best]
                    chosen.append({"doc_id": m["doc_id"], "near": m["doc_id"] if m["near"] is None else m["near"], "sig": sig[best].tobytes()})
                if chosen:
                    nodes.append(node)
                    hubs.append(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hubs, pa.list_(pa.struct([("doc_id", pa.int64()), ("near", pa.int64()), ("sig", pa.binary())])))], ["node", "hubs"])

    return run


_PLACED = "node long, doc_id long, sig binary, near long, linked array<long>, between boolean, inside boolean"


def _place(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members of nodes with the hubs that they're near, whether they're so close to one that all their links are near it (inside),
    and whether they stand between near and far of any."""
    lowest, close = _lowest(threshold), threshold
    least = 2 * threshold - 1
    far = min(lowest, lowest - (1 - threshold) - 3 * sqrt(least * (1 - least) / SLOTS)) if least > 0 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column("sig")).astype(np.uint8)
            near = batch.column("near").to_pylist()
            hubs = batch.column("hubs")
            flat, n = hubs.flatten(), np.diff(hubs.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), n)
            other = np.frombuffer(b"".join(flat.field("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
            same = (sig[row] == other).mean(1)
            linked: list[list[int]] = [[] for _ in near]
            ids, names = flat.field("doc_id").to_pylist(), flat.field("near").to_pylist()
            for i in np.flatnonzero(same >= lowest).tolist():
                linked[row[i]].append(ids[i])
                if near[row[i]] is None:
                    near[row[i]] = names[i]
            between, inside = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            between[row[(same >= far) & (same < lowest)]] = True
            inside[row[same >= close]] = True
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), batch.column("sig"), pa.array(near, pa.int64()), pa.array(linked, pa.list_(pa.int64())), pa.array(between), pa.array(inside)], ["node", "doc_id", "sig", "near", "linked", "between", "inside"])

    return run


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The member of each sample whose minhash values agree with the others' most."""
    for batch in batches:
        hubs = []
        for row in batch.column("members"):
            members = sorted((m["doc_id"], m["sig"]) for m in row.as_py())
            sig = np.frombuffer(b"".join(s for _, s in members), "<u4").reshape(-1, SLOTS)
            hubs.append(members[int((sig[:, None] == sig[None]).sum((1, 2)).argmax())][0])
        yield pa.RecordBatch.from_arrays([batch.column("area"), pa.array(hubs, pa.int64())], ["area", "hub"])


def _to_hub(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each member's distance to its hub and whether they're linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hub = None, None
            far, close = [], []
            for name, raw, mine in zip(batch.column("hub").to_pylist(), batch.column("hub_shingles"), batch.column("shingles"), strict=True):
                if name != at:
                    at, hub = name, _as_set(raw.as_py())
                own = _as_set(mine.as_py())
                common = _common(hub, own)
                union = len(hub) + len(own) - common
                far.append(1 - common / union)
                close.append(100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(far, pa.float64()), pa.array(close, pa.bool_())], ["doc_id", "far", "close"])

    return run


def _cells(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between labels: of each cell, the asked documents with all others of another label. Distances to common hubs rule pairs out."""
    most = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for row in batch.column("members"):
                members = row.as_py()
                asked, others = [m for m in members if m["asked"]], [m for m in members if not m["asked"]]
                if not asked or not others:
                    continue
                sets = [_as_set(m["shingles"]) for m in others]
                labels = np.array([m["label"] for m in others], np.int64)
                far = np.array([m["far"] for m in others], float).reshape(len(others), -1)
                for m in asked:
                    own, label = _as_set(m["shingles"]), m["label"]
                    done = {label}
                    for j in np.flatnonzero((labels != label) & (np.abs(far - np.array(m["far"], float)) <= most).all(1)).tolist():
                        if labels[j] not in done and linked(own, sets[j], percent):
                            done.add(labels[j])
                            found.add((label, int(labels[j])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _lowest(threshold: float) -> float:
    return threshold - DEVIATIONS * sqrt(threshold * (1 - threshold) / SLOTS)


def _neighbourhoods(reps: DataFrame, percent: int, trees: int, depth: int) -> DataFrame:
    """(id, root) of sets that may be linked: components of what meets in the trees."""
    spark = reps.sparkSession
    lam = percent / 100
    lowest = _lowest(lam)
    narrow = reps.select("doc_id", "sig").mapInArrow(_narrow, "doc_id long, sig binary")
    # children are read twice, so they're written
    rows = shared_table(spark, reps.select("doc_id", "sig").mapInArrow(_descend(lam, trees, depth), _NODES), "children")
    links, leaves, total, size = [], [], 0, 2 * trees * reps.count()
    for level in range(1, depth + 1):
        # written first: a join with a side that is dealt by an aggregate can't split a hot node
        counted = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count("near").alias("k"), F.min("near").alias("lo"), F.max("near").alias("hi"))
        met = shared_table(spark, counted.where("n > 1 and not (k = n and lo = hi)").select("node", "n").coalesce(_tasks(size)), "met")
        n, many = (x or 0 for x in met.agg(F.sum("n"), F.sum(F.when(F.col("n") > NODE, F.col("n")))).first())
        nodes = shared_table(spark, rows.join(maybe_broadcast(met, n), "node"), "nodes")
        leaves.append(nodes.where(F.col("n") <= NODE).select("node", "doc_id"))
        total += n
        large = nodes.where(F.col("n") > NODE).select("node", "doc_id", "near")
        if not many:
            break
        if level == depth:  # what hasn't parted by now is one neighbourhood
            heads = large.groupBy("node").agg(F.min("doc_id").alias("a"))
            links.append(large.join(maybe_broadcast(heads, many // NODE), "node").select("a", F.col("doc_id").alias("b")).distinct())
            break
        large = shared_table(spark, reps.select("doc_id", "sig").join(maybe_broadcast(large, many), "doc_id"), "large-nodes")
        chosen = W.partitionBy("node").orderBy(F.xxhash64("doc_id"), "doc_id")
        sample = large.withColumn("k", F.row_number().over(chosen)).where(F.col("k") <= SAMPLE).groupBy("node").agg(F.collect_list(F.struct("doc_id", "near", "sig")).alias("members")).coalesce(_tasks(many))
        hubs = shared_table(spark, sample.mapInArrow(_node_hubs(lowest), "node long, hubs array<struct<doc_id:long,near:long,sig:binary>>"), "hubs")
        with_hubs = large.join(maybe_broadcast(hubs, many // NODE * 12), "node", "left").withColumn("hubs", F.coalesce("hubs", F.array().cast(hubs.schema["hubs"].dataType)))
        placed = shared_table(spark, with_hubs.select("node", "doc_id", "sig", "near", "hubs").mapInArrow(_place(lam), _PLACED), "placed-members")
        links.append(placed.select(F.explode("linked").alias("a"), F.col("doc_id").alias("b")).where("a != b").distinct())
        mixed = shared_table(spark, placed.where("between").select("node").distinct().coalesce(_tasks(many)), "mixed")
        on = placed.where("not inside")
        rows = on.where("size(linked) = 0").unionByName(on.where("size(linked) > 0").join(maybe_broadcast(mixed, many // NODE), "node", "left_semi"))
        rows = shared_table(spark, rows.select("node", "doc_id", "near", "sig"), "apart")
        size = 2 * forks_for(lam, trees, depth) * rows.count()
        if not size:
            break
        rows = shared_table(spark, rows.mapInArrow(_descend(lam, trees, depth), _NODES), "children")
    small = reduce(DataFrame.unionAll, leaves)
    members = narrow.join(maybe_broadcast(small, total), "doc_id").groupBy("node").agg(F.collect_list(F.struct("doc_id", "sig")).alias("members"))
    near = members.select("members").mapInArrow(_near(lowest), "a long, b long")
    return components(reduce(DataFrame.unionAll, links, near))


def _tasks(rows: int) -> int:
    return max(TASKS, rows // TASK_ROWS)


def _outside(known: DataFrame) -> DataFrame:
    """Members that don't belong to the largest component of their area."""
    sizes = known.groupBy("area", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = shared_table(known.sparkSession, sizes.groupBy("area").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "largest")
    return known.join(maybe_broadcast(largest, largest.count()), "area").where("label != main").drop("main")


def _large(sets: DataFrame, percent: int) -> DataFrame:
    """(id, root) of neighbourhoods too large for a task. sets: area, doc_id, shingles, sig; a written table.

    A round compares all members of an area with one hub, of those outside its largest component. What is outside after the last round is
    compared with all members: asked documents are dealt into blocks, members into splits, and each pair of them is a cell.
    """
    spark = sets.sparkSession
    # label: the smallest document of the component so far; far: distances to the hubs
    known = shared_table(spark, sets.select("area", "doc_id", "sig", F.col("doc_id").alias("label"), F.array().cast("array<double>").alias("far")), "known")
    outside = known
    for _ in range(ROUNDS):
        order = W.partitionBy("area").orderBy(F.xxhash64("doc_id"), "doc_id")
        sample = outside.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE).groupBy("area").agg(F.collect_list(F.struct("doc_id", "sig")).alias("members"))
        hubs = shared_table(spark, sample.mapInArrow(_hubs, "area long, hub long"), "hubs")
        areas = hubs.count()
        if not areas:
            break
        with_sets = shared_table(spark, sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("hub_shingles")).join(maybe_broadcast(hubs, areas), "hub"), "hub-sets")
        weight = with_sets.agg(F.sum(F.octet_length("hub_shingles"))).first()[0]
        mine = sets.select("area", "doc_id", "shingles").join(F.broadcast(with_sets) if weight <= CELL else with_sets, "area")
        held = shared_table(spark, mine.mapInArrow(_to_hub(percent), "doc_id long, far double, close boolean"), "held")
        known = known.join(held.withColumnRenamed("far", "to_hub"), "doc_id", "left").withColumn("far", F.when(F.col("to_hub").isNotNull(), F.array_append("far", F.col("to_hub"))).otherwise(F.col("far")))
        known = shared_table(spark, known.select("area", "doc_id", "sig", "label", "far", "close"), "known")
        # all labels that hold a member linked with the hub are one
        star = shared_table(spark, known.where("close").groupBy("area", "label").agg(F.lit(1).alias("one")), "star")
        merged = star.groupBy("area").agg(F.min("label").alias("label_now"))
        star = shared_table(spark, star.join(merged, "area").select("area", "label", "label_now"), "merged")
        known = known.join(maybe_broadcast(star, star.count()), ["area", "label"], "left").select("area", "doc_id", "sig", F.coalesce("label_now", "label").alias("label"), "far")
        known = shared_table(spark, known, "known")
        outside = shared_table(spark, _outside(known), "outside")
    found = known.select(F.col("doc_id").alias("id"), F.col("label").alias("root"))
    if outside.isEmpty():
        return found
    whole = shared_table(spark, sets.select("doc_id", "shingles").join(known.select("area", "doc_id", "label", "far"), "doc_id"), "whole")
    asked = whole.join(outside.select("doc_id"), "doc_id", "left_semi")
    parts = lambda df, name: df.groupBy("area").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("shingles") + 64) / CELL)).cast("int").alias(name))
    grid = shared_table(spark, parts(asked, "blocks").join(parts(whole, "splits"), "area"), "grid")
    n = grid.count()
    pick = lambda df, own, other, is_asked: df.join(maybe_broadcast(grid, n), "area").select("area", F.pmod(F.xxhash64("doc_id"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), F.struct(F.lit(is_asked).alias("asked"), "doc_id", "label", "far", "shingles").alias("m"))
    cells = pick(asked, "blocks", "splits", True).unionByName(pick(whole, "splits", "blocks", False)).groupBy("area", "blocks", "splits").agg(F.collect_list("m").alias("members"))
    more = components(cells.select("members").mapInArrow(_cells(percent), "a long, b long")).select(F.col("id").alias("root"), F.col("root").alias("joined"))
    more = shared_table(spark, more, "joined")
    return found.join(maybe_broadcast(more, more.count()), "root", "left").select("id", F.coalesce("joined", "root").alias("root"))


def groups(documents: DataFrame, percent: int = 80, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reached over links), kept."""
    with scratch(documents.sparkSession) as keep:
        return keep(_groups(documents, percent, shingle, trees, depth), "groups")


def _groups(documents: DataFrame, percent: int, shingle: int, trees: int, depth: int) -> DataFrame:
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = shared_table(spark, docs.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"), "sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = shared_table(spark, full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    # one row for each set; a doc_id that repeats with several texts may stand for several
    reps = full.join(classes.select("k1", "k2", "n_shingles", F.col("rep").alias("doc_id")), ["k1", "k2", "n_shingles", "doc_id"], "left_semi").dropDuplicates(["k1", "k2", "doc_id"]).select("doc_id", "n_shingles", "sig")
    reps = shared_table(spark, reps, "representatives")
    areas = shared_table(spark, _neighbourhoods(reps, percent, trees, depth), "areas")
    found = areas.count()
    sizes = reps.select(F.col("doc_id").alias("id"), "n_shingles").join(maybe_broadcast(areas, found), "id").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    placed = shared_table(spark, areas.join(maybe_broadcast(sizes, found), "root").select(F.col("id").alias("doc_id"), F.col("root").alias("area"), ((F.col("n") <= MEMBERS) & (F.col("s") <= SHINGLES)).alias("small")), "placed")
    in_area = docs.join(maybe_broadcast(placed, found), "doc_id")
    small = in_area.where("small").select("area", "doc_id", "text").mapInArrow(_sets(shingle), "area long, doc_id long, shingles binary")
    linked_to = small.groupBy("area").agg(F.collect_list(F.struct("doc_id", "shingles")).alias("members")).select("members").mapInArrow(_confirm(percent), "id long, root long")
    if not placed.where("not small").isEmpty():
        large = in_area.where("not small").select("area", "doc_id", "text").mapInArrow(_sets(shingle), "area long, doc_id long, shingles binary")
        large = shared_table(spark, large.join(reps.select("doc_id", "sig"), "doc_id"), "large")
        linked_to = linked_to.unionAll(_large(large, percent))
    linked_to = shared_table(spark, linked_to.groupBy("id").agg(F.min("root").alias("root")).where("id != root"), "components")
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2", "n_shingles"], "left").join(maybe_broadcast(linked_to, found), F.col("rep") == F.col("id"), "left")
    component = F.coalesce("root", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, one of each component; columns stay as they are."""
    gone = shared_table(documents.sparkSession, groups(documents, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return documents.join(maybe_broadcast(gone, gone.count()), documents["doc_id"].cast("long") == gone["_gone"], "left_anti")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) JOIN roots USING (doc_id)
"""
