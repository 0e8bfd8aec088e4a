"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint takes the majority of each bit over the hashes of its word shingles. Documents
whose fingerprints differ in at most ``distance`` bits are linked, and a component gets the smallest id.

Candidates come from the pigeonring principle. The 64 bits are cut into ``distance`` + 1 segments on a
ring; two fingerprints within the distance have a segment from which on every chain of l segments
differs in at most l * distance / (distance + 1) bits, rounded down: 0 bits in the first, at most 1 in the
first two, and so on. A chain that begins without a difference and has at most one in its second segment
has no difference in one half of the second segment; (segment, half, bits of both) is the key on which
distinct fingerprints meet. Where they meet, the cumulative budgets of all longer chains are tested, and
only what passes gets the full Hamming check.

Equal fingerprints are one node. Where many near fingerprints meet, a breadth-first walk links each to one
that was reached before, so k of them give k - 1 links instead of all pairs, and all links needed for the
components are found. Buckets hold 8 or 16 bytes per distinct fingerprint and arrive sorted.

A wider distance needs more bits, or chance links texts that have nothing in common: with ``second``, 64
further bits (from the same hashes, mixed) count as well, and a node is all 128 bits. Two nodes are linked if
one half differs in at most ``distance`` places and the other in at most ``second``; either half may be the
close one, so candidates come from the rings of both.

With ``share`` documents are linked if the Jaccard coefficient of their shingle sets is at least that, and equal sets are
one node. The rings of both halves give the groups of nodes within ``RING`` bits in one half and ``second`` in the other,
as above, and each such group is a bucket. Linked fingerprints may be farther apart (about a sixth of the bits), where
segments are too short to be a key; for those nodes meet on bands as well: ``BANDS`` keys of ``BAND_ROWS`` minimum hashes
of the shingles each, of 64 bits. Every
bucket has a centre, the member that meets most others; all its members are held against the centre, which is as
many pairs as members. A pair is pruned by the pigeonring chains and the Hamming check of both halves of the fingerprint
before the sets are compared. Buckets in which that left more than one group get their members' sets, in tiles of at
most twice ``TILE`` members, and all their pairs of different groups are compared inside tasks; what leaves a task are
links between groups, fewer than it has members. So every pair that the rings find or that shares a band is held against the rule, and neither
families of pages with one template nor groups of copies are listed as pairs.

Cases: NULL, empty and blank texts have no shingle and fingerprint zero, linked like any other; texts
shorter than a shingle are one; a NULL id never is the smallest of a component that has another; rows
that repeat an id keep their own fingerprints; an empty table gives an empty table. Columns beyond id
and text are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitgauge.llm.components import components
from hitgauge.llm.texts import batch_like, raw, slices
from hitgauge.staging import stage

SEED, BITS = 42, 64
#: An odd multiplier that makes further bits of a hash.
MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Buckets up to this size are compared as a matrix.
MATRIX = 2048
#: Keys on which nodes meet, and minimum hashes in a key: of pairs that share 0.8 of their shingles, 99 of 100 meet.
BANDS, BAND_ROWS = 25, 8
#: Differing bits up to which the rings find all nodes that are linked by their sets of shingles.
RING = 4
#: Members of a bucket that are compared as one block.
TILE = 1024
#: Parts into which the fingerprints of a component are dealt.
SALTS = 32


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 values of all shingles of a UTF-8 text, in blocks."""
    parts = text.lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    begin, last = (ends - lengths).tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    for at in range(0, n, 1 << 16):  # long texts in blocks of shingles
        yield np.array([digest(joined[begin[i] : last[i]], SEED) for i in range(at, min(n, at + (1 << 16)))], "<u8")


def shingle_set(blocks: list[np.ndarray]) -> np.ndarray:
    """The different shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *blocks]))


def _odd(n: int, seed: int, kind: type) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max, n, kind) | kind(1)


_MIN_BY, _BAND_BY = _odd(BANDS * BAND_ROWS, 1, np.uint32), _odd(BAND_ROWS, 2, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of minimum hashes of a set of shingles (none for an empty set)."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MIN_BY), np.iinfo(np.uint32).max)
    for at in range(0, len(high), 512):
        least = np.minimum(least, (high[at : at + 512, None] * _MIN_BY).min(axis=0))
    keys = (least.astype(np.uint64).reshape(BANDS, BAND_ROWS) * _BAND_BY).sum(axis=1, dtype=np.uint64)
    return ((keys ^ (keys >> np.uint64(31))) * MIX + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def fingerprint(text: bytes, words: int, wide: bool = False) -> list[int]:
    """SimHash of the XXH64 values of all shingles of a UTF-8 text: one or two unsigned 64-bit numbers."""
    return majority(shingle_hashes(text, words), wide)


def majority(blocks: Iterable[np.ndarray], wide: bool) -> list[int]:
    size, n = BITS * (1 + wide), 0
    votes = np.zeros(size, np.int64)
    for hashes in blocks:
        n += len(hashes)
        if wide:
            mixed = (hashes ^ (hashes >> np.uint64(33))) * MIX
            hashes = np.stack([hashes, mixed ^ (mixed >> np.uint64(29))], 1)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, size // 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n, bitorder="little").view("<u8").tolist()


def fingerprints(docs: DataFrame, text: str, words: int, wide: bool = False) -> DataFrame:
    """(_doc, fp, fp2, node, keys): every row of ``docs`` without its text as a struct, and its fingerprint as signed longs.

    If ``wide``, ``node`` is the hash of its set of shingles and ``keys`` are the set's bands.
    """
    fields = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*fields).alias("_doc"), F.col(text).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found, nodes, keys = [], [], []
            for t in raw(batch, "_text"):
                blocks = list(shingle_hashes(t, words))
                found.append(majority(blocks, wide))
                own = shingle_set(blocks) if wide else blocks[:0]
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) if wide else 0)
                keys.append(band_keys(own) if wide else np.zeros(0, np.int64))
            found = np.array(found, np.uint64).reshape(batch.num_rows, -1).view(np.int64)
            yield batch_like({
                "_doc": batch.column("_doc"), "fp": pa.array(found[:, 0]),
                "fp2": pa.array(found[:, -1] if wide else np.zeros(len(found), np.int64)),
                "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "keys": pa.array(keys, pa.list_(pa.int64())),
            })

    kind = packed.schema["_doc"].dataType.simpleString()
    return packed.mapInArrow(work, f"_doc {kind}, fp bigint, fp2 bigint, node bigint, keys array<bigint>")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of the ``distance`` + 1 segments of the ring."""
    edges = [BITS * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def chain_keys(distance: int) -> list[int]:
    """Masks of the bits on which fingerprints meet: a segment and half of the next one on the ring."""
    ring = segments(distance)
    masks = []
    for i, (low, width) in enumerate(ring):
        first = ((1 << width) - 1) << low
        after, size = ring[(i + 1) % len(ring)]
        half = size // 2
        masks.append(first | ((1 << half) - 1) << after)
        masks.append(first | ((1 << (size - half)) - 1) << (after + half))
    return masks


def within(differ: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Places of the differences (xor) that pass all chains from a segment on, and then the full check."""
    ring = segments(distance)
    passed, used = np.arange(len(differ)), np.zeros(len(differ), np.uint8)
    for length in range(1, len(ring)):
        low, width = ring[(start + length - 1) % len(ring)]
        used = used + np.bitwise_count(differ[passed] & np.uint64(((1 << width) - 1) << low))
        ok = used <= length * distance // len(ring)
        passed, used = passed[ok], used[ok]
    return passed[np.bitwise_count(differ[passed]) <= distance]


def passes(differ: np.ndarray, distance: int) -> np.ndarray:
    """Whether differences (xor) pass the chains from some segment on, and the full Hamming check."""
    ring = segments(distance)
    counts = [np.bitwise_count(differ & np.uint64(((1 << width) - 1) << low)) for low, width in ring]
    chained = np.zeros(len(differ), bool)
    for start in range(len(ring)):
        ok, used = ~chained, np.zeros(len(differ), np.int64)
        for length in range(1, len(ring)):
            used = used + counts[(start + length - 1) % len(ring)]
            ok &= used <= length * distance // len(ring)
            if not ok.any():
                break
        chained |= ok
    return chained & (np.bitwise_count(differ) <= distance)


def walk(fps: np.ndarray, start: int, distance: int, second: int | None = None) -> list[tuple[int, int]]:
    """Links (places) that connect what is linked among one bucket's fingerprints, a row of numbers each."""
    n, links = len(fps), []

    def near(one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked (place in one, place in many)."""
        differ = (one[:, None] ^ many[None, :]).ravel() if second is None else (one[:, None, 0] ^ many[None, :, 0]).ravel()
        i, j = np.divmod(within(differ, start, distance), len(many))
        if second is not None:
            ok = np.bitwise_count(one[i, 1] ^ many[j, 1]) <= second
            i, j = i[ok], j[ok]
        return i, j

    if n <= MATRIX:
        linked = np.zeros((n, n), bool)
        for a in range(0, n, 256):
            i, j = near(fps[a : a + 256], fps[a:])
            linked[i + a, j + a] = linked[j + a, i + a] = True
        rest = linked.sum(axis=1) > 1
        while rest.any():
            front = np.flatnonzero(rest)[:1]
            rest[front] = False
            while len(front):
                reached = linked[front] & rest
                new = np.flatnonzero(reached.any(axis=0))
                links += zip(front[reached[:, new].argmax(axis=0)].tolist(), new.tolist())
                rest[new] = False
                front = new
        return links
    rest = np.arange(n)
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            one = front.pop()
            _, found = near(fps[one : one + 1], fps[rest])
            if len(found):
                new = rest[found].tolist()
                links += [(one, x) for x in new]
                front += new
                rest = np.delete(rest, found)
    return links


def _buckets(points: DataFrame, distance: int, work: Callable[[np.ndarray, int], Iterator[np.ndarray]], out: str) -> DataFrame:
    """What ``work`` makes of each bucket of ``points`` (columns of longs, the first a fingerprint).

    It gets a bucket's rows, the first column unsigned and the others as they are, and the segment on which
    they meet, and yields rows of longs, named as in ``out``.
    """
    columns, names = points.columns, out.replace(" bigint", "").split(", ")
    met = points.select(
        *columns,
        F.explode(F.array(*[
            F.struct(
                F.lit(i).alias("chain"),
                F.col(columns[0]).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")).alias("bits"),
            )
            for i, m in enumerate(chain_keys(distance))
        ])).alias("k"),
    ).select("k.chain", "k.bits", *columns)
    sorted_ = met.repartition("chain", "bits").sortWithinPartitions("chain", "bits", *columns)

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(chain: np.ndarray, bits: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.r_[True, (np.diff(chain) != 0) | (np.diff(bits) != 0), True])
            found, size = [], 0
            for i in np.flatnonzero(np.diff(edges) > 1):
                a, b = edges[i], edges[i + 1]
                for part in work(rows[a:b], int(chain[a]) // 2):
                    found.append(part)
                    size += len(part)
                    if size > 1 << 16:
                        yield packed(np.concatenate(found))
                        found, size = [], 0
            if size:
                yield packed(np.concatenate(found))

        def packed(rows: np.ndarray) -> pa.RecordBatch:
            return batch_like({n: pa.array(np.ascontiguousarray(rows[:, i])) for i, n in enumerate(names)})

        held: list[np.ndarray] | None = None  # the last bucket, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("chain", "bits", *columns)]
            now = [now[0], now[1], np.stack(now[2:], 1)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in now]
            if cut:
                yield from linked(*[x[:cut] for x in now])
        if held is not None:
            yield from linked(*held)

    return sorted_.mapInArrow(batched, out).distinct()


def fingerprint_links(distinct: DataFrame, distance: int, second: int | None = None) -> DataFrame:
    """(a, a2, b, b2): links that connect all distinct fingerprints (fp, fp2) within the distances."""

    def work(rows: np.ndarray, start: int) -> Iterator[np.ndarray]:
        fps = rows.view(np.uint64)
        found = walk(fps[:, 0] if second is None else fps, start, distance, second)
        if found:
            yield rows[np.array(found)].reshape(-1, 4)

    return _buckets(distinct.select("fp", "fp2"), distance, work, "a bigint, a2 bigint, b bigint, b2 bigint")


def ring_groups(points: DataFrame, distance: int, second: int) -> DataFrame:
    """(node, key): nodes of ``points`` that are near others, one half within ``distance`` and the other within ``second``.

    A group is what a walk reaches in one bucket of the ring. Its key is made of its members, so a group that several
    chains find is one group.
    """

    def work(rows: np.ndarray, start: int) -> Iterator[np.ndarray]:
        first: dict[int, int] = {}
        for a, b in walk(rows[:, :2].view(np.uint64), start, distance, second):
            first[b] = first.setdefault(a, a)
        places, groups = (np.fromiter(x, np.int64, len(first)) for x in (first.keys(), first.values()))
        for group in np.unique(groups):
            nodes = np.unique(rows[places[groups == group], 2])
            key = np.array([xxhash.xxh64_intdigest(nodes.tobytes(), SEED)], np.uint64).view(np.int64)
            yield np.stack([nodes, np.repeat(key, len(nodes))], 1)

    halves = [points.select(*h, "node") for h in (("fp", "fp2"), (F.col("fp2").alias("fp"), F.col("fp").alias("fp2")))]
    one, other = (_buckets(h, distance, work, "node bigint, key bigint") for h in halves)
    return one.union(other).distinct()


def similar(pairs: DataFrame, sets: DataFrame, distance: int, second: int, share: float) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (node, fp, fp2, shingles) are near in both fingerprints and share at least ``share``.

    A node of many pairs is repeated, once for each ``SALTS`` of them, so they are dealt to many tasks.
    """
    for side in ("a", "b"):
        times = pairs.groupBy(side).agg(F.ceil(F.count("*") / SALTS).cast("bigint").alias("times"))
        own = sets.join(times, sets["node"] == times[side]).select(
            F.col(side).alias("of"), F.struct("fp", "fp2", "shingles").alias(f"of_{side}"),
            F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("salt"),
        )
        other = "b" if side == "a" else "a"
        dealt = pairs.join(times, side).withColumn("_salt", 1 + F.pmod(F.xxhash64(other), F.col("times"))).drop("times")
        part = dealt.join(own, (dealt[side] == own["of"]) & (dealt["_salt"] == own["salt"])).select("a", "b", f"of_{side}")
        held = part if side == "a" else held.join(part, ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(f"of_{side}") for side in ("a", "b"))
            prints = [[c.field(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2)] for c in (x, y)]
            ok = near_prints(prints[0][0] ^ prints[1][0], prints[0][1] ^ prints[1][1], distance, second)
            for i in np.flatnonzero(ok):
                one, many = (c.field(2)[int(i)].values.to_numpy(zero_copy_only=False) for c in (x, y))
                both = len(np.intersect1d(one, many, assume_unique=True))
                ok[i] = both >= share * (len(one) + len(many) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return held.mapInArrow(work, "a bigint, b bigint")


def near_prints(differ: np.ndarray, differ2: np.ndarray, distance: int, second: int) -> np.ndarray:
    """Whether one half is within ``distance`` and the other within ``second``, whichever they are."""
    ok = np.zeros(len(differ), bool)
    for one, other in ((differ, differ2), (differ2, differ)):
        rest = np.flatnonzero(~ok)
        ok[rest] = passes(one[rest], distance) & (np.bitwise_count(other[rest]) <= second)
    return ok


def buckets(points: DataFrame, groups: DataFrame) -> tuple[DataFrame, list[int]]:
    """(key, node, size) of the nodes that share a key with others, staged, and the keys with a thousandth of all rows.

    ``groups`` has further rows (node, key). There are at most a thousand such keys, so they may come to the driver.
    """
    rows = points.select("node", F.explode("keys").alias("key")).union(groups.select("node", "key"))
    sizes = stage(rows.groupBy("key").agg(F.count("*").alias("size")), "bucket-sizes")
    hot = _hot(sizes, "key", "size")
    return stage(_spread(rows, sizes.filter("size > 1"), "key", "node", hot), "buckets"), hot


def _hot(sizes: DataFrame, key: str, size: str) -> list[int]:
    """Keys that hold a thousandth of all rows and at least a thousand of them."""
    total = sizes.agg(F.sum(size)).first()[0] or 0
    return [r[0] for r in sizes.filter(F.col(size) > max(1000, total / 1000)).select(key).collect()]


def _spread(rows: DataFrame, table: DataFrame, key: str, by: str | Column, hot: list) -> DataFrame:
    """Join ``rows`` with a table of one row per key; rows of the ``hot`` keys are dealt to ``SALTS`` tasks by ``by``."""
    if not hot:
        return rows.join(table, key)
    few, none = F.col(key).isin(hot), F.lit(0).cast("bigint")
    salted = rows.withColumn("_salt", F.when(few, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(none))
    salts = F.when(few, F.sequence(none, F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(none))
    return salted.join(table.withColumn("_salt", F.explode(salts)), [key, "_salt"]).drop("_salt")


def centred_pairs(members: DataFrame, hot: list[int]) -> DataFrame:
    """(a, b): every member of a bucket (key, node, size) and the bucket's centre, each pair once."""
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    centres = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("c"))
    centres = centres.select("key", F.col("c.node").alias("b"))
    pairs = _spread(members, centres, "key", "node", hot).filter("node <> b")
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def open_tiles(members: DataFrame, labels: DataFrame, sets: DataFrame, hot: list[int]) -> DataFrame:
    """(key, i, j, node, label, fp, fp2, shingles): members of the buckets with several labels, a tile for two blocks each."""
    named = members.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    named = named.select("key", "node", "size", F.coalesce("root", "node").alias("label"))
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    opened = _spread(named, several.select("key"), "key", "node", hot)
    blocks = F.ceil(F.col("size") / TILE).cast("bigint")
    own = F.pmod(F.xxhash64("node"), blocks)
    dealt = opened.select(
        "key", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other")
    )
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label")
    return dealt.join(sets, "node").select("key", "i", "j", "node", "label", "fp", "fp2", "shingles")


def linked_members(nodes: np.ndarray, labels: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], distance: int, second: int, share: float) -> list[tuple[int, int]]:
    """Links (nodes) that connect the labels of one tile's members that have a pair within the rule."""
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        part = slice(*np.searchsorted(column, [at, at + 4096]))
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[part], column[part] - at] = 1
        both += has @ has.T
    i, j = np.nonzero(np.triu(both >= share * (sizes[:, None] + sizes[None, :] - both), 1) & (labels[:, None] != labels[None, :]))
    near = near_prints(prints[i, 0] ^ prints[j, 0], prints[i, 1] ^ prints[j, 1], distance, second)
    i, j = i[near], j[near]
    links, group = [], np.unique(labels, return_inverse=True)[1]
    for one in np.unique(i):
        many = j[i == one]
        other, first = np.unique(group[many], return_index=True)
        new = other != group[one]
        links += [(int(nodes[one]), int(nodes[m])) for m in many[first[new]]]
        group[np.isin(group, other)] = group[one]
    return links


def open_links(tiles: DataFrame, distance: int, second: int, share: float) -> DataFrame:
    """(a, b): what :func:`linked_members` finds in each tile."""
    tile = ["key", "i", "j"]
    dealt = tiles.repartition(*tile).sortWithinPartitions(*tile)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            prints = np.stack([own.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "fp2")], 1)
            sets = [x.values.to_numpy(zero_copy_only=False) for x in own.column("shingles")]
            nodes, labels = (own.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label"))
            found = np.array(linked_members(nodes, labels, prints, sets, distance, second, share), np.int64).reshape(-1, 2)
            return batch_like({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in tile], 1)
            edges = np.r_[0, np.flatnonzero((np.diff(values, axis=0) != 0).any(axis=1)) + 1, batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                rows = batch.slice(a, b - a)
                if held and any(held[-1].column(c)[0] != rows.column(c)[0] for c in tile):
                    yield links()
                    held.clear()
                held.append(rows)
        if held:
            yield links()

    return dealt.mapInArrow(work, "a bigint, b bigint").distinct()


def checked_links(docs: DataFrame, found: DataFrame, words: int, distance: int, second: int, share: float) -> DataFrame:
    """(a, b): links between nodes of ``found`` that connect all pairs which the rings find or which share a band, and keep the rule."""
    points = stage(found.select("node", "fp", "fp2", "keys").dropDuplicates(["node"]), "fingerprint-nodes")
    members, hot = buckets(points, stage(ring_groups(points, min(RING, distance), second), "ring-groups"))
    met = stage(members.select("node").distinct(), "met-nodes")
    firsts = found.join(met, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("c")
    )
    chosen = firsts.select("node", *_row_keys("c.id", "c.content"))
    packed = docs.select("text", *_row_keys("id", "content"))
    texts = packed.join(chosen, ROW).dropDuplicates(ROW).select("node", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [shingle_set(list(shingle_hashes(t, words))).view(np.int64) for t in raw(batch, "text")]
            yield batch_like({"node": batch.column("node"), "shingles": pa.array(own, pa.list_(pa.int64()))})

    sets = texts.mapInArrow(work, "node bigint, shingles array<bigint>")
    sets = stage(sets.join(points.select("node", "fp", "fp2"), "node"), "shingle-sets")
    near = stage(similar(stage(centred_pairs(members, hot), "centred-pairs"), sets, distance, second, share), "near-first")
    labels = stage(components(near), "first-groups")
    return near.union(stage(open_links(open_tiles(members, labels, sets, hot), distance, second, share), "open-links"))


#: Names of what tells rows apart: id, whether it is NULL, hash of the text.
ROW = ["_key", "_none", "_content"]


def _row_keys(id_: str, content: str) -> list[Column]:
    keys = [F.coalesce(F.col(id_).cast("string"), F.lit("")), F.col(id_).isNull(), F.col(content)]
    return [k.alias(n) for k, n in zip(keys, ROW)]


def _node(fp: str, fp2: str, second: int | None) -> Column:
    if second is None:
        return F.col(fp)
    return F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (fp, fp2)])


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, second: int | None = None,
    share: float | None = None,
) -> DataFrame:
    """(key, content, fp, root, component): one row per row of ``docs``.

    ``content`` is the text's hash, ``component`` the smallest id of all documents that links reach.
    ``share`` (with ``second``) is the least Jaccard coefficient of linked documents' shingles.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    found = fingerprints(rows, "text", words, second is not None)
    found = stage(found.select("_doc.id", "_doc.content", "fp", "fp2", "node", "keys"), "fingerprints")
    if share is not None:
        roots = components(checked_links(rows, found, words, distance, second, share))
        nodes = found.groupBy(F.col("node").alias("own")).agg(F.min("id").alias("low"), F.count("*").alias("rows"))
        return _named(found.withColumn("own", F.col("node")), stage(nodes, "shingle-nodes"), roots, key)
    nodes = stage(found.groupBy("fp", "fp2").agg(F.min("id").alias("low"), F.count("*").alias("rows")), "fingerprint-nodes")
    links = fingerprint_links(nodes.select("fp", "fp2"), distance, second)
    if second is not None:
        turned = fingerprint_links(nodes.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2")), distance, second)
        links = links.union(turned.select("a2", "a", "b2", "b"))
    roots = components(links.select(_node("a", "a2", second).alias("a"), _node("b", "b2", second).alias("b")))
    nodes = nodes.select(_node("fp", "fp2", second).alias("own"), "low", "rows")
    return _named(found.withColumn("own", _node("fp", "fp2", second)), nodes, roots, key)


def _named(found: DataFrame, nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Rows of ``found`` with root and smallest id of their nodes (own, low, rows), where ``roots`` has (node, root).

    The copies of a text with a thousandth of all rows are dealt to many tasks.
    """
    linked = nodes.join(roots, nodes["own"] == roots["node"]).select("own", "low", "root")
    linked = stage(linked.withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(SALTS))), "linked-fingerprints")
    # a component of any size is dealt to many tasks: its smallest id is repeated once per salt
    lows = linked.groupBy("root").agg(F.min("low").alias("component"))
    lows = lows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    reached = linked.join(lows, ["root", "salt"]).select(F.col("own").alias("of"), "root", "component")
    named = nodes.join(reached, nodes["own"] == reached["of"], "left").select(
        "own",
        F.coalesce("root", "own").alias("root"),
        F.when(F.col("of").isNull(), F.col("low")).otherwise(F.col("component")).alias("component"),
    )
    named = _spread(found, named, "own", F.monotonically_increasing_id(), _hot(nodes, "own", "rows"))
    return named.select(F.col("id").alias(key), "content", "fp", "root", "component")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row for each component: that of its smallest id (NULL last), then text hash.

    The choice is a narrow table of (id, text hash); a semi-join finds the rows, and rows that repeat
    both are reduced to one.
    """
    found = near_duplicates(docs, key, text, **options)
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "content"))
    chosen = stage(found.groupBy("root").agg(first.alias("c")).select("c.id", "c.content"), "group-firsts")
    # the join and the reduction of repeated rows share these keys, so texts are shuffled once at most
    chosen = chosen.select(*_row_keys("id", "content"))
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("id"), F.xxhash64(text).alias("content"))
    packed = packed.select("_doc", *_row_keys("id", "content"))
    return packed.join(chosen, ROW, "left_semi").dropDuplicates(ROW).select("_doc.*")
