"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are grouped first, so copies cost nothing further. The 64 bits are split into PARTS partitions that keep
correlated bits together; two fingerprints within LINK bits agree, in at least one partition i, up to t_i bits, for
any thresholds with sum LINK - PARTS + 1 (a partition with -1 is not probed). The thresholds come from a dynamic
programme over estimated candidate counts: exact collision counts of each partition's values, times the gain of
leaving out bits. A fingerprint is dealt under its value in each partition, for t_i > 0 once for each set of t_i bits
left out.

A bucket of up to BUCKET members is compared in full and gives a spanning forest of its links, never its pairs.
A larger bucket is dealt again on the bits that its key does not fix, by the same principle; as fingerprints are
distinct, a key that fixes all but r bits has at most 2**r members, so this ends, and no member or link is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, carried, columns, discard, map_rows, materialise, slices, unpacked
from tessera.llm.components import components, widened

BITS = 64
PARTS = 3
#: Fingerprints link at this many differing bits or fewer.
LINK = 2
SHINGLE = 3
SEED = 42
#: Members of a bucket that are compared in full.
BUCKET = 128
#: Frequent shingles are counted in each task over HELD shingles at a time, sent on if counted SOME times, and HEAD of them at most are used.
HELD, SOME, HEAD = 1 << 20, 3, 1 << 16
#: Keys of a set in the near-duplicate stage, and the shingles that make a key.
BANDS, ROWS = 40, 2
#: Rounds in which sets meet the hubs of their bands before bands are compared in full.
STARS = 2
_TIMES, _PLUS = (np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64))
_TIMES |= np.uint64(1)


def hashes(raw: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's word shingles, in order and with repeats; a shorter text is one shingle, no words: none.

    ``bytes.lower`` and ``bytes.split`` do exactly what is wanted of UTF-8: A-Z, and the six ASCII white spaces.
    """
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text = memoryview(b" ".join(words))
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    return np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes; none: zero."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in more than half of the hashes of the text's word shingles; no words: zero."""
    return majority(hashes(raw, shingle))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to doc_id, f (the fingerprint as a signed long), written once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches):
            yield {"doc_id": part.column("doc_id"), "f": [signed(fingerprint(x, shingle)) for x in as_bytes(part.column("text"))]}

    return materialise(map_rows(docs, "doc_id long, f long", task), "simhash")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How often each pair of bits is set together: 64 * 64 numbers, summed over all fingerprints."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            f = batch.column("f").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(f, axis=1, bitorder="little").astype(np.float64)
            total, n = total + bits.T @ bits, n + len(bits)
        yield {"i": list(range(BITS * BITS)), "together": total.ravel().astype(np.int64).tolist(), "n": [n] + [0] * (BITS * BITS - 1)}

    rows = map_rows(distinct.select("f"), "i int, together long, n long", task).groupBy("i").agg(F.sum("together").alias("together"), F.sum("n").alias("n")).toPandas().sort_values("i")
    return int(rows["n"].sum()), rows["together"].to_numpy(float).reshape(BITS, BITS) if len(rows) else np.zeros((BITS, BITS))


def partitions(n: int, together: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Split the bits into ``parts`` groups of about equal size, each grown from a seed by its most correlated bits."""
    share = np.diag(together) / max(1, n)
    covariance = together / max(1, n) - np.outer(share, share)
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    near = np.abs(covariance / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    left, found = set(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        group = [max(left, key=lambda b: (round(near[b, sorted(left)].sum(), 9), -b))]
        left.discard(group[0])
        while len(group) < size:
            b = max(left, key=lambda x: (round(near[x, group].sum(), 9), -x))
            group.append(b)
            left.discard(b)
        found.append(sorted(group))
    return found


def thresholds(costs: list[list[float]], total: int) -> list[int]:
    """Dynamic programme: t_i from -1 on, sum ``total``, least sum of costs[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (price, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                option = (price + cost[t + 1], [*chosen, t])
                if used + t not in step or option < step[used + t]:
                    step[used + t] = option
        best = step
    return best[total][1]


def masks(bits: list[int], t: int) -> list[int]:
    """The masks under which a partition's values are compared for threshold ``t``: all ways to leave out t bits."""
    if t < 0:
        return []
    whole = sum(1 << b for b in bits)
    return [whole & ~sum(1 << b for b in out) for out in combinations(bits, t)]


def plan(distinct: DataFrame, parts: int = PARTS, link: int = LINK) -> list[int]:
    """The masks of all probes: partitions by correlation, thresholds by estimated candidates."""
    n, together = bit_counts(distinct)
    groups = partitions(n, together, parts)
    share = np.diag(together) / max(1, n)
    agree = share**2 + (1 - share) ** 2
    # exact: pairs of fingerprints that agree on all bits of a partition
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("f").bitwiseAND(F.lit(signed(masks(g, 0)[0]))).alias("v")) for i, g in enumerate(groups)]))
    counts = distinct.select(keys.alias("k")).groupBy("k.i", "k.v").count().groupBy("i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    pairs = {r["i"]: r["pairs"] for r in counts.collect()}  # one row for each partition
    costs = []
    for i, g in enumerate(groups):
        # leaving out a bit multiplies the expected agreement by 1 / (the bit's own); each probe also costs a row
        cost = [0.0]
        for t in range(link + 1):
            gain = sum(float(np.prod([1 / agree[b] for b in out])) for out in combinations(g, t))
            cost.append(pairs.get(i, 0.0) * gain + n * len(masks(g, t)))
        costs.append(cost)
    chosen = thresholds(costs, link - parts + 1)
    return [m for g, t in zip(groups, chosen, strict=True) for m in masks(g, t)]


def forest(f: np.ndarray, link: int) -> tuple[list[int], list[int]]:
    """Minimum spanning forest of the links among at most BUCKET fingerprints (positions), by Prim's method."""
    away = np.bitwise_count(f[:, None] ^ f[None, :]).astype(np.int64)
    far, n = BITS + 1, len(f)
    nearest, parent, left, a, b = np.full(n, far), np.zeros(n, np.int64), np.ones(n, bool), [], []
    for _ in range(n):
        x = int(np.where(left, nearest, far + 1).argmin())
        if nearest[x] <= link:
            a.append(int(parent[x]))
            b.append(x)
        left[x] = False
        closer = left & (away[x] < nearest)
        nearest[closer], parent[closer] = away[x][closer], x
    return a, b


def compare(members: DataFrame, link: int) -> DataFrame:
    """Rows (mask, v, f) of buckets of at most BUCKET members, dealt and sorted by bucket, to forest edges (a, b)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        rest = np.zeros((0, 3), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)])
            edge = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            last = int(edge[-1]) if len(edge) else 0
            yield edges(rows[:last])
            rest = rows[last:]  # the last bucket may go on in the next batch
        yield edges(rest)

    def edges(rows: np.ndarray) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        starts = [0, *(np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1).tolist(), len(rows)]
        for s, e in zip(starts, starts[1:], strict=False):
            if e - s > 1:
                f = rows[s:e, 2]
                a, b = forest(f.view(np.uint64), link)
                out["a"] += f[a].tolist()
                out["b"] += f[b].tolist()
        return out

    dealt = members.repartition("mask", "v").sortWithinPartitions("mask", "v")
    return map_rows(dealt.select("mask", "v", "f"), "a long, b long", task)


def finer(mask: int, parts: int, link: int) -> list[int]:
    """The masks of the next level below ``mask``: its bits and one of ``parts`` shares of the others."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    shares = [free[i::parts] for i in range(parts)]
    return [mask | sum(1 << b for b in s) for s in shares]


def links(distinct: DataFrame, probes: list[int], parts: int = PARTS, link: int = LINK, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) among distinct fingerprints; for a ``link`` that the probes cover, their components are those of all links."""
    found = None
    level, below = distinct.select("f"), [(None, probes)]
    rows = None
    while below:
        if rows is None:
            keys = F.array(*[F.lit(signed(m)) for m in probes])
            rows = level.select("f", F.explode(keys).alias("mask"))
        else:
            choice = distinct.sparkSession.createDataFrame([(signed(m), [signed(y) for y in ms]) for m, ms in below], "mask long, finer array<long>")
            rows = rows.join(F.broadcast(choice), "mask").select("f", F.explode("finer").alias("mask"))  # at most parts ** level masks
        rows = rows.withColumn("v", F.col("f").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "v").count()
        alone = sizes.where("count > 1").withColumn("large", F.col("count") > bucket).select("mask", "v", "large")
        rows = materialise(rows.join(alone, ["mask", "v"]), "simhash-buckets")
        edges = materialise(compare(rows.where("not large"), link), "simhash-links")
        found = edges if found is None else found.unionByName(edges)
        large = rows.where("large")
        seen = [r["mask"] & (2**64 - 1) for r in large.select("mask").distinct().collect()]  # at most parts ** level masks
        below = [(m, finer(m, parts, link)) for m in seen]
        rows = large.select("f", "mask")
    return found


def classes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """f, component_id: the smallest doc_id that can be reached from a fingerprint over ``edges``."""
    distinct = materialise(rows.groupBy("f").agg(F.min("doc_id").alias("first")), "simhash-first")
    linked = components(edges)
    named = linked.join(distinct, linked["node"] == distinct["f"]).select("node", "component", "first")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    return distinct.join(named, distinct["f"] == named["node"], "left").select("f", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, link: int = LINK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    A null text counts as empty; texts without words have the fingerprint zero and link like any other. Rows without
    a doc_id get a fingerprint; a component of such rows alone has a null id. Rows that repeat a doc_id each have their
    own fingerprint. Empty table: no rows. Other columns are ignored.
    """
    rows = fingerprints(columns(docs, doc_id=doc_id, text=text), shingle)
    distinct = materialise(rows.select("f").distinct(), "simhash-distinct")
    # written, so that the last join has exchanges of its own on both sides and can split a fingerprint with very many rows
    ids = materialise(classes(rows, links(distinct, plan(distinct, link=link), link=link)), "simhash-classes")
    return rows.join(ids, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def frequent(docs: DataFrame, k: int, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ``most`` at most, and how often texts have them (a lower bound).

    The list only orders shingles (``prefix``): whatever it misses costs candidates, never a result.
    """

    def counted(held: list[np.ndarray]) -> dict[str, list]:
        s, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return {"s": pa.array(s[n >= SOME].view(np.int64)), "n": pa.array(n[n >= SOME])}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held, size = [], 0
        for part in slices(batches):
            for raw in as_bytes(part.column("text")):
                held.append(np.unique(hashes(raw, k)))
                size += len(held[-1])
                if size >= HELD:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    rows = map_rows(docs.select("text"), "s long, n long", task).groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(most).toPandas()
    s, n = rows["s"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def shared(x: float) -> int:
    """The least whole number from ``x`` on; a little lower where ``x`` is whole but for rounding."""
    return int(np.ceil(x - 1e-6))


def rarest(s: np.ndarray, often: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set in an order that is the same for all sets: the rarer first, otherwise by hash.

    Two sets with a Jaccard similarity of ``least`` differ in a share of 1 - least of the larger at most. So much of a
    set may be missing in its partner, and as much again is taken: half of what is left is common at the worst.
    """
    at = np.minimum(np.searchsorted(often[0], s), max(0, len(often[0]) - 1))
    count = np.where(often[0][at] == s, often[1][at], 0) if len(often[0]) else np.zeros(len(s), np.int64)
    return s[np.lexsort((s, count))][: 2 * (len(s) - shared(least * len(s))) + 1]


def bands(s: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, each of the least shingles under ROWS permutations."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(s), 1 << 12):
        least = np.minimum(least, (s[None, i : i + (1 << 12)] * _TIMES + _PLUS).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def summaries(docs: DataFrame, k: int, least: float, exact: bool = False) -> DataFrame:
    """doc_id, h (hash of the text), node (hash of the set of shingles), f (fingerprint), n (shingles of the set), bands; only texts with words.

    With ``exact`` the bands are single shingles: so many of the rarest that two sets with ``least`` in common must share one.
    """
    often = frequent(docs, k)

    def keys(s: np.ndarray) -> np.ndarray:
        first = rarest(s, often, least)
        return first[: len(s) - shared(least * len(s)) + 1] if exact else bands(first)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches):
            out: dict[str, list] = {"doc_id": [], "h": [], "node": [], "f": [], "n": [], "bands": []}
            for i, h, raw in zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), as_bytes(part.column("text")), strict=True):
                every = hashes(raw, k)
                if len(every):
                    s = np.unique(every)
                    for name, value in zip(out, (i, h, signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)), signed(majority(every)), len(s), keys(s).view(np.int64)), strict=True):
                        out[name].append(value)
            yield out

    return materialise(map_rows(docs, "doc_id long, h long, node long, f long, n long, bands array<long>", task), "simhash-rows")


def sketch(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set begin with each value of some bits: one to two on average, 255 for more than 254."""
    bits = max(3, (len(s) // 2).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def at_most(x: np.ndarray, y: np.ndarray) -> int:
    """What two sets can have in common by their sketches; never too low."""
    x, y = (np.where(v == 255, 1 << 40, v.astype(np.int64)) for v in (x, y))
    small = min(len(x), len(y))
    return int(np.minimum(x.reshape(small, -1).sum(axis=1), y.reshape(small, -1).sum(axis=1)).sum())


def shingle_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, n, sketch and items (the sorted 32-bit hashes of its shingles) for each of ``nodes``; written.

    The one time that texts move: those of ``nodes`` are picked out by the hash of the text.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for part in slices(batches):
            found = [np.unique(hashes(raw, k)) for raw in as_bytes(part.column("text"))]
            items = [np.unique(s.astype(np.uint32)) for s in found]
            yield {"node": part.column("node"), "n": [len(s) for s in items], "sketch": [sketch(s).tobytes() for s in found], "items": [s.astype("<u4").tobytes() for s in items]}

    wanted = rows.join(nodes, "node").groupBy("node").agg(F.min("h").alias("t")).groupBy("t").agg(F.min("node").alias("node"))
    texts = docs.join(wanted, docs["h"] == wanted["t"]).select("node", "text")
    return materialise(map_rows(texts, "node long, n long, sketch binary, items binary", task).dropDuplicates(["node"]), "simhash-sets")


def alike(sketches: list[np.ndarray], sizes: np.ndarray, apart: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Pairs of places (x, y) that ``apart`` allows and whose sketches do not refuse ``least``, with what they can have in common at most."""
    found = []
    width = np.array([len(x) for x in sketches])
    low = np.minimum(sizes[:, None], sizes[None, :]) >= least * np.maximum(sizes[:, None], sizes[None, :]) - 1
    open_ = np.triu(apart & low, 1)
    open_ = open_ | open_.T
    for w in np.unique(width):
        folded = np.array([np.where(x == 255, 1 << 40, x.astype(np.int64)).reshape(w, -1).sum(axis=1) if len(x) >= w else np.zeros(w, np.int64) for x in sketches])
        for x in np.flatnonzero(width == w):
            y = np.flatnonzero(open_[x] & ((width > w) | ((width == w) & (np.arange(len(width)) > x))))
            if len(y):
                both = np.minimum(np.minimum(folded[x], folded[y]).sum(axis=1), np.minimum(sizes[x], sizes[y]))
                good = both >= np.ceil(least * (sizes[x] + sizes[y] - both) - 1e-6)
                found += [(int(x), int(i), int(n)) for i, n in zip(y[good], both[good], strict=True)]
    return found


def spanning(pairs: list[tuple[int, int, int]], node: list[int]) -> list[tuple[int, int, int]]:
    """A forest of the pairs, the likeliest first; ties by the nodes, so that groups with the same sets choose the same pairs."""
    top, kept = list(range(len(node))), []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y, both in sorted(pairs, key=lambda p: (-p[2], *sorted((node[p[0]], node[p[1]])))):
        if root(x) != root(y):
            top[root(x)] = root(y)
            kept.append((x, y, both))
    return kept


def stars(now: DataFrame, round_: int, pairs: int = 2) -> DataFrame:
    """Pairs (a < b) of nodes of different components: each node with the hubs of its most crowded bands, ``pairs`` at most.

    ``now`` has node, c and band; a band's hub is the node that comes first by a hash of this round. So there are no
    more pairs than nodes times ``pairs``, however large a group of copies is, and most of it is linked before anything else
    is compared.
    """
    order = F.struct(F.xxhash64("node", F.lit(round_)).alias("o"), "node", "c")
    hubs = now.groupBy("band").agg(F.count("*").alias("m"), F.min(order).alias("hub"))
    met = now.join(hubs, "band").where(F.col("c") != F.col("hub.c")).select("node", F.col("hub.node").alias("hub"), "m")
    best = met.groupBy("node", "hub").agg(F.max("m").alias("m")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("m", "hub")), False).alias("l"))  # a list of the bands of one set
    return ordered(best.select("node", F.explode(F.slice("l", 1, pairs)).alias("x")).select(F.col("node").alias("a"), F.col("x.hub").alias("b")))


def candidates(now: DataFrame, sets: DataFrame, least: float, forest: bool, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a < b) of nodes of different components that share a band and that their sketches do not refuse.

    ``now`` has node, c and band. Sets of a band's largest component never meet each other. They and the others are dealt
    into blocks of about ``bucket``; each block of others meets each block of the band, itself included, in one place. So a band of
    one large component and a few others makes rows in proportion to its sets. What leaves a place are not its pairs
    but those that pass, or a ``forest`` of them.
    """
    parts = now.groupBy("band", "c").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("band").agg(F.sum("n").alias("m"), F.max(F.struct("n", "c")).alias("top"))
    sizes = sizes.select("band", F.col("top.c").alias("largest"), F.ceil(F.col("top.n") / bucket).cast("int").alias("t"), F.ceil((F.col("m") - F.col("top.n")) / bucket).cast("int").alias("u")).where("u > 0")
    rows = now.join(sets.select("node", F.col("n").alias("size"), "sketch"), "node").join(sizes, "band").withColumn("in_largest", F.col("c") == F.col("largest"))
    own = F.when(F.col("in_largest"), F.pmod(F.xxhash64("node"), F.col("t"))).otherwise(F.col("t") + F.pmod(F.xxhash64("node"), F.col("u"))).cast("int")
    met = F.sequence(F.when(F.col("in_largest"), F.col("t")).otherwise(0), F.col("t") + F.col("u") - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(met))
    rows = rows.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c", "size", "sketch")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held: list[dict] = []

        def compared() -> dict[str, list]:
            node, c, own = (np.array([r[k] for r in held]) for k in ("node", "c", "own"))
            apart = c[:, None] != c[None, :]
            if held[0]["i"] != held[0]["j"]:
                apart &= own[:, None] != own[None, :]
            pairs = alike([np.frombuffer(r["sketch"], np.uint8) for r in held], np.array([r["size"] for r in held]), apart, least)
            pairs = spanning(pairs, node.tolist()) if forest else pairs
            x, y = node[[p[0] for p in pairs]], node[[p[1] for p in pairs]]
            return {"a": np.minimum(x, y).tolist(), "b": np.maximum(x, y).tolist()}

        for batch in slices(batches, "sketch"):
            for r in batch.to_pylist():
                if held and any(r[k] != held[0][k] for k in ("band", "i", "j")):
                    if len(held) > 1:
                        yield compared()
                    held = []
                held.append(r)
        if len(held) > 1:
            yield compared()

    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return map_rows(dealt, "a long, b long", task).distinct()


def similar(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) whose sets have a Jaccard similarity of ``least``: first by sketches, which refuse no such pair, then by the sets."""

    def with_sets(pairs: DataFrame, column: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(f"of_{side}")), side)
        return pairs.select("a", "b", "n_a", "n_b", "of_a", "of_b")

    def task(kind: type, common):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
            for part in slices(batches, "of_a"):
                out: dict[str, list] = {"a": [], "b": []}
                for a, b, m, n, x, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    both = common(np.frombuffer(x, kind), np.frombuffer(y, kind))
                    if both >= shared(least * (m + n - both)):
                        out["a"].append(a)
                        out["b"].append(b)
                yield out

        return run

    pairs = map_rows(with_sets(pairs, "sketch"), "a long, b long", task(np.uint8, at_most))
    in_common = lambda x, y: len(np.intersect1d(x, y, assume_unique=True))
    return materialise(map_rows(with_sets(materialise(pairs, "simhash-passed"), "items"), "a long, b long", task("<u4", in_common)), "simhash-verified")


def by_fingerprint(rows: DataFrame, covered: int, radius: int) -> DataFrame:
    """Candidates (a, b) by SimHash: nodes of one fingerprint, and those of fingerprints that a bucket's forest links."""
    distinct = materialise(rows.select("f").distinct(), "simhash-distinct")
    edges = links(distinct, plan(distinct, covered + 1, covered), covered + 1, radius)
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hubs = materialise(rows.groupBy("f").agg(F.min("node").alias("hub")), "simhash-hubs")
    equal = rows.join(hubs, "f").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = edges.join(hubs.select(F.col("f").alias("a"), F.col("hub").alias("x")), "a").join(hubs.select(F.col("f").alias("b"), F.col("hub").alias("y")), "b").select("x", "y")
    return ordered(equal.union(near))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with c, the component of their node by ``labels`` (node, component)."""
    linked = labels.select(F.col("node").alias("linked"), "component")
    return rows.join(linked, F.col("node") == F.col("linked"), "left").withColumn("c", F.coalesce("component", "node")).drop("linked", "component")


def groups(docs: DataFrame, rows: DataFrame, k: int, least: float, covered: int, radius: int) -> DataFrame:
    """``rows`` with c, the component of their node in the graph of the pairs found with a Jaccard similarity of ``least``.

    Candidates come by SimHash, then from the bands of rare shingles that still join several components: first each set
    with the hubs of its most crowded bands, so that large groups become one component by as many pairs as they have
    members, then a forest of each band, then every pair that is still in two components. Each is verified on the sets of
    shingles, and no candidate link is left out because of another one that was rejected.
    """
    tried = materialise(by_fingerprint(rows, covered, radius), "simhash-pairs")
    entries = rows.select("node", F.explode("bands").alias("band"))
    several = entries.groupBy("band").count().where("count > 1").select("band")
    entries = materialise(entries.join(several, "band").distinct(), "simhash-shared")
    nodes = tried.select(F.col("a").alias("node")).union(tried.select("b")).union(entries.select("node")).distinct()
    nodes = materialise(nodes, "simhash-nodes")
    sets = shingle_sets(docs, rows, nodes, k)
    first = similar(sets, tried, least)
    labels = materialise(components(first), "labels")
    discard(nodes, first)

    def crossing() -> DataFrame:
        """Entries of bands that stand in two components; the others are done with."""
        nonlocal entries
        now = materialise(placed(entries, labels), "simhash-placed")
        split = now.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("band")
        out = materialise(now.join(split, "band"), "simhash-crossing")
        discard(now, entries)
        entries = out
        return out

    rounds = [lambda now, i=i: stars(now, i) for i in range(STARS)] + [lambda now, f=f: candidates(now, sets, least, f) for f in (True, False)]
    for met in rounds:
        now = crossing()
        entries = now.select("node", "band")
        entries.written_to = now.written_to
        new = materialise(met(now).join(tried, ["a", "b"], "left_anti"), "simhash-pairs")
        if new.isEmpty():
            continue
        links = similar(sets, new, least)
        before, labels = labels, widened(labels, links)
        last, tried = tried, materialise(tried.unionByName(new), "simhash-pairs")
        discard(before, links, last, new)
    out = placed(rows, labels)
    discard(sets, tried, entries)
    return out


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, covered: int = LINK, radius: int = 10, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of near duplicates.

    Near duplicates are texts whose sets of five-word shingles have a Jaccard similarity of ``least``, and groups are the
    components of such pairs. SimHash (probes that cover ``covered`` differing bits, candidates within ``radius`` bits)
    finds the closest of them, bands of rare shingles the others; each link is verified on the sets. Of two texts that
    have exactly ``least`` in common, bands miss one pair in 600 at the worst (one text is a part of the other and all
    that differs is rare), one in millions elsewhere, at every size of the table. With ``exact`` none is missed: a prefix filter takes the
    place of the bands, at more candidates where single rare shingles coincide.
    Of a group the row with the smallest doc_id stays (of rows tied in doc_id, or of rows without a doc_id, any one);
    texts without words are no near duplicates and all stay.
    """
    named = columns(docs, doc_id="doc_id", text="text").withColumn("h", F.xxhash64("text"))
    rows = summaries(named, shingle, least, exact)
    ids = materialise(groups(named, rows, shingle, least, covered, radius).select("doc_id", "h", "c"), "simhash-classes")
    discard(rows)
    best = ids.groupBy("c").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))
    gone = ids.join(best, "c").where(~stays).select(F.col("doc_id").alias("i"), F.col("h").alias("t")).distinct()
    tied = ids.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("i"), F.col("h").alias("t"))
    gone, tied = materialise(gone, "simhash-gone"), materialise(tied, "simhash-tied")
    here = carried(docs, id=docs["doc_id"], h=F.xxhash64(docs["text"]))
    of = lambda other: here["id"].eqNullSafe(other["i"]) & (here["h"] == other["t"])
    kept = here.join(gone, of(gone), "left_anti")
    if not tied.isEmpty():
        again = kept.join(tied, of(tied), "left_semi").dropDuplicates(["id", "h"])
        kept = kept.join(tied, of(tied), "left_anti").unionByName(again)
    return unpacked(kept, docs)
