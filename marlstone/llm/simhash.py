"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: one pass over whole texts in Arrow batches; words and shingles are cut from the UTF-8 bytes and
hashed with XXH64, bit counts are taken by numpy. Equal fingerprints are one node (its smallest id) before
anything is compared.

Candidates: the 64 bits are cut into 4 bands; fingerprints that differ in r <= 2 bits agree in two bands at
least, so each is dealt to the 6 pairs of bands and every link meets in one of them. A group of more than
`hot` fingerprints is dealt again by each choice of 6 of its 8 remaining 4-bit bands, as 2 differing bits
leave 6 alone; a part holds 256 fingerprints at most. So no task gathers an unbounded group, and no pair of rows is made.

Comparison: a task's groups lie back to back in one array whose bits are stored as vertical planes, 64 rows to
a word. For each lag, all rows are compared with the row that far down: the XOR of plane and shifted plane goes
into carry-save counters, and a word is abandoned once none of its rows can stay within the radius (or shares
a group). What comes out is a star for each component inside a group, so output is linear in the rows.

Links become components by graph.components. Style: free (mapInArrow and numpy).

Defined results: null and empty texts have fingerprint zero and link like any other; null ids link with
nothing and are their own component (null); repeated rows are repeated in the result; an empty table gives an
empty result; other columns are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import dropped, row_keys, small_batches, table, written
from marlstone.llm.graph import components

SEED = 42
SHINGLE = 3
RADIUS = 2
HOT = 2048
WORDS = 16
SIMILARITY = 0.8
STAGE_SHINGLE = 5
KEYS = 8
KEPT = 4  # times KEYS
CHUNK = 2048
ROUNDS = 3


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the text, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(g, seed) for g in grams), np.uint64)


def bit_majority(words: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words, the bits that are set in over half the rows, as words."""
    n, w = words.shape
    counts = np.zeros(64 * w, np.int64)
    for i in range(0, n, 255):  # so many fit an 8-bit sum
        raw = np.ascontiguousarray(words[i : i + 255]).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8 * w)
        counts += np.add.reduce(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8") if n else np.zeros(w, np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    return int(bit_majority(hashes[:, None])[0])


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """So many 64-bit words for each hash, each from a mix of the hash and the word's number."""
    return mixed(hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mixed(z: np.ndarray) -> np.ndarray:
    """Each word's bits mixed, in place."""
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(shingle_hashes(t.as_py(), width)) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes_of(codes: np.ndarray) -> np.ndarray:
    """Vertical bits of rows of 64-bit words: bit r of plane p is bit p of row r. One spare word at the end."""
    n, w = codes.shape
    words = (n + 63) // 64 + 1
    out = np.zeros((64 * w, words), np.uint64)
    wide = np.zeros(words * 64, np.uint64)
    for k in range(w):
        wide[:n] = codes[:, k]
        for p in range(64):
            out[64 * k + p] = np.packbits(((wide >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray):
    """Carry-save adder: sum and carry of three bits."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits whose counter (lowest bit first) exceeds radius."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


def within_radius(planes: np.ndarray, at: np.ndarray, lag: np.ndarray, alive: np.ndarray, radius: int):
    """(rows, lags) of pairs of rows, i and i + lag, that differ in `radius` bits or fewer.

    An element is a word of 64 pairs: rows 64 * at + b against those `lag` further down, for the bits b of
    `alive`. Eight planes at a time go through a tree of carry-save adders into the vertical counters; elements
    whose pairs all exceed the radius are abandoned."""
    last = planes.shape[1] - 1
    counters = [np.zeros(len(at), np.uint64) for _ in range(len(planes).bit_length())]
    for p in range(0, len(planes), 8):
        if not len(at):
            break
        if p == 0 or moved:
            down, r = np.minimum(at + lag // 64, last), (lag % 64).astype(np.uint64)
            next_, up = np.minimum(down + 1, last), np.uint64(63) - r
        d = [x[at] ^ ((x[down] >> r) | (x[next_] << np.uint64(1) << up)) for x in planes[p : p + 8]]
        ones, twos, fours, *rest = counters
        ones, t0 = _add(ones, d[0], d[1])
        ones, t1 = _add(ones, d[2], d[3])
        twos, f0 = _add(twos, t0, t1)
        ones, t0 = _add(ones, d[4], d[5])
        ones, t1 = _add(ones, d[6], d[7])
        twos, f1 = _add(twos, t0, t1)
        fours, carry = _add(fours, f0, f1)
        for k, x in enumerate(rest):
            rest[k], carry = x ^ carry, x & carry
        counters = [ones, twos, fours, *rest]
        alive = alive & ~_over(counters, radius)
        live = alive != 0
        moved = np.count_nonzero(live) < 0.75 * len(live)
        if moved:
            at, lag, alive = at[live], lag[live], alive[live]
            counters = [c[live] for c in counters]
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    e, b = np.nonzero(bits)
    return at[e] * 64 + b, lag[e]


def linked(codes: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """root[i]: the first row of i's component among the rows of its group (rows of a group lie together)."""
    codes = codes.reshape(len(codes), -1)
    n = len(codes)
    root = np.arange(n)
    if n < 2:
        return root
    cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    sizes = np.diff(cuts)
    end = np.repeat(cuts[1:], sizes)
    _lags(codes, end, root, 1, min(64, int(sizes.max())), radius)
    for k in np.flatnonzero(sizes > 64):  # larger lags concern these groups alone
        own = slice(cuts[k], cuts[k + 1])
        part = root[own] - cuts[k]
        _lags(codes[own], end[own] - cuts[k], part, 64, int(sizes[k]), radius)
        root[own] = part + cuts[k]
    return root


def _lags(codes: np.ndarray, end: np.ndarray, root: np.ndarray, low: int, high: int, radius: int, elements: int = 1 << 14) -> None:
    """Compare every row with those low .. high - 1 rows further down in its group."""
    if low >= high:
        return
    n, planes = len(codes), planes_of(codes)
    pad = np.zeros(planes.shape[1] * 64 - n, np.uint8)
    rows = np.arange(n)
    held, many = [], 0
    for lag in range(low, high):
        same = np.packbits(np.concatenate(((rows + lag < end).astype(np.uint8), pad)), bitorder="little").view(np.uint64)
        at = np.flatnonzero(same)
        held.append((at, np.full(len(at), lag), same[at]))
        many += len(at)
        if many >= elements or lag == high - 1:
            i, by = within_radius(planes, *map(np.concatenate, zip(*held)), radius)
            if len(i):
                hook(root, i, i + by)
            held, many = [], 0


def hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of rows i[k] and j[k], in place, and flatten."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _compare(radius: int):
    """Streams rows (key, fp, node) sorted by key; gives links (a, b) of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def links(key, fp, node):
            root = linked(fp.view(np.uint64), key, radius)
            far = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)]
            if len(held[0]) < 50_000:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if cut:
                yield links(*(h[:cut] for h in held))
                held = [h[cut:].copy() for h in held]
        if len(held[0]):
            yield links(*held)

    return run


def _band(value: str, k: int, width: int):
    return F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _bands(width: int, take: int, value: str, bits: int = 64):
    """Columns of keys: each choice of `take` of the bands of `width` bits, numbered above the bits taken."""
    keys = []
    for c, chosen in enumerate(combinations(range(bits // width), take)):
        key = F.lit(c).cast("long")
        for k in chosen:
            key = F.shiftleft(key, width).bitwiseOR(_band(value, k, width))
        keys.append(key)
    return keys


def near_links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect all of `nodes` (node, fp; fp unique) within 2 differing bits."""
    dealt = nodes.select(F.explode(F.array(*_bands(16, 2, "fp"))).alias("key"), "fp", "node")
    many = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = written(many, "bands")
    some = dealt.join(many, "key")
    few = some.filter(F.col("n") <= hot).select("key", "fp", "node")
    out = few.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(RADIUS), "a long, b long")
    if many.filter(F.col("n") > hot).isEmpty():
        return out
    # each key leaves 32 bits, or 8 bands of 4, of which 2 differing bits leave 6 alone
    pairs = list(combinations(range(4), 2))
    rest = F.lit(None).cast("long")
    for c, chosen in enumerate(pairs):
        x, y = (k for k in range(4) if k not in chosen)
        both = F.shiftleft(_band("fp", x, 16), 16).bitwiseOR(_band("fp", y, 16))
        rest = F.when(F.shiftright("key", 32) == c, both).otherwise(rest)
    parts = some.filter(F.col("n") > hot).withColumn("rest", rest)
    parts = parts.select(F.explode(F.array(*_bands(4, 6, "rest", 32))).alias("part"), "key", "fp", "node")
    fine = parts.select(F.xxhash64("key", "part").alias("key"), "fp", "node")
    return out.unionByName(fine.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(RADIUS), "a long, b long"))


def clusters(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for rows (doc_id, fp): smallest doc_id reachable over links of 2 bits or fewer."""
    prints = written(prints, "fingerprints")
    nodes = written(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(near_links(nodes))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def radius_of(similarity: float, bits: int) -> int:
    """Bits by which sets of that Jaccard similarity differ, and four standard deviations.

    Small sets differ in more bits than large ones, as an even count needs more than its half: at 0.8 the worst are
    4 of 5 shingles, in 0.1875 of the bits."""
    p = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, 0.1875)
    return int(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def prefix(n: int, similarity: float) -> int:
    """Of two sets that are so much alike, so many smallest members (n: the set's size) share one."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def set_hashes(text: str | None, width: int) -> np.ndarray:
    """Of the text's distinct shingles, sorted. Each word is hashed once; a shingle's hash is made of its words'."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    z = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        z = z * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(z)]
    return np.unique(mixed(z))


def set_name(hashes: np.ndarray) -> int:
    """A signed long that stands for the set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def wide_fingerprints(docs: DataFrame, width: int, words: int, kept: int, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 (the row's keys), doc_id, node (its shingle set), size, fp (words as bytes), keys (the `kept` smallest shingle
    hashes) from each text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, fps, ks = [], [], [], []
            for t in b.column(3):
                h = set_hashes(t.as_py(), width)
                names.append(set_name(h))
                sizes.append(len(h))
                fps.append(bit_majority(widened(h, words)).tobytes())
                ks.append(h[:kept].view(np.int64).tolist())
            made = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(ks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["k1", "k2", "doc_id", "node", "size", "fp", "keys"])

    small_batches(docs.sparkSession)
    rows = docs.select(*row_keys(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "k1 string, k2 long, doc_id long, node long, size long, fp binary, keys array<long>")


def named_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, hashes (sorted, as bytes) of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [set_hashes(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes binary")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is that or more."""
    total = len(a) + len(b)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) * (1 + similarity) >= similarity * total - 1e-9


def shared(sets: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """For i < j, at (i, j) how many members sets i and j share. A member of few sets counts for their pairs, a member of many is a
    column of a 0/1 matrix, which is multiplied by its transpose."""
    n = len(sets)
    values, own = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, own = values[order], own[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    counts = np.diff(np.append(starts, len(values)))
    out, few = np.zeros((n, n)), max(8, n // 8)
    for c in np.unique(counts[(counts > 1) & (counts <= few)]).tolist():
        of, (i, j) = own[starts[counts == c][:, None] + np.arange(c)], np.triu_indices(c, 1)
        step = max(1, (1 << 21) // len(i))
        for k in range(0, len(of), step):
            pairs = of[k : k + step, i] * n + of[k : k + step, j]
            np.add.at(out.reshape(-1), pairs.ravel(), 1.0)
    many = np.flatnonzero(counts > few)
    for k in range(0, len(many), columns):
        block = many[k : k + columns]
        at = np.repeat(np.arange(len(block)), counts[block])
        rows = own[np.repeat(starts[block] - np.cumsum(counts[block]) + counts[block], counts[block]) + np.arange(len(at))]
        x = np.zeros((n, len(block)), np.float32)
        x[rows, at] = 1
        out += x @ x.T
    return out


def verified(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """root[i]: the first set of i's component by pairs that are alike."""
    root = np.arange(len(sets))
    if len(sets) == 2:
        return root * (not alike(*sets, similarity))
    sizes = np.array([len(x) for x in sets])
    i, j = np.nonzero(np.triu(shared(sets) * (1 + similarity) >= similarity * (sizes[:, None] + sizes) - 1e-9, 1))
    hook(root, i, j)
    return root


def _verify(similarity: float):
    """Streams rows (key, hashes, node) sorted by key; gives links (a, b) of nodes that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = {}, None

        def links():
            nodes = np.array(list(held), np.int64)
            root = verified(list(held.values()), similarity)
            far = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])

        for b in batches:
            for key, raw, node in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    if len(held) > 1:
                        yield links()
                    held, at = {}, key
                held[node] = np.frombuffer(raw, np.uint64)
        if len(held) > 1:
            yield links()

    return run


def _candidates(radius: int):
    """Streams rows (key, i, j, fp, node) sorted by the first three. Of the rows that agree in those, gives the nodes of each
    component by fingerprints within the radius, named by a hash of its members: (name, node). The same component under
    several keys has one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, node = np.zeros((0, 3), np.int64), None, np.zeros(0, np.int64)

        def found(k, f, n):
            groups = np.concatenate(([0], np.cumsum((k[1:] != k[:-1]).any(axis=1))))
            root = linked(f, groups, radius)
            some = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
            order = some[np.lexsort((n[some], root[some]))]
            cuts = np.flatnonzero(np.concatenate(([True], root[order][1:] != root[order][:-1], [True]))) if len(order) else np.zeros(1, int)
            members = n[order]
            names = [set_name(members[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), np.diff(cuts))), pa.array(members)], names=["name", "node"])

        for b in batches:
            new = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u8").reshape(b.num_rows, -1)
            key = np.concatenate((key, np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)))
            fp = new if fp is None else np.concatenate((fp, new))
            node = np.concatenate((node, b.column(4).to_numpy()))
            if len(key) < 20_000:
                continue
            cut = int(np.argmax((key == key[-1]).all(axis=1)))  # the last group may go on
            if cut:
                yield found(key[:cut], fp[:cut], node[:cut])
                key, fp, node = key[cut:].copy(), fp[cut:].copy(), node[cut:].copy()
        if len(key):
            yield found(key, fp, node)

    return run


def exact_links(met: DataFrame, prints: DataFrame, sets_of, similarity: float, radius: int, chunk: int) -> DataFrame:
    """Links (a, b) that connect all nodes that share a key and are alike.

    met: key, node, w; prints: node, fp; sets_of(nodes): node, hashes of those nodes. Nodes of a key are compared by
    fingerprints, and within each component that those make, sets are compared exactly. A key whose nodes weigh over `chunk` is
    dealt in parts of half as much. Each part is compared by itself first; of a large group of near copies nearly all are then
    in one component. Only nodes outside the key's largest component meet all other parts: pairs inside that component need
    no look, so the work is linear in the largest component's nodes."""
    find, zero = _candidates(radius), F.lit(0).cast("long")
    sizes = written(met.groupBy("key").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"), "sizes")
    c = F.when(F.col("n") > chunk, F.ceil(F.col("n") / (chunk / 2))).otherwise(1).cast("long")
    dealt = written(met.join(sizes, "key").withColumn("c", c).withColumn("i", F.pmod(F.xxhash64("node"), "c")).drop("n"), "dealt")

    def candidates(parts: DataFrame) -> DataFrame:
        parts = parts.join(prints, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return written(parts.select("key", "i", "j", "fp", "node").mapInArrow(find, "name long, node long").distinct(), "candidates")

    def compared(found: DataFrame) -> DataFrame:
        rows = found.join(sets, "node").repartition("name").sortWithinPartitions("name").select("name", "hashes", "node")
        links = written(rows.mapInArrow(_verify(similarity), "a long, b long"), "links")
        dropped(found)
        return links

    found, hot = candidates(dealt.select("key", "i", zero.alias("j"), "node")), dealt.filter("c > 1")
    # texts are read once: for what was found, and for what may be found yet
    sets = written(sets_of(found.select("node").union(hot.select("node")).distinct()), "sets")
    inner = compared(found)
    if hot.isEmpty():
        dropped(sizes, dealt, sets)
        return inner
    placed = hot.join(components(inner), "node", "left").select("key", "node", "w", F.coalesce("root", "node").alias("root"))
    counts = placed.groupBy("key", "root").agg(F.sum("w").alias("m"))
    largest = counts.groupBy("key").agg(F.max(F.struct("m", "root")).alias("x"), F.sum("m").alias("n"))
    parts = F.ceil((F.col("n") - F.col("x.m")) / (chunk / 2)).cast("long")
    largest = largest.filter("x.m < n").select("key", F.col("x.root").alias("largest"), parts.alias("parts"))
    rest = written(placed.join(largest, "key").filter("root <> largest").select("key", "node", "parts"), "rest")
    upto = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    all_ = hot.join(rest.select("key", "parts").distinct(), "key").withColumn("j", upto("parts"))
    few = hot.drop("i").join(rest, ["key", "node"]).withColumn("j", F.pmod(F.xxhash64("node", F.lit("rest")), "parts")).withColumn("i", upto("c"))
    both = all_.select("key", "i", "j", "node").unionByName(few.select("key", "i", "j", "node")).distinct()
    across = compared(candidates(both))
    dropped(sizes, dealt, rest, sets)
    return inner.unionByName(across)


def by_rarity(docs: DataFrame, width: int, similarity: float, keys: int, common: np.ndarray) -> DataFrame:
    """node, own (keys) of docs (text). Shingles that are common come last. So many keys that two sets that are alike share none
    with a chance of (1 - similarity) ** keys at most, or else the whole prefix."""

    def chosen(h: np.ndarray) -> np.ndarray:
        last = np.isin(h.view(np.int64), common)
        rare, most = len(h) - int(last.sum()), prefix(len(h), similarity)
        apart = (1 - similarity) * len(h) / max(rare, 1)  # of the rare ones, at most so many are in one set only
        n = math.ceil(keys * math.log(1 - similarity) / math.log(apart)) if 0 < apart < 1 else most
        return np.concatenate((h[~last], h[last]))[: n if n <= min(rare, most) else most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [set_hashes(t.as_py(), width) for t in b.column(0)]
            own = pa.array([chosen(h).view(np.int64).tolist() for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([set_name(h) for h in sets], pa.int64()), own], names=["node", "own"])

    return docs.mapInArrow(run, "node long, own array<long>")


def dealt_by_rarity(nodes: DataFrame, similarity: float, keys: int, chunk: int, texts_of, width: int) -> tuple[DataFrame, DataFrame]:
    """(dealt, many). dealt: key, node, size, w of each key of each node; many: key, n of those that weigh n and have several nodes.

    nodes: node, size, w, keys (the smallest hashes, KEPT times as many as are dealt). A node's keys are its smallest hashes. A
    shingle of otherwise unlike texts (a line that many have) would bring all of them together, and every pair of them would have to be
    compared. So where that would deal more rows than a quarter of the nodes, keys that weigh over `chunk` are put last in the order of
    all sets, and nodes that had one take the next ones, twice as many, since common shingles leave fewer to tell texts apart. (1 - similarity) ** keys remains the chance that two
    sets that are alike don't meet, while half of the kept hashes are rare; nodes with fewer have their text read again. Keys whose nodes
    mostly share half of their keys with such groups are left: those are near copies, which exact_links compares in linear time.
    What weighs over `chunk` in the end also goes there."""
    most = (F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1).cast("int")
    first = F.slice("keys", 1, F.least(F.lit(keys), most))
    held, common, kept = nodes.select("node", "size", "w", first.alias("own"), F.lit(False).alias("late"), F.lit(False).alias("short")), None, KEPT * keys

    def counted(held: DataFrame) -> tuple[DataFrame, DataFrame]:
        dealt = held.select(F.explode("own").alias("key"), "node", "size", "w", F.size("own").alias("k"))
        return dealt, written(dealt.groupBy("key").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"), "keys")

    dealt, many = counted(held)
    all_ = nodes.count()
    for _ in range(ROUNDS):
        hot = many.filter(F.col("n") > chunk)
        if common is not None:
            hot = hot.join(common, "key", "left_anti")
        if hot.isEmpty():
            break
        met = dealt.join(hot, "key").select("key", "node", "k", "n")
        copies = met.groupBy("node").agg(F.count(F.lit(1)).alias("h"))
        copy = (F.col("h") >= F.lit(keys / 2)) & (2 * F.col("h") >= F.col("k"))
        votes = met.join(copies, "node").groupBy("key").agg(F.avg(copy.cast("double")).alias("copies"), F.first("n").alias("n"))
        found = written(votes.filter("copies < 0.5").select("key", "n"), "common")
        if (found.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0) / (chunk / 2) <= all_ / 4:
            break
        found = found.select("key")
        common = found if common is None else found.union(common)
        late = held.filter("late").select("node").union(dealt.join(common, "key", "left_semi").select("node")).distinct()
        last = nodes.join(late, "node", "left_semi").select("node", F.explode("keys").alias("key")).join(common, "key", "left_semi")
        last = last.groupBy("node").agg(F.collect_list("key").alias("last"))
        is_last = lambda x: F.array_contains("last", x)
        both = nodes.join(last, "node", "left").withColumn("rare", F.filter("keys", lambda x: ~is_last(x))).withColumn("need", F.least(F.lit(2 * keys), most))
        late, lacks = F.col("last").isNotNull(), F.size("rare") < F.col("need")
        own = F.when(~late, first).when(lacks & (F.col("size") <= kept), F.slice(F.concat("rare", F.filter("keys", is_last)), 1, F.col("need"))).otherwise(F.slice("rare", 1, F.col("need")))
        held = written(both.select("node", "size", "w", own.alias("own"), late.alias("late"), (late & lacks & (F.col("size") > kept)).alias("short")), "held")
        dropped(many)
        dealt, many = counted(held)
    short = held.filter("short").select("node")
    if common is not None and not short.isEmpty():
        last = np.sort(np.array([r.key for r in common.collect()], np.int64))  # at most one for each `chunk` of the keys
        again = by_rarity(texts_of(short), width, similarity, keys, last).dropDuplicates(["node"])
        held = held.drop("own").join(again, "node").unionByName(held.filter("not short"))
        dropped(many)
        dealt, many = counted(written(held, "held"))
    return dealt.drop("k"), many


def grouped(docs: DataFrame, similarity: float, width: int, words: int, keys: int, chunk: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: k1, k2, doc_id, node of each row of docs; groups: node and first, the row that is kept of the
    component that the node is in, as a struct (none, doc_id, k2, k1)."""
    prints = written(wide_fingerprints(docs, width, words, KEPT * keys, id_col, text_col), "wide")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k2", "k1")).alias("own")
    nodes = written(prints.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), own), "wide-nodes")
    weight = F.greatest(F.lit(1), F.col("size") / 1024).cast("long")  # of 8 kB of hashes

    def texts_of(some: DataFrame) -> DataFrame:
        """One row of each node brings its text."""
        chosen = nodes.join(some, "node", "left_semi").select(F.col("own.k1").alias("__k1"), F.col("own.k2").alias("__k2"))
        k1, k2 = row_keys(id_col, text_col)
        # a merge join whatever the sizes: what is chosen grows with the input
        return docs.select(k1.alias("__k1"), k2.alias("__k2"), F.col(text_col).alias("text")).join(chosen.hint("merge"), ["__k1", "__k2"], "left_semi").select("text")

    dealt, many = dealt_by_rarity(nodes.select("node", "size", weight.alias("w"), "keys"), similarity, keys, chunk, texts_of, width)
    # sets that are so much alike have sizes in one step of a ladder or in two that adjoin: that splits frequent keys
    step = F.floor(F.log(F.greatest("size", F.lit(1))) / -math.log(similarity) + 1e-9)
    meeting = F.when(F.col("n") > chunk, F.array(F.xxhash64("key", step), F.xxhash64("key", step + 1))).otherwise(F.array("key"))
    met = dealt.join(many, "key").select(F.explode(meeting).alias("key"), "node", "w")

    def sets_of(some: DataFrame) -> DataFrame:
        return named_sets(texts_of(some), width).groupBy("node").agg(F.first("hashes").alias("hashes"))

    links = exact_links(met, nodes.select("node", "fp"), sets_of, similarity, radius_of(similarity, 64 * words), chunk)
    roots = nodes.select("node", "own").join(components(links), "node", "left").select("node", "own", F.coalesce("root", "node").alias("root"))
    first = roots.groupBy("root").agg(F.min("own").alias("first"))
    out = written(roots.join(first, "root").select("node", "first"), "components")
    dropped(nodes, many)
    return prints.select("k1", "k2", "doc_id", "node"), out


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, width: int = STAGE_SHINGLE, words: int = WORDS, keys: int = KEYS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, component_id (the smallest id there, null if none has one): documents whose shingle sets are `similarity`
    alike or more, and what they reach. Rows without an id are documents like others.

    Fingerprints of 64 * words bits, with four standard deviations to spare, find groups of documents that may be alike;
    in each group the links are pairs whose exact Jaccard similarity is enough. Documents meet if they share one of their
    `keys` smallest shingle hashes: for sets of up to 39 shingles all that are 0.8 alike do, of larger ones all but about
    0.2 ** keys. Keys of over `chunk` different sets are dealt in parts (exact_links)."""
    rows, groups = grouped(docs, similarity, width, words, keys, chunk, id_col, text_col)
    return rows.join(groups, "node").select("doc_id", F.col("first.doc_id").alias("component_id"))


def deduplicated(
    docs: DataFrame, similarity: float = SIMILARITY, width: int = STAGE_SHINGLE, words: int = WORDS, keys: int = KEYS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest id, rows without an id last.

    Rows are told apart by id and text. Where the kept row is repeated with the same id and text, one of them stays, whatever
    its other columns."""
    rows, groups = grouped(docs, similarity, width, words, keys, chunk, id_col, text_col)
    per = rows.groupBy("k1", "k2", "node").agg(F.count(F.lit(1)).alias("n")).join(groups, "node")
    stays = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    per = per.withColumns({"stays": stays}).filter("not stays or n > 1").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "stays")
    per = written(per, "decided")
    k1, k2 = row_keys(id_col, text_col)
    kept = docs.withColumns({"__k1": k1, "__k2": k2}).join(per.filter("not stays").hint("merge"), ["__k1", "__k2"], "left_anti")
    again = per.filter("stays").drop("stays")
    if not again.isEmpty():
        once = kept.join(again, ["__k1", "__k2"], "left_anti")
        kept = once.unionByName(kept.join(again, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]))
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: fingerprint and component of every document."""
    out = clusters(fingerprints(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
