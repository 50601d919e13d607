"""SimHash near-dedup with a Gray-order hierarchical index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import about, marked, marks, settle, small_batches, unused, whole_groups
from quern.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LEAF, FAN = 16, 8
PAIRS = 2_000_000  # pairs looked at together; bounds the memory of a join, not its result


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a whole text, unsigned; 0 without words.

    A-Z are lower-cased; words are runs without ASCII white space; shingles are space-joined
    and repeats count; a text of fewer words is one shingle. A bit is 1 if it is set in over
    half of the shingles' XXH64.
    """
    parts = text.encode().translate(LOWER).split() if text else []
    n = len(parts) - words + 1
    if not parts:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()
    stops = (ends - 1).tolist()[words - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def each(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, fp long")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each word in the binary-reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _spread(a: np.ndarray, b: np.ndarray, first: np.ndarray, stop: np.ndarray, same_strict: bool):
    """All pairs of children of each pair (a, b) of nodes; of a node with itself each pair once."""
    na, nb = stop[a] - first[a], stop[b] - first[b]
    each = na * nb
    at = np.repeat(np.arange(len(a)), each)
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    i, j = first[a][at] + k // nb[at], first[b][at] + k % nb[at]
    keep = (a != b)[at] | ((i < j) if same_strict else (i <= j))
    return i[keep], j[keep]


def linked(fp: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Component label (smallest row) of each fingerprint under links of at most `most` differing bits
    inside its group. Rows must be sorted by group, then Gray rank.

    Gray order puts words that share bits side by side. Upper nodes keep the bits on which all
    words below agree (mask and value). Two nodes are compared on the bits both share: more than
    `most` differences prune the pair of groups whole; if even all unshared bits could not exceed
    `most`, the groups join whole. Pairs that remain are compared word by word.
    """
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label
    # level 0: runs of LEAF words inside a group
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    first = np.flatnonzero(place % LEAF == 0)
    owner = group[first]
    low, high = np.bitwise_and.reduceat(fp, first), np.bitwise_or.reduceat(fp, first)
    levels = [(first, np.r_[first[1:], n], low, ~(low ^ high), first, np.r_[first[1:], n])]
    while (owner[1:] == owner[:-1]).any():
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
        up = np.flatnonzero(place % FAN == 0)
        low, high = np.bitwise_and.reduceat(low, up), np.bitwise_or.reduceat(high, up)
        row = levels[-1][4][up]
        levels.append((up, np.r_[up[1:], len(owner)], low, ~(low ^ high), row, np.r_[row[1:], n]))
        owner = owner[up]

    def join(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped

    todo = [(len(levels) - 1, np.arange(len(owner)), np.arange(len(owner)))]
    while todo:
        level, a, b = todo.pop()
        if len(a) * FAN * FAN > 4 * PAIRS:
            half = len(a) // 2
            todo += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        first, stop, value, mask, row, end = levels[level]
        both = mask[a] & mask[b]
        gap = np.bitwise_count((value[a] ^ value[b]) & both).astype(np.int64)
        near = gap <= most
        whole = near & (gap + np.bitwise_count(~both) <= most)
        if whole.any():
            for x, y in ((a[whole], b[whole]), (b[whole], a[whole])):
                size = end[y] - row[y]
                k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                join(np.repeat(row[x], size), np.repeat(row[y], size) + k)
        near &= ~whole
        a, b = a[near], b[near]
        if not len(a):
            continue
        # pairs of nodes whose words are all joined already have nothing to add
        if level:
            todo.append((level - 1, *_spread(a, b, first, stop, False)))
            continue
        for at in range(0, len(a), max(1, PAIRS // (LEAF * LEAF))):
            part = slice(at, at + max(1, PAIRS // (LEAF * LEAF)))
            i, j = _spread(a[part], b[part], first, stop, True)
            close = np.bitwise_count(fp[i] ^ fp[j]) <= most
            join(i[close], j[close])
    return label


def _blocks(most: int) -> list[int]:
    """Masks of most + 1 disjoint blocks of bits; words within `most` bits agree on one at least."""
    edges = [round(i * 64 / (most + 1)) for i in range(most + 2)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(mask: int, parts: int) -> list[int]:
    """The bits outside `mask` in `parts` disjoint masks."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cut, cut[1:])]


def keyed(nodes: DataFrame, most: int, large: int) -> DataFrame:
    """(key, fp, node): words within `most` bits meet under one key at least.

    A word goes under each of most + 1 blocks of its bits. Keys with more than `large` words are
    dealt out again by most + 1 parts of the other bits, which loses no pair: words that share a
    block still differ in at most `most` of the rest.
    """
    masks = _blocks(most)
    rows = nodes.select(
        "fp", "node", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for t, m in enumerate(masks)])).alias("k")
    ).select("fp", "node", "k.t", "k.block", F.xxhash64("k.t", "k.block").alias("key"))
    rows = settle(rows)
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("key", F.lit(True).alias("hot"))
    if not hot.head(1):
        return rows.select("key", "fp", "node")
    marked = rows.join(hot, "key", "left")
    inner = F.array(
        *[
            F.when(F.col("t") == t, F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(s))) for s in _split(m, most + 1)]))
            for t, m in enumerate(masks)
        ]
    )
    parts = F.coalesce(*[inner[t] for t in range(len(masks))])
    again = marked.where("hot").select("fp", "node", "key", F.posexplode(parts).alias("s", "part")).select(F.xxhash64("key", "s", "part").alias("key"), "fp", "node")
    return marked.where("hot is null").select("key", "fp", "node").unionByName(again)


def near_edges(nodes: DataFrame, most: int = 4, large: int = 2_000) -> DataFrame:
    """(u, v) links that connect just the nodes whose fingerprints are within `most` bits by steps.

    nodes: (fp, node), fp distinct. Gives one star for each local component of a key, never all pairs.
    """

    def join(batches):
        for rows in whole_groups(batches, "key"):
            key, fp = rows.column("key").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
            node = rows.column("node").to_numpy()
            order = np.lexsort((gray_rank(fp), key))
            key, fp, node = key[order], fp[order], node[order]
            label = linked(fp, key, most)
            i = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[i], pa.int64()), pa.array(node[label[i]], pa.int64())], names=["u", "v"])

    rows = keyed(nodes.where("node is not null"), most, large)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(join, "u long, v long")


def simhash_groups(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, fp (long), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. A null doc_id takes the
    component of its fingerprint. Repeated rows stay. Columns of docs besides doc_id and text are
    not read; an empty table gives an empty result.
    """
    fps = settle(fingerprints(docs, words))
    nodes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(near_edges(nodes, most)).withColumnsRenamed({"node": "n", "component": "c"})
    named = nodes.join(found, nodes.node == found.n, "left").select("fp", F.coalesce("c", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """docs without all but one row of each near-duplicate group; columns as they came.

    The row with the smallest doc_id stays; of several rows with that id, also of different texts,
    one (any). Rows without a doc_id all stay.
    """
    groups = settle(simhash_groups(docs, words, most))
    own = unused(docs, "kept")[0]
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    out = docs.join(kept, docs.doc_id == kept[own], "left_semi")
    if groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").head(1):
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id is null"))


SHARE = (4, 5)  # least Jaccard index of near copies, in whole numbers
RADIUS, FEWEST = 24, 32  # bits in which near copies of FEWEST shingles or more may differ
FEW, TURNS = 32, 2  # sets under one key that are compared each with each at once, and turns with centres for others
PARITY = 1024  # bits of a set's parity sketch
COMPARE = 1000  # sketches that a set is compared with at once, on average


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles of a whole text, in order and with repeats; words are those of `fingerprint`."""
    parts = text.encode().translate(LOWER).split() if text else []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if parts else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends - 1).tolist()[words - 1 :])], dtype=np.uint64)


def _majority(h: np.ndarray) -> int:
    """The SimHash of shingle hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _summary(s: np.ndarray) -> tuple[int, int, int]:
    """(id, size, SimHash) of a set of shingles."""
    return xxhash.xxh64_intdigest(s.tobytes()), len(s), _majority(s) if len(s) else 0


def _parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits, each whether an odd number of shingles fall on it. Two sets' sketches differ in no more bits than the sets in shingles."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many distinct shingles, rare ones first, that sets of an index of SHARE or more have one of them in common.

    Sets must share SHARE of the larger one at least, so less than the rest plus one cannot be all
    that differs. Any order that is one for all texts will do; `common` (sorted) come last.
    """
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, counts[at], 0)))]
    return s[: len(s) - -(-SHARE[0] * len(s) // SHARE[1]) + 1]


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, with counts. They only order prefixes; no result depends on them."""

    def each(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(t, words)).view(np.int64), pa.int64())], names=["h"])

    seen = about(docs.select("doc_id", "text"), 6_000, "doc_id").select("text").mapInArrow(each, "h long").groupBy("h").count()
    got = seen.where("count >= 3").orderBy(F.desc("count"), "h").limit(50_000).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _close(m, x, n, y):
    """Sets of sizes m and n with SimHash words x and y can have the index.

    At an index of 0.8 a bit differs with a chance of 0.15, so more than RADIUS of 64 do for one
    pair in a million; words of fewer shingles scatter more and are not asked.
    """
    sizes = np.minimum(m, n) * SHARE[1] >= np.maximum(m, n) * SHARE[0]
    return sizes & ((np.minimum(m, n) < FEWEST) | (np.bitwise_count(x ^ y) <= RADIUS))


def _close_rows(a: str, b: str) -> Column:
    """`_close` of two rows."""
    sizes = F.least(f"{a}.n", f"{b}.n") * SHARE[1] >= F.greatest(f"{a}.n", f"{b}.n") * SHARE[0]
    return sizes & ((F.least(f"{a}.n", f"{b}.n") < FEWEST) | (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= RADIUS))


def _alike(a: str, b: str) -> Column:
    """Sets of rows (n, odd) whose parity sketches leave room for the index. No pair that has it fails."""
    apart = F.aggregate(F.zip_with(f"{a}.odd", f"{b}.odd", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda t, x: t + x)
    return apart * (SHARE[0] + SHARE[1]) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (SHARE[1] - SHARE[0])


_MET = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("near", pa.bool_())])


def _met(few: int):
    """Of rows (key, node, n, fp), those of a key and node together: pairs (u, v) of sets under keys with `few` sets
    or fewer that can have the index. Sets under other keys come one by one: u, the first set of the key as v, the
    key, and whether these two can have it. Holds `few` rows of a key at most, whatever their number.
    """

    def pairs(t: pa.Table, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        node, n, fp = columns(t)
        of = np.repeat(size, size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        row, ahead = np.repeat(first, size) + place, of - place - 1  # each row meets those after it
        i = np.repeat(row, ahead)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
        keep = _close(n[i], fp[i], n[j], fp[j])
        both = np.unique(np.stack([node[i[keep]], node[j[keep]]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both] + [pa.nulls(both.shape[1], f.type) for f in list(_MET)[2:]], schema=_MET)

    def single(t: pa.Table, centre: tuple) -> pa.RecordBatch:
        node, n, fp = columns(t)
        made = [node, np.full(len(node), centre[0]), t.column("key").to_numpy(), n, fp.view(np.int64), _close(n, fp, centre[1], centre[2])]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, _MET)], schema=_MET)

    def columns(t: pa.Table) -> tuple[np.ndarray, ...]:
        return t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("fp").to_numpy().view(np.uint64)

    def each(batches):
        held, open_, centre, last = None, None, None, None
        for b in _then_none(batches):
            rows = [x for x in (held, b) if x is not None and x.num_rows]
            held = None
            if not rows:
                continue
            t = pa.Table.from_batches([y for x in rows for y in (x.to_batches() if isinstance(x, pa.Table) else [x])])
            key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
            new = np.r_[(key[0], node[0]) != last, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # equal rows of several tasks
            t = t.filter(pa.array(new))
            key = t.column("key").to_numpy()
            if not len(key):
                continue
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            if open_ is not None and key[0] == open_:
                part = t.slice(0, size[0])
                yield single(part, centre)
                last = (key[0], part.column("node")[-1].as_py())
                first, size = first[1:], size[1:]
            if b is not None and len(first) and size[-1] <= few:
                held = t.slice(first[-1])
                first, size = first[:-1], size[:-1]
            for i, m in zip(first[size > few], size[size > few]):
                part = t.slice(i, m)
                open_, centre = key[i], tuple(x[0] for x in columns(part))
                last = (key[i], part.column("node")[-1].as_py())
                yield single(part, centre)
            some = (size > 1) & (size <= few)
            if some.any():
                yield pairs(t, first[some], size[some])

    return each


def _then_none(batches):
    yield from batches
    yield None


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) of sets whose Jaccard index is SHARE or more, by all their shingles.

    Sketches drop most others first. One text of each set goes to each of its pairs; texts of no pair
    stay where they are, as far as marks tell.
    """
    pairs = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sets = rows.groupBy("sid").agg(F.min("n").alias("n"), F.min("odd").alias("odd"))
    x, y = sets.withColumnRenamed("sid", "u").alias("x"), sets.withColumnRenamed("sid", "v").alias("y")
    pairs = settle(pairs.join(x, "u").join(y, "v").where(_alike("x", "y")).select("u", "v"))
    ends = pairs.select("u", "v", F.lit(0).alias("side"), F.col("u").alias("sid")).union(pairs.select("u", "v", F.lit(1), "v"))
    place = rows.groupBy("sid").agg(F.min(F.struct("doc_id", "text_key")).alias("p")).select("sid", F.col("p.doc_id").alias("d"), F.col("p.text_key").alias("k"))
    asked = settle(ends.join(place, "sid").select("u", "v", "side", "d", "k"))
    texts = docs.where(marked(marks(asked, "d"), F.col("doc_id"))).select("doc_id", "text")
    texts = texts.join(asked, (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("k"))).select("u", "v", "side", "text")

    def each(batches):
        known: dict[str, np.ndarray] = {}
        pair, sides = None, {}
        for b in batches:
            found = []
            for u, v, side, text in zip(*(c.to_pylist() for c in b.columns)):
                if (u, v) != pair:
                    pair, sides = (u, v), {}
                if side in sides:  # a repeated row
                    continue
                if text not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[text] = np.unique(shingles(text, words))
                sides[side] = known[text]
                if len(sides) == 2:
                    x, y = sides[0], sides[1]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    if same * SHARE[1] >= (len(x) + len(y) - same) * SHARE[0]:
                        found.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return settle(texts.repartition("u", "v").sortWithinPartitions("u", "v", "side").mapInArrow(each, "u long, v long"))


def _still_apart(labelled: DataFrame, turn: int) -> tuple[DataFrame, bool]:
    """Pairs of sets under one of the keys with many sets that can have the index and are not yet linked, and whether these are all.

    labelled: (key, node, n, fp, odd, component). At first each key's sets meet one centre: its smallest
    set, then one by hash; sets that share a passage and little else are linked to the smallest, if
    to any. After TURNS turns, or if no more pairs than rows are left, all pairs are taken.
    """
    labelled = settle(labelled)
    order = F.struct("n", F.xxhash64("key", "node")) if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "key", "node"))
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.min_by("node", order).alias("node"), F.min(order).alias("o"))
    per = settle(parts.groupBy("key").agg(F.sum("m").alias("every"), F.sum(F.col("m") * F.col("m")).alias("same"), F.min_by("node", "o").alias("centre")).where("every * every > same"))
    left, rows = per.agg(F.sum((F.col("every") * F.col("every") - F.col("same")) / 2), F.sum("every")).first()
    x, y = labelled.alias("x"), labelled.alias("y")
    apart = F.expr("x.key = y.key and x.component <> y.component") & _close_rows("x", "y") & _alike("x", "y")
    last = turn == TURNS or (left or 0) <= COMPARE * (rows or 0)
    if last:
        y = labelled.join(per.select("key"), "key", "left_semi").alias("y")
        both = x.join(y, apart & F.expr("x.node < y.node"))
    else:
        y = labelled.join(per.select("key", F.col("centre").alias("node")), ["key", "node"], "left_semi").alias("y")
        both = x.join(y, apart)
    return both.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")), last


def near_copies(docs: DataFrame, words: int = 5, most: int = 4, few: int = FEW) -> DataFrame:
    """(doc_id, text_key, component) of every row with a doc_id: texts linked by steps of a Jaccard index of 0.8 or more.

    SimHash words within `most` bits, from the Gray-order index, are candidates. At an index of 0.8
    words differ in more, up to RADIUS, where no index of 64 bits is selective; so sets that share
    a shingle of their prefixes are compared by their words too: of pairs with the index all but one in
    a million. Each candidate is checked by its shingles. Keys with more than `few` sets give
    stars, each key its own centre, in up to TURNS turns; then their sets that are still not linked
    are compared.
    """
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null").select("doc_id", "text")

    def summary(batches):
        for b in batches:
            sets = [np.unique(shingles(t, words)) for t in b.column("text").to_pylist()]
            made = [_summary(s) for s in sets]
            sid, n, fp = (np.array([m[i] for m in made], dtype=np.uint64).view(np.int64) for i in range(3))
            odd = pa.array([_parity(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(sid), pa.array(n.astype("i4")), pa.array(fp), odd], names=["doc_id", "text_key", "sid", "n", "fp", "odd"])

    rows = settle(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(summary, "doc_id long, text_key long, sid long, n int, fp long, odd array<long>"))
    common, counts = _common(docs, words)

    def prefixes(batches):
        seen: set[int] = set()  # of this task's rows: copies give their prefix once
        for b in batches:
            keys, of = [], []
            for t in b.column(0).to_pylist():
                s = np.unique(shingles(t, words))
                about_ = _summary(s)
                if about_[0] not in seen:
                    seen.add(about_[0])
                    keys.append(_prefix(s, common, counts))
                    of.append(about_)
            size = [len(k) for k in keys]
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            node, n, fp = (np.repeat(np.array([m[i] for m in of], dtype=np.uint64).view(np.int64), size) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(n.astype("i4")), pa.array(fp)], names=["key", "node", "n", "fp"])

    dealt = docs.select("text").mapInArrow(prefixes, "key long, node long, n int, fp long").repartition("key")
    dealt = dealt.sortWithinPartitions("key", F.xxhash64("key", "node"), "node")  # each key has its own first set
    met = settle(dealt.mapInArrow(_met(few), "u long, v long, key long, n int, fp long, near boolean"))
    nodes = settle(rows.groupBy("fp").agg(F.min("sid").alias("node")))
    gray = near_edges(nodes, most).unionByName(rows.join(nodes, "fp").select(F.col("sid").alias("u"), F.col("node").alias("v")))
    edges = _verified(gray.unionByName(met.where("key is null or near").select("u", "v")), rows, docs, words)
    found = components(edges)
    many = met.where("key is not null").select("key", F.col("u").alias("node"), "n", "fp")
    if many.head(1):
        sets = rows.groupBy("sid").agg(F.min("odd").alias("odd")).withColumnRenamed("sid", "node")
        many = settle(many.join(sets, "node"))
        for turn in range(TURNS + 1):
            more, last = _still_apart(many.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), turn)
            edges = edges.unionByName(_verified(more, rows, docs, words))
            found = components(edges)
            if last:
                break
    named = found.withColumnRenamed("node", "sid")
    return rows.join(named, "sid", "left").select("doc_id", "text_key", F.coalesce("component", "sid").alias("component"))


def keep_one_near(docs: DataFrame, words: int = 5, most: int = 4, few: int = FEW) -> DataFrame:
    """docs without all but one row of each group of near copies (Jaccard index of 0.8 or more); columns as they came.

    The row with the smallest doc_id stays (of several texts with that id, the smallest hash), once
    if it is repeated. Rows without a doc_id all stay. Only rows that go, and few others that share
    their marks, are dealt out.
    """
    groups = settle(near_copies(docs, words, most, few))
    place = F.struct("doc_id", "text_key")
    first = groups.groupBy("component").agg(F.min(place).alias("first"))
    gone = settle(groups.join(first, "component").where(place != F.col("first")).select("doc_id", "text_key").distinct())
    again = settle(groups.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"))
    bits = marks(gone.union(again), "doc_id")
    maybe = F.col("doc_id").isNotNull() & marked(bits, F.col("doc_id"))
    d, k = unused(docs, "d", "k")
    out = docs.where(maybe).join(gone.toDF(d, k), (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(k)), "left_anti")
    if again.head(1):
        out = out.withColumn(k, F.xxhash64("text")).dropDuplicates(["doc_id", k]).drop(k)
    return out.unionByName(docs.where(~maybe))
