"""MinHash near-duplicates: universal hash minima, bands, verified links, connected components.

1. A task turns each text into its set of distinct word shingles (64-bit hashes), the set's
   digest, ROWS * BANDS minima of universal hashes a*x+b, and a key for each band. Texts with
   equal sets are one node from here on, however many there are.
2. Nodes that share a band's key are a bucket. Buckets of the same nodes count once. The signatures
   of a bucket meet in one task; nodes that they join are one family, and so are, without a look,
   the nodes of a bucket that weighs more than BLOCK. Families are the components of these
   loose links, by alternating large-star and small-star. Two nodes of different families share no
   band or differ in their signatures, so links are looked for within families only.
3. The text of each node of a family is fetched once and its set written. A family of BLOCK at most
   meets in one task, which verifies pairs of like signatures on their whole sets.
4. Nodes of a heavier family first meet in blocks around a node that is the least of most of their
   buckets, and in blocks by chance; those links' components are known from then on. Where little of a family is left outside of its
   largest component, that meets the others, block by block, by signatures first. Where much is left,
   the nodes are dealt so by prefixes instead: sets in the order of their shingles' frequencies, of
   which two similar ones share a rare one; this loses no link. So neither many copies of a text nor many pages of one
   template cost their square, no family is capped, and no task takes more than two blocks. Components
   of the links again by alternating large-star and small-star.

The only loss is the bands' own: two sets of similarity s share no key with probability
(1 - s**ROWS)**BANDS, below 3e-6 at 0.8; the minima let a pair of 0.8 through but for 1e-6.

Defined results: words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case. A
text of fewer words than a shingle is one shingle; null text or no words give the empty set,
linked with nothing, its component its own doc_id. Repeated rows of a doc_id each count; a
doc_id with several texts links their components through none but their own sets. A very long
text is one set, in memory whole. A row without doc_id has n_shingles, no component, and isn't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard, made_folders
from .common import HUBS, Words, joined_by_hubs, lowered, mapped, materialize, mixed, slices, table, word_hashes
from .components import connected_components

SHINGLE = 4
SIMILARITY = (80, 100)
ROWS, BANDS = 6, 42
#: Weight of the texts that meet in one task: their shingles, and NODE for each text.
BLOCK = 1 << 17
NODE = 512
#: Blocks of a family outside of its largest component up to which they meet all of it: each of its nodes is then
#: dealt out so many times at most. Prefixes, which take a row for each shingle, are for more.
REST = 16
#: Share of equal minima below which a pair isn't looked at: nearly five deviations under 0.8.
LEAST_EQUAL = 0.68
#: Shingles hashed together: so many stay in cache.
CACHED = 1 << 15


def shingle_sets(data: np.ndarray, rows: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(lowered(data), rows)
    h = word_hashes(words)
    out = []
    n = len(h) - width + 1
    whole = h[:n] if n > 0 else h[:0]
    step = np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, width):
        whole = whole * step + h[k : n + k] if n > 0 else whole
    whole = mixed(whole)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:  # another start keeps short sequences apart from shingles
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mixed(x * step + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _family(n: int, seed: int = 20_240_229) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and addends of n universal hashes."""
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The minima of n hashes over each set: 32 high bits of a*x+b. Empty sets get the largest value."""
    a, b = _family(n)
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint64)
    full = [k for k, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        to, size = at, 0
        while to < len(full) and (to == at or size + len(sets[full[to]]) <= CACHED):
            size += len(sets[full[to]])
            to += 1
        x = np.concatenate([sets[k] for k in full[at:to]])
        begins = np.cumsum([0] + [len(sets[k]) for k in full[at : to - 1]])
        some = np.empty((to - at, n), np.uint64)
        if len(x) > 4 * CACHED:  # one long text: its parts one after the other
            some[:] = 0xFFFFFFFFFFFFFFFF
            for p in range(0, len(x), CACHED):
                part = x[p : p + CACHED]
                for k in range(n):
                    some[0, k] = min(some[0, k], (part * a[k] + b[k]).min())
        else:
            h = np.empty_like(x)
            for k in range(n):
                np.multiply(x, a[k], out=h)
                np.add(h, b[k], out=h)
                some[:, k] = np.minimum.reduceat(h, begins)
        out[full[at:to]] = some >> np.uint64(32)
        at = to
    return out


def _band_keys(m: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """A 64-bit key of each run of rows minima, with the band's number in it."""
    bands = m.shape[1] // rows
    key = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(salt))[None, :] * np.ones((len(m), 1), np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + m[:, k::rows][:, :bands])
    return key.astype(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def node_ids(sets: list[np.ndarray]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).astype(np.int64)


def signed(docs: DataFrame, width: int = SHINGLE, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in carry, n (set size), node (of the set; null if empty), keys (one for each band), sig (16 bits of each minimum)."""
    schema = docs.select("doc_id", *carry).schema.add("n", "long").add("node", "long").add("keys", T.ArrayType(T.LongType())).add("sig", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, rows in slices(batch, text):
                sets = shingle_sets(data, rows, width)
                m = minima(sets, ROWS * BANDS)
                sizes = np.array([len(s) for s in sets], np.int64)
                sig = m.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in carry), pa.array(sizes), pa.array(node_ids(sets), mask=sizes == 0), _lists(_band_keys(m, ROWS, 1)), pa.array([s.tobytes() for s in sig], pa.binary())], names=schema.names)

    return mapped(docs.select("doc_id", text, *carry), run, schema)


def _similar(x: int, y: int, both):
    part, of = SIMILARITY
    return of * both >= part * (x + y - both)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections: shingles of many sets by a matrix product, the others by their lists."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    heavy = np.flatnonzero(counts > max(8, m // 8))
    at = np.full(len(counts), -1)
    at[heavy] = np.arange(len(heavy))
    out = np.zeros((m, m), np.float32)
    for a in range(0, len(heavy), 1024):
        some = (at[column] >= a) & (at[column] < a + 1024)
        dense = np.zeros((m, min(1024, len(heavy) - a)), np.float32)
        dense[row[some], at[column[some]] - a] = 1
        out += dense @ dense.T
    light = (counts[column] > 1) & (at[column] < 0)
    order = np.argsort(column[light], kind="stable")
    row, column = row[light][order], column[light][order]
    first, last = np.searchsorted(column, column), np.searchsorted(column, column, "right")
    for k in range(m):
        mine = row == k
        n = last[mine] - first[mine]
        if len(n):
            ends = np.cumsum(n)
            out[k] += np.bincount(row[np.arange(ends[-1]) + np.repeat(first[mine] - ends + n, n)], minlength=m)
    return out


def links_among(sets: list[np.ndarray], sigs: np.ndarray, groups: list) -> list[tuple[int, int]]:
    """Links between similar sets, as few as join all that belong together. groups: equal for
    sets that are joined already."""
    m = len(sets)
    above = {g: g for g in groups}

    def root(g):
        while above[g] != g:
            above[g] = above[above[g]]
            g = above[g]
        return g

    known = np.array(groups)
    values, counts = np.unique(known, return_counts=True)
    in_main = known == values[np.argmax(counts)]  # two of the same class needn't be compared, so the largest class comes last
    order = np.concatenate([np.flatnonzero(~in_main), np.flatnonzero(in_main)])
    mine, rest = sigs[order], m - int(in_main.sum())
    near = [(np.zeros(0, np.int64))] * m
    for k in range(rest):
        close = order[k + 1 :][np.count_nonzero(mine[k + 1 :] == mine[k], axis=1) >= LEAST_EQUAL * sigs.shape[1]]
        near[order[k]] = close[known[close] != known[order[k]]]
    found = []
    overlaps = _overlaps(sets) if sum(map(len, near)) > 4 * m else None
    for a, close in enumerate(near):
        for b in close.tolist():
            ra, rb = root(groups[a]), root(groups[b])
            if ra != rb:
                both = overlaps[a, b] if overlaps is not None else len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if _similar(len(sets[a]), len(sets[b]), int(both)):
                    above[max(ra, rb)] = min(ra, rb)
                    found.append((a, b))
    return found


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, which come one after the other."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if left and left[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(left)
            left = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
            left.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(left)
                left = []
    if left:
        yield pa.Table.from_batches(left)


def _groups(met: DataFrame, told, schema: str) -> DataFrame:
    """told() of the rows of each meet, where there are two or more nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        made: list[list] = [[] for _ in names]
        for group in _runs(batches, "meet"):
            batch = group.combine_chunks().to_batches()[0]
            nodes, first = np.unique(batch.column("node").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            for column, more in zip(made, told(batch.take(pa.array(first)), nodes), strict=True):
                column += more
            if len(made[0]) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=names)
                made = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=names)

    return mapped(met.repartition("meet").sortWithinPartitions("meet"), run, schema)


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)


def _least_joined(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest place that each place in pairs is joined with."""
    above: dict[int, int] = {}

    def root(k: int) -> int:
        while above.setdefault(k, k) != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    for a, b in pairs:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return {k: root(k) for k in above}


def _close(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: members (meet, node) whose signatures join them within a meet, each (b) with the smallest of them (a)."""

    def told(batch: pa.RecordBatch, node: np.ndarray) -> tuple[list, list]:
        sigs = _signatures(batch)
        pairs = [(k, k + 1 + int(x)) for k in range(len(sigs) - 1) for x in np.flatnonzero(np.count_nonzero(sigs[k + 1 :] == sigs[k], axis=1) >= LEAST_EQUAL * sigs.shape[1])]
        joined = [(a, b) for b, a in _least_joined(pairs).items() if a != b]
        return node[[a for a, _ in joined]].tolist(), node[[b for _, b in joined]].tolist()

    met = members.join(nodes.select("node", "sig"), "node").select("meet", "node", "sig")
    return _groups(met, told, "a long, b long").distinct()


def _sets(families: DataFrame, docs: DataFrame, width: int, text: str) -> DataFrame:
    """node, sig, set (sorted hashes) of families (node, doc_id, sig): each text is moved once."""
    schema = "node long, sig binary, set binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, rows in slices(batch, "text"):
                sets = shingle_sets(data, rows, width)
                nodes = part.column("node").to_numpy()
                fits = np.flatnonzero(node_ids(sets) == nodes)  # a doc_id may have other texts beside the node's
                fits = fits[np.unique(nodes[fits], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[fits]), part.column("sig").take(pa.array(fits)), pa.array([sets[k].tobytes() for k in fits], pa.binary())], names=["node", "sig", "set"])

    met = families.select("node", "doc_id", "sig").join(docs.select("doc_id", F.col(text).alias("text")), "doc_id")
    return mapped(met.select("node", "sig", "text"), run, schema)


def _verified(members: DataFrame, sets: DataFrame, whole: bool = False) -> DataFrame:
    """a, b: links between members (meet, node, component) of one meet and several components, verified
    on whole sets. whole: a meet is all that its nodes can be linked with, so a is the least node joined with b."""

    def told(batch: pa.RecordBatch, node: np.ndarray) -> tuple[list, list]:
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("set")]
        found = links_among(own, _signatures(batch), batch.column("component").to_numpy().tolist())
        if whole:
            found = [(a, b) for b, a in _least_joined(found).items()]
        return node[[a for a, _ in found]].tolist(), node[[b for _, b in found]].tolist()

    return _groups(members.join(sets, "node").select("meet", "node", "component", "sig", "set"), told, "a long, b long")


def _partnered(members: DataFrame, sets: DataFrame) -> DataFrame:
    """meet, node, component of members (meet, node, component, n, index) that have a partner by their
    signatures in their meet: of another component, the smaller of the two by its index part."""

    def told(batch: pa.RecordBatch, node: np.ndarray) -> tuple[list, list, list]:
        sigs, index = _signatures(batch), batch.column("index").to_numpy(zero_copy_only=False)
        n, component = batch.column("n").to_numpy(), batch.column("component").to_numpy()
        hit = np.zeros(len(node), bool)
        for k in np.flatnonzero(index):
            some = np.flatnonzero((component != component[k]) & (n >= n[k]))
            some = some[np.count_nonzero(sigs[some] == sigs[k], axis=1) >= LEAST_EQUAL * sigs.shape[1]]
            hit[some] = True
            hit[k] |= len(some) > 0
        return batch.column("meet").to_numpy()[hit].tolist(), node[hit].tolist(), component[hit].tolist()

    met = members.join(sets.select("node", "sig"), "node").select("meet", "node", "component", "n", "index", "sig")
    return _groups(met, told, "meet long, node long, component long")


def _blocks(w: Column, block: int) -> Column:
    return F.greatest(F.ceil(w / F.lit(block)).cast("int"), F.lit(1))


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """meet and the columns of rows (bucket, node, component, n, index, w) dealt out so that each pair of a
    bucket's nodes meets somewhere, unless both belong to the bucket's largest component."""
    sizes = rows.groupBy("bucket", "component").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("often"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("w", "component")).alias("main"), F.max("w").alias("w_main"), F.sum("w").alias("w"), F.sum("often").alias("often"))
    main = main.select("bucket", "often", "main", _blocks(F.col("w_main"), block).alias("n_main"), _blocks(F.col("w") - F.col("w_main"), block).alias("n_rest"))
    rows = joined_by_hubs(rows, main, "bucket", "often", rows.count()).withColumn("in_main", F.col("component") == F.col("main"))
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    own = spread + F.when(F.col("in_main"), F.col("n_rest")).otherwise(0)  # blocks of the rest come first
    rest = F.sequence(F.lit(0), F.col("n_rest") - 1)
    every = F.sequence(F.lit(0), F.col("n_rest") + F.col("n_main") - 1)
    others = F.when(F.col("in_main"), rest).otherwise(every)
    rows = rows.withColumn("own", own).select("bucket", "node", "component", "n", "index", "own", F.explode(others).alias("other"))
    return rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("meet"), "node", "component", "n", "index")


def _starred(heavy: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """meet, node, component: each node of heavy (family, node, w) with the node that is the least of most of its
    buckets, in blocks of that one's followers, each with one copy of it, and with a block of its family by chance."""
    big = members.withColumnRenamed("least", "centre").join(heavy.select("node", "w"), "node")
    often = big.groupBy("node", "w", "centre").agg(F.count(F.lit(1)).alias("often"))
    star = materialize(often.groupBy("node", "w").agg(F.max_by("centre", F.struct("often", -F.col("centre"))).alias("centre")), "stars")
    n, often = star.count(), F.count(F.lit(1)).alias("often")
    blocks = star.groupBy("centre").agg(_blocks(F.sum("w"), block).alias("blocks"), often)
    dealt = joined_by_hubs(star, blocks, "centre", "often", n).select("centre", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"), "node")
    centres = blocks.select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.col("centre").alias("node"))
    sizes = heavy.groupBy("family").agg(_blocks(F.sum("w"), block).alias("blocks"), often)
    chance = joined_by_hubs(heavy, sizes, "family", "often", n).select("node", F.xxhash64("family", F.lit(True), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).alias("meet"))
    by_centre = dealt.unionByName(centres).select("node", F.xxhash64("centre", "own").alias("meet"))
    return by_centre.unionByName(chance).select("meet", "node", F.col("node").alias("component"))


def _prefixes(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket (a shingle), node, component, n, w, index of the nodes of open_ (node, component, n, w): the shingles
    that two similar sets can't but share one of. Each set in the order of its shingles' frequencies, the
    rarest first: the first that two linked sets share is among the first n - ceil(s n) + 1 of the larger, and
    among the first n - ceil(2 s n / (1 + s)) + 1 (its index part) of the smaller."""
    part, of = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("set")]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "shingles"])

    held = mapped(sets.select("node", "set").join(open_.select("node"), "node", "left_semi"), run, "node long, shingles array<long>")
    held = held.select("node", F.explode("shingles").alias("bucket"))
    often = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    held = held.join(often, "bucket").join(open_.select("node", "component", "n", "w"), "node")
    # shingles of one node only come first, so places are counted from the end
    place = F.col("n") - F.row_number().over(Window.partitionBy("node").orderBy(F.desc("often"), F.desc("bucket")))
    held = held.withColumn("place", place)
    up = lambda top, under: F.floor((F.col("n") * top + (under - 1)) / under)
    held = held.filter(F.col("place") <= F.col("n") - up(part, of))
    return held.select("bucket", "node", "component", "n", "w", (F.col("place") <= F.col("n") - up(2 * part, of + part)).alias("index"))


def _heavy_parts(heavy: DataFrame, members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """node, component of heavy (family, node, n, w), nodes of families too heavy for one task, as far as they have links."""
    first = connected_components(_verified(_starred(heavy, members, block), sets))
    placed = heavy.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("family", "component").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("often"))
    several = sizes.groupBy("family").agg(F.count(F.lit(1)).alias("components"), (F.sum("w") - F.max("w")).alias("rest"), F.sum("often").alias("often"))
    rests = joined_by_hubs(placed, several.select("family", "rest", "components", "often"), "family", "often", heavy.count()).filter("components > 1")
    open_ = materialize(rests.select("family", "node", "component", "n", "w", "rest"), "open-nodes")
    if open_.isEmpty():
        return first
    few, many = open_.filter(F.col("rest") <= REST * block), open_.filter(F.col("rest") > REST * block)
    rows = few.select(F.col("family").alias("bucket"), "node", "component", "n", "w", F.lit(True).alias("index"))
    if not many.isEmpty():
        prefixes = materialize(_prefixes(many, sets), "prefixes")
        told = prefixes.groupBy("bucket").agg(F.bool_or("index").alias("index"), F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node", "index")).alias("p"), F.bit_xor(F.xxhash64("node", "index", F.lit(1))).alias("q"))
        unlike = told.filter("index AND x < y").groupBy("m", "p", "q").agg(F.min("bucket").alias("bucket"))
        rows = rows.unionByName(prefixes.join(unlike.select("bucket"), "bucket", "left_semi"))
    near = materialize(_partnered(_dealt(materialize(rows, "dealt"), block), sets), "partners")
    return connected_components(_verified(near, sets).unionByName(first.select(F.col("component").alias("a"), F.col("node").alias("b"))))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, text: str = "text", block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the columns in carry of every row of docs (doc_id, text).
    carry: names other than the operator's own."""
    before = made_folders()
    made = materialize(signed(docs, width, text, carry), "minima")
    usable = made.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    rows = usable.select("node", F.explode("keys").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("often"))
    n_rows = BANDS * usable.count()
    # a bucket of very many rows is never shuffled by its key, so it may go on to distinct() without other nodes
    shared = shared.filter((F.col("least") < F.col("most")) | (F.col("often") * HUBS > n_rows)).select("bucket", "least", "most", "often")
    members = materialize(joined_by_hubs(rows, shared, "bucket", "often", n_rows).filter("least < most").select("bucket", "node", "least").distinct(), "members")
    # the node's smallest doc_id first, so that many copies of a text are one row before rows move by node
    own = usable.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    nodes = usable.join(own.join(members.select("node").distinct(), "node", "left_semi"), ["node", "doc_id"]).dropDuplicates(["node"])
    nodes = materialize(nodes.select("node", "doc_id", "n", (F.col("n") + NODE).alias("w"), "sig"), "nodes")
    # buckets of the same nodes are one
    sized = members.join(nodes.select("node", "w"), "node")
    buckets = sized.groupBy("bucket").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    alike = buckets.groupBy("w", "m", "x", "y").agg(F.min("bucket").alias("bucket"))
    buckets = materialize(alike.select("bucket", "w", "m"), "unlike-buckets")
    weighed = joined_by_hubs(members, buckets, "bucket", "m", members.count())
    loose = _close(weighed.filter(F.col("w") <= block).select(F.col("bucket").alias("meet"), "node"), nodes)
    starred = weighed.filter((F.col("w") > block) & (F.col("node") != F.col("least"))).select(F.col("least").alias("a"), F.col("node").alias("b"))
    families = connected_components(loose.unionByName(starred)).withColumnRenamed("component", "family")
    families = materialize(families.join(nodes, "node"), "families")
    weights = families.groupBy("family").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("often"))
    by_weight = joined_by_hubs(families.drop("sig"), weights, "family", "often", families.count())
    sets = materialize(_sets(families, docs, width, text), "sets")
    light = by_weight.filter(F.col("total") <= block)
    parts = _verified(light.select(F.col("family").alias("meet"), "node", F.col("node").alias("component")), sets, whole=True).select(F.col("b").alias("node"), F.col("a").alias("component"))
    heavy = materialize(by_weight.filter(F.col("total") > block).select("family", "node", "n", "w"), "heavy-families")
    if not heavy.isEmpty():
        parts = parts.unionByName(_heavy_parts(heavy, members, sets, block))
    # nodes of one row that are linked with nothing need no name
    parts = materialize(parts, "parts")
    least = own.join(parts, "node").groupBy("component").agg(F.min("doc_id").alias("joint_id"), F.count(F.lit(1)).alias("often"))
    joint = joined_by_hubs(parts, least, "component", "often", parts.count()).select("node", "joint_id")
    named = own.join(joint, "node", "left").filter((F.col("copies") > 1) | F.col("joint_id").isNotNull()).select("node", F.coalesce("joint_id", "doc_id").alias("component_id"), "copies")
    named = materialize(named, "names")
    discard(docs.sparkSession, before, made, named)
    rows = made.select("doc_id", "n", "node", *carry)
    out = joined_by_hubs(rows, named, "node", "copies", rows.count(), "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), *carry)


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id, and of the smallest md5
    of its text where that doc_id has several. Rows without doc_id stay."""
    names = docs.columns
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = near_duplicates(docs.select("doc_id", "text", digest.alias("digest")), width, carry=("digest",)).filter("kept")
    kept = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")).groupBy("doc_id").agg(F.min(F.struct("digest", "copies")).alias("x"))
    mark = "kept"
    while any(c.lower().startswith(mark) for c in names):
        mark += "_"
    kept = materialize(kept.select(F.col("doc_id").alias(f"{mark}id"), F.col("x.digest").alias(f"{mark}text"), F.col("x.copies").alias("copies")), "kept")
    once, again = (kept.filter(x).drop("copies") for x in ("copies = 1", "copies > 1"))
    same = (F.col("doc_id") == F.col(f"{mark}id")) & (digest == F.col(f"{mark}text"))
    # the ids grow with the corpus: merged at every size, never broadcast
    out = docs.join(once.hint("merge"), same, "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*names)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    part, of = SIMILARITY
    return f"""
    WITH RECURSIVE words AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (
      SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + {SHINGLE - 1}], ' ') for i in range(1, len(w) - {SHINGLE - 2})]) END AS s FROM words),
    one AS (SELECT doc_id, len(s) AS n, s FROM sets),
    items AS (SELECT doc_id, n, unnest(s) AS x FROM one),
    pairs AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {of} * count(*) >= {part} * (a.n + b.n - count(*))),
    reach(a, b) AS (SELECT doc_id, doc_id FROM one UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
    least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT o.doc_id, CAST(o.n AS BIGINT) AS n_shingles, l.component_id, o.doc_id = l.component_id AS kept FROM one o JOIN least l USING (doc_id)
    """


ORACLE = _oracle()
