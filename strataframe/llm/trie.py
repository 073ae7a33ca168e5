"""Prefix trie of conversations whose families share their first turns, merged family first.

A conversation c belongs to the family of base c - c % 100 and is rebuilt: the first h turns of the base
conversation (h: crc32 of c's decimal form, modulo 6), then its own turns after its first h. Each distinct sequence of
first turns is a node, and the conversations that start with it are its members.

1. Turns get their places within conversations by range partitions (operators/scans.py). A turn travels as a digest of role
   and text and a length; texts never move.
2. Conversations meet the at most five first turns of their base by its id. A node's key is the exclusive or of hashes of its
   turns, each with its depth (128 bits), so it is a running value along a conversation; conversations longer than
   SPAN turns are cut into spans, each with what came before it.
3. A family's nodes are combined first: members, the smallest member and the ends of at most 199 conversations. Only those
   combined nodes are shuffled by key and merged.
4. Each node belongs to its smallest member. Along a conversation the values of the nodes that it owns are summed from
   the end, within the family; a family's sums of a node are one row, and all families' are its subtree's.
5. The ends of a node come as one text for each family, in the order of the bases, which is that of the ids, and go
   through SHA-256 as they come. A hash of this kind is one sequence, so a node's ends pass one task; it holds a few MB.

Defined results: turns are ordered by turn, nulls first, ties by the md5 of role and text; null roles and texts count as
empty; repeated rows are turns of their own. Rows without conv_id belong to no conversation. A negative conv_id's base is
found with truncation, as % has it (-5 has base 0, -105 has base -100). A conversation without turns left ends at the root.
No conversations give no rows. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scans import ranks
from ..sources.scratch import discard, made_folders
from .common import crc32_of, mapped, materialize, table
from .resampling import CRC32_SQL, crc32_sql

FAMILY = 100
SHARED = 5
#: Turns of a conversation that one task takes together.
SPAN = 1 << 12
#: Parents that may have more than the so-manieth part of all nodes as children; no more than so many can.
HUBS = 500
NODE = ["d", "x", "y"]


def _base(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place from 1), rows (turns of the conversation), key, n (code points) of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(digest).alias("key"), F.length(text).cast("long").alias("n"))
    placed = ranks(turns, ["conv_id"], [(F.col("turn"), lambda x: x.asc_nulls_first()), F.col("key")])
    return materialize(placed.select("conv_id", F.col("_row").alias("p"), F.col("_rows").alias("rows"), "key", "n"), "turns")


def _rebuilt(turns: DataFrame, span: int) -> DataFrame:
    """base, conv_id, d, key, n, length of every turn of every rebuilt conversation, and of its root (d 0, no key)."""
    heads = turns.filter("p = 1").select(_base(F.col("conv_id")).alias("base"), "conv_id", "rows", (crc32_of("conv_id") % (SHARED + 1)).cast("int").alias("h"))
    shared = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("p") <= SHARED)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("p", "key", "n"))).alias("shared"))
    heads = heads.join(shared, "base", "left").withColumn("shared", F.slice(F.coalesce("shared", F.array().cast(shared.schema["shared"].dataType)), F.lit(1), F.col("h")))
    m = F.size("shared")
    heads = heads.withColumn("m", m).withColumn("length", m + F.greatest(F.col("rows") - F.col("h"), F.lit(0)))
    common = ["base", "conv_id"]
    roots = heads.select(*common, F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("n"), "length")
    first = heads.select(*common, "length", F.explode("shared").alias("t")).select(*common, F.col("t.p").alias("d"), "t.key", "t.n", "length")
    part = lambda at: F.floor((at - 1) / F.lit(span))
    parts = heads.select(*common, "h", "m", "length", F.explode(F.sequence(F.lit(0).cast("long"), part(F.col("rows")))).alias("part"))
    own = turns.withColumn("part", part(F.col("p"))).join(parts, ["conv_id", "part"]).filter(F.col("p") > F.col("h"))
    own = own.select(*common, (F.col("p") - F.col("h") + F.col("m")).alias("d"), "key", "n", "length")
    return roots.unionByName(first).unionByName(own)


def _paths(rebuilt: DataFrame, span: int) -> DataFrame:
    """base, span, conv_id, d, x, y (the node's key), px, py (its parent's), n, length of every node of every rebuilt conversation."""
    hashed = [F.when(F.col("d") > 0, F.xxhash64("key", "d", *more)).otherwise(F.lit(0).cast("long")) for more in ((), (F.lit(1),))]
    rows = rebuilt.select("base", F.floor(F.col("d") / F.lit(span)).alias("span"), "conv_id", "d", hashed[0].alias("hx"), hashed[1].alias("hy"), "n", "length")
    # a span of a long conversation begins with a row for all that came before it
    sums = rows.filter(F.col("length") >= span).groupBy("base", "conv_id", "span").agg(F.bit_xor("hx").alias("hx"), F.bit_xor("hy").alias("hy"))
    earlier = Window.partitionBy("base", "conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("base", "span", "conv_id", (F.col("span") * span - 1).alias("d"), *(F.bit_xor(c).over(earlier).alias(c) for c in ("hx", "hy")), F.lit(-1).cast("long").alias("n"), F.lit(None).cast("long").alias("length"))
    along = Window.partitionBy("base", "span", "conv_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.unionByName(before.filter("span > 0")).repartition("base", "span")
    for c in ("x", "y"):
        rows = rows.withColumn(c, F.bit_xor(f"h{c}").over(along))
    rows = rows.filter("n >= 0").withColumns({f"p{c}": F.col(c).bitwiseXOR(F.col(f"h{c}")) for c in ("x", "y")})
    return materialize(rows.drop("hx", "hy"), "paths")


def _merged(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (d, x, y, px, py, conv_id, n_convs, n, n_children), and ends (d, x, y, base, ids) of those where conversations end."""
    here = F.when(F.col("d") == F.col("length"), F.col("conv_id"))
    told = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.first(c).alias(c) for c in ("n", "px", "py"))]
    families = materialize(paths.groupBy("base", *NODE).agg(*told, F.sort_array(F.collect_list(here)).alias("ends")), "family-nodes")
    nodes = families.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *(F.first(c).alias(c) for c in ("n", "px", "py")))
    nodes = materialize(nodes, "nodes")
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = families.filter(F.size("ends") > 0).select(*NODE, "base", F.array_join(F.transform("ends", lambda c: c.cast("string")), ",").alias("ids"))
    return materialize(nodes.join(children, NODE, "left").na.fill(0, ["n_children"]), "merged-nodes"), ends


def _subtrees(nodes: DataFrame, paths: DataFrame, span: int) -> DataFrame:
    """d, x, y, n_leaves, saved_tokens: sums over each node's subtree."""
    own = nodes.select(_base(F.col("conv_id")).alias("base"), F.floor(F.col("d") / F.lit(span)).alias("span"), "conv_id", "d", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    lacking = [F.lit(None).cast("long").alias(c) for c in ("x", "y")]
    place = ["base", "span", "conv_id"]
    rows = paths.select(*place, "d", "x", "y", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")).unionByName(own.select(*place, "d", *lacking, "leaves", "saved"))
    # a span of a long conversation begins, from its end, with a row for all that comes after it
    long = paths.filter((F.col("length") >= span) & (F.col("d") % span == 0)).select(*place)
    sums = own.groupBy(*place).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    later = Window.partitionBy("base", "conv_id").orderBy("span").rowsBetween(1, Window.unboundedFollowing)
    after = long.join(sums, place, "left").select(*place, ((F.col("span") + 1) * span).alias("d"), *lacking, *(F.coalesce(F.sum(c).over(later), F.lit(0)).cast("long").alias(c) for c in ("leaves", "saved")))
    rows = rows.unionByName(after).repartition("base", "span")
    rows = rows.groupBy(*place, "d").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    along = Window.partitionBy(*place).orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    for c in ("leaves", "saved"):
        rows = rows.withColumn(f"{c}_on", F.sum(c).over(along))
    rows = rows.filter("x IS NOT NULL AND (leaves_on > 0 OR saved_on > 0)")
    by_family = rows.groupBy("base", "span", *NODE).agg(F.sum("leaves_on").alias("leaves"), F.sum("saved_on").alias("saved"))
    return by_family.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _ended(ends: DataFrame) -> DataFrame:
    """d, x, y, ends_sha256: the families' texts of each node in the order of their bases, hashed as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []

        def told() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], pa.string() if k == 3 else pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays(columns, names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            yield told()
            out = []
        if now:
            out = [(*now, digest.hexdigest())]
            yield told()

    placed = ends.repartition(*NODE).sortWithinPartitions(*NODE, "base").select(*NODE, "ids")
    return mapped(placed, run, "d long, x long, y long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. Children of the few parents that have very many meet a broadcast of HUBS rows at most."""
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), "n_children").filter("n_children > 0")
    many = F.col("n_children") * HUBS > nodes.count()
    hubs, others = parents.filter(many).drop("n_children"), parents.filter(~many).drop("n_children")
    key = ["d", "px", "py"]
    of_hubs = nodes.join(F.broadcast(hubs), key)
    rest = nodes.join(F.broadcast(hubs.select(*key)), key, "left_anti").join(others, key, "left")
    return of_hubs.unionByName(rest)


def prefix_trie(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    before = made_folders()
    paths = _paths(_rebuilt(_turns(conversations), span), span)
    nodes, ends = _merged(paths)
    told = materialize(_subtrees(nodes, paths, span), "subtrees")
    ended = materialize(_ended(ends), "ends")
    nothing = hashlib.sha256(b"").hexdigest()
    made = _with_parents(nodes).join(told, NODE, "left").join(ended, NODE, "left")
    discard(conversations.sparkSession, before, nodes, told, ended)
    zero = F.lit(0).cast("long")
    return made.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    return f"""
    WITH {CRC32_SQL.strip()},
    c AS (SELECT conv_id, turn, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p, k, length(text) AS n FROM c),
    heads AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("b")} % {SHARED + 1} AS h FROM (SELECT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS b FROM (SELECT DISTINCT conv_id FROM turns)), crc_table),
    rebuilt AS (SELECT conv_id, base, h, least(h, (SELECT count(*) FROM turns t WHERE t.conv_id = base)) AS m FROM heads),
    path AS (
      SELECT r.conv_id, p AS d, k, n FROM rebuilt r JOIN turns t ON t.conv_id = base AND p <= h
      UNION ALL SELECT conv_id, p - h + m, k, n FROM rebuilt JOIN turns USING (conv_id) WHERE p > h),
    steps AS (
      SELECT conv_id, 0 AS d, '' AS k, NULL AS pk, 0 AS n FROM rebuilt
      UNION ALL SELECT conv_id, d, string_agg(k, '') OVER w AS k, coalesce(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pk, n FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
    nodes AS (SELECT k, any_value(d) AS d, any_value(pk) AS pk, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM steps GROUP BY k),
    kids AS (SELECT pk AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY pk),
    own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * n AS saved FROM nodes LEFT JOIN kids USING (k)),
    below AS (SELECT a.k, sum(o.saved) AS saved_tokens, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves FROM own a JOIN own o ON starts_with(o.k, a.k) GROUP BY a.k),
    last AS (SELECT conv_id, max_by(k, d) AS k FROM steps GROUP BY conv_id),
    ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY k)
    SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM own o JOIN below USING (k) LEFT JOIN nodes p ON p.k = o.pk LEFT JOIN ends e ON e.k = o.k
    """


ORACLE = _oracle()
