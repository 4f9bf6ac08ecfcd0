"""Merkle manifest of a table: a tree of digests per group, and one over the groups.

Leaves of a group stand in order of their key; while more than one node is left, every ``FAN`` consecutive
ones become their digest. Nodes are rows of a window: on level L a node is the row of its first leaf, so its siblings
are lag and lead columns of the fixed offsets 3^L and 2 * 3^L, masked by the node's slot and by the
length of its run. First-child rows hash the parent. The way back down hands each path to the children
through lags of the same offsets.

A window never holds a group: positions come from ranges (``operators.numbering``), and windows run over
chunks of ``SPAN`` = 3^7 positions, which no run crosses. The roots of the chunks are the
leaves of the next tier, so a group of any size takes few tiers and each has a 2,187th of the rows before.

Cases: NULL values are part of the leaf (``-``), NULL keys come first, a NULL group is a group of its own and the first
one. Rows equal in key are ordered by their leaf, and rows equal in both are interchangeable. Empty and very
long texts are leaves like any other. One leaf is its own subroot and one subroot its own root, with an empty
path. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.base import register, table
from paperloom.operators.numbering import group_key, numbered, small
from paperloom.session import write_through

FAN, LEVELS = 3, 7
SPAN = FAN**LEVELS
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Digest of values, each with its length in bytes before it, NULL as ``-``."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(told, values))


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf leads to with the siblings of a path."""
    return F.aggregate(path, start, lambda node, s: digest(s["left"], node, s["right"]))


def _spaces(nodes: DataFrame) -> tuple[DataFrame, Window]:
    placed = nodes.withColumn("chunk", F.expr(f"pos div {SPAN}")).withColumn("place", (F.col("pos") % SPAN).cast("int"))
    return placed, Window.partitionBy("grp", "chunk").orderBy("pos")


def _climb(nodes: DataFrame, paths: bool) -> DataFrame:
    """Columns ``h0``.. of the nodes on each level; with ``paths`` also what stands left and right of them."""
    rows, order = _spaces(nodes)
    rows = rows.withColumn("h0", F.col("hash"))
    for level in range(LEVELS):
        step, own = FAN**level, f"h{level}"
        active = F.col("total") > step  # more than one node of the group on this level
        slot = F.expr(f"place div {step}") % FAN
        node = active & (F.col("place") % step == 0)
        found = {f"after{i}": F.coalesce(F.lead(own, i * step).over(order), F.lit("")) for i in (1, 2)}
        if paths:
            found |= {f"before{i}": F.coalesce(F.lag(own, i * step).over(order), F.lit("")) for i in (1, 2)}
        rows = rows.withColumns(found)
        right = F.when(slot == 0, F.concat("after1", "after2")).when(slot == 1, F.col("after1")).otherwise("")
        step_up = F.when(active, digest(F.col(own), F.col("after1"), F.col("after2"))).otherwise(F.col(own))
        made = {f"h{level + 1}": F.when(F.col("place") % (step * FAN) == 0, step_up)}
        if paths:
            left = F.when(slot == 2, F.concat("before2", "before1")).when(slot == 1, F.col("before1")).otherwise("")
            made[f"side{level}"] = F.when(node, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(PATH))
        rows = rows.withColumns(made).drop(*found)
    return rows


def _roots(nodes: DataFrame) -> DataFrame:
    """One node per chunk, numbered within its group; ``whole`` if it is the root of the group."""
    top = _climb(nodes, False).where("place = 0")
    return top.select("grp", F.col("chunk").alias("pos"), F.ceil(F.col("total") / SPAN).alias("total"), F.col(f"h{LEVELS}").alias("hash"), (F.col("total") <= SPAN).alias("whole"))


def _paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``chunk`` and their path up to the root of their chunk."""
    rows, order = _climb(nodes, True), Window.partitionBy("grp", "chunk").orderBy("pos")
    rows = rows.withColumn("path", F.array().cast(PATH))
    for level in reversed(range(LEVELS)):
        step = FAN**level
        slot = F.expr(f"place div {step}") % FAN
        rows = rows.withColumns({f"up{i}": F.lag("path", i * step).over(order) for i in (1, 2)})
        parent = F.when(slot == 0, F.col("path")).when(slot == 1, F.col("up1")).otherwise(F.col("up2"))
        rows = rows.withColumn("path", F.when(F.col("place") % step == 0, F.concat(f"side{level}", parent))).drop("up1", "up2", f"side{level}")
    return rows.select(*nodes.columns, "chunk", "path")


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of chunk roots above ``nodes`` (grp, pos, total, hash), and each group's root."""
    tiers = [write_through(_roots(nodes), "tier")]
    while (rest := tiers[-1].where("NOT whole")).head(1):
        tiers.append(write_through(_roots(rest), "tier"))
    return tiers, reduce(DataFrame.unionAll, [t.where("whole").select("grp", F.col("hash").alias("subroot")) for t in tiers])


def _above(tiers: list[DataFrame]) -> DataFrame:
    """``grp, chunk, up``: the path from the root of every chunk of the lowest tier to its group's root."""
    up = None
    for tier in reversed(tiers):
        lone = tier.where("whole").select("grp", F.col("pos").alias("chunk"), F.array().cast(PATH).alias("up"))
        if up is None:
            up = lone
            continue
        own = _paths(tier.where("NOT whole")).join(up, ["grp", "chunk"])
        up = write_through(lone.unionAll(own.select("grp", F.col("pos").alias("chunk"), F.concat("path", "up").alias("up"))), "above")
    return up


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (``grp`` not NULL, ``id``, ``hash`` and others) with ``path``, ``subroot`` and ``root``.

    ``folded(path, hash)`` gives ``root`` again; a changed leaf does not.
    """
    nodes = numbered(rows, "grp", ["id", "hash"])
    tiers, subroots = tree(nodes)
    groups = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("subroot").alias("hash")), "grp", ["id"])
    high, roots = tree(groups)
    over = _paths(groups).join(_above(high), ["grp", "chunk"]).join(F.broadcast(roots), "grp")  # one root
    over = over.select(F.col("id").alias("grp"), F.col("hash").alias("subroot"), F.col("subroot").alias("root"), F.concat("path", "up").alias("over"))
    # One row per chunk joins the leaves, so a large group is dealt by its chunks.
    tops = write_through(_above(tiers).join(small(write_through(over, "groups")), "grp"), "tops")
    known = _paths(nodes).join(small(tops), ["grp", "chunk"])
    return known.withColumn("path", F.concat("path", "up", "over")).drop("chunk", "up", "over", "pos", "total")


def verified(documents: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """Leaf, subroot, root, proof digest and the root recomputed from the claimed leaf, for each document.

    ``documents`` has doc_id, source, lang, n_chars and text, and may have ``claimed``: the text to hold against
    the manifest.
    """
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = leaf(*values, F.col("text"))
    rows = documents.select(
        group_key(F.col("source")).alias("grp"), F.col("doc_id").alias("id"), own.alias("hash"), F.when(F.col("claimed").eqNullSafe(F.col("text")), F.lit(None)).otherwise(leaf(*values, F.col("claimed"))).alias("other")
    )
    found = manifest(write_through(rows, "leaves"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    again = folded(F.col("path"), F.coalesce("other", "hash"))
    found = found.select(F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce('=' || source, '') AS grp, text, coalesce(strlen(source) || ':' || source, '-') AS s,
        coalesce(strlen(lang) || ':' || lang, '-') AS g, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS c,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS d,
        xor(list_reduce(list_transform(range(0, len(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, (i + 1)::INT, 1))::UBIGINT),
            lambda acc, x: list_reduce(range(0, 8)::UBIGINT[],
                lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END, xor(acc, x)),
            4294967295::UBIGINT), 4294967295::UBIGINT) AS crc
    FROM documents
), leaves AS (
    SELECT doc_id, grp, sha256(d || s || g || c || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(d || s || g || c || coalesce(strlen(t) || ':' || t, '-')) AS claimed
    FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM docs)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), nodes AS (
    SELECT grp, 0 AS lvl, pos, leaf AS h, n FROM placed
    UNION ALL
    SELECT grp, min(lvl) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY grp, pos // 3
), subroots AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), above AS (
    SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
    UNION ALL
    SELECT min(lvl) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 2) // 3 FROM above WHERE n > 1 GROUP BY pos // 3
), every AS (
    SELECT grp, lvl, pos, h, n FROM nodes UNION ALL SELECT '+', lvl, pos, h, n FROM above
), sides AS (
    SELECT a.grp, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM every a JOIN every b ON a.grp = b.grp AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
), walk AS (
    SELECT doc_id, p.grp AS own, p.pos AS nr, p.grp, 0 AS lvl, p.pos, s.pos AS gpos, claimed AS node, '' AS proof FROM placed p JOIN subroots s ON p.grp = s.grp
    UNION ALL
    SELECT w.doc_id, w.own, w.nr, CASE WHEN s.grp IS NULL THEN '+' ELSE w.grp END, CASE WHEN s.grp IS NULL THEN 0 ELSE w.lvl + 1 END,
        CASE WHEN s.grp IS NULL THEN gpos ELSE w.pos // 3 END, gpos,
        CASE WHEN s.grp IS NULL THEN node ELSE sha256(l || node || r) END, proof || coalesce(l || r, '')
    FROM walk w LEFT JOIN sides s ON w.grp = s.grp AND w.lvl = s.lvl AND w.pos = s.pos WHERE s.grp IS NOT NULL OR w.grp <> '+'
), ends AS (SELECT own, nr, arg_max(node, len(proof) * 2 + (grp = '+')::INT) AS folded_root, max_by(proof, len(proof)) AS proof FROM walk GROUP BY own, nr)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM placed p JOIN subroots s ON p.grp = s.grp JOIN ends e ON e.own = p.grp AND e.nr = p.pos CROSS JOIN (SELECT h FROM above WHERE n = 1) r
"""


@register("op11_merkle", SQL)
def op11_merkle(spark, folder):
    """Manifest of all documents; every second one is held against it without its line breaks."""
    documents = table(spark, folder, "documents")
    struck = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return verified(documents.withColumn("claimed", F.when(struck, F.translate("text", "\n", "")).otherwise(F.col("text"))))
