"""A Merkle tree over the documents of each language, a tree over their roots, and a proof for every document.

The hash of a run of nodes is the SHA-256 of their digests' hex texts. Leaves
ascend by ``doc_id``; a tree's nodes are made in blocks of 1,024 leaves and then
of 1,024 block roots, and so on, so no task sees more.

Proofs are found by pointer jumping. A node starts with a pointer to its parent
and the siblings on either side as its only step. In each round a node takes on
the steps of the node that it points to and points to where that one did, which
doubles the distance; after as many rounds as the depth has binary digits all
leaves point to the root. Only nodes at levels that are multiples of the distance
are needed in later rounds, so the tables shrink to the leaves.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoloom.llm.corpus import looked_up, numbered, table
from geoloom.sources.shared import materialise

ARITY = 2
SPAN = 10  # levels that one task makes of a block of nodes
SPREAD = 4096  # leaves whose nodes ask for one copy of an ancestor
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, level int, pos long, n long, leaves long, depth int, digest binary, steps array<struct<before: binary, after: binary>>"


def leaf(fields: dict[str, Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its text."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (x.cast("string") for x in fields.values())]
    return F.sha2(F.concat(*parts), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest (hex) and its steps lead to."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(_hex(s["before"]), h, _hex(s["after"])), 256))


def siblings(steps: Column) -> Column:
    """Hex digests of all siblings of a proof, level by level and left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), "")


def _block(level: int, arity: int):
    """The nodes that a block of nodes of one level grows into, up to SPAN levels or the root of its tree."""

    def make(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        t = t.sort_by("pos")
        n, leaves = t.column("n")[0].as_py(), t.column("leaves")[0].as_py()
        depth = 0
        while arity**depth < leaves:
            depth += 1
        run, at, up = [d.hex().encode() for d in t.column("digest").to_pylist()], block * arity**SPAN, 0
        rows = []
        while up < SPAN and n > 1:
            grown = []
            for i in range(0, len(run), arity):
                family = run[i : i + arity]
                for j in range(len(family)):
                    step = {"before": bytes.fromhex(b"".join(family[:j]).decode()), "after": bytes.fromhex(b"".join(family[j + 1 :]).decode())}
                    rows.append((level + up, at + i + j, None, None, [step]))
                grown.append(hashlib.sha256(b"".join(family)).hexdigest().encode())
            run, at, n, up = grown, at // arity, -(-n // arity), up + 1
        rows.append((level + up, at, n, bytes.fromhex(run[0].decode()), None))
        lv, pos, n_, digest, steps = zip(*rows)
        return pa.table({
            "tree": pa.array([tree] * len(rows), pa.string()), "level": pa.array(lv, pa.int32()), "pos": pa.array(pos, pa.int64()), "n": pa.array(n_, pa.int64()),
            "leaves": pa.array([leaves] * len(rows), pa.int64()), "depth": pa.array([depth] * len(rows), pa.int32()), "digest": pa.array(digest, pa.binary()),
            "steps": pa.array(steps, pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))),
        })

    return make


def grown(leaves: DataFrame, most: int, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """Nodes below the roots, each with the step to its parent, and roots, of trees with at most ``most`` leaves.

    ``leaves`` has ``tree, pos`` (from 0, without gaps) ``, leaves`` (how many the tree has) ``, digest`` (binary).
    """
    level, now, parts = 0, leaves.select("tree", "pos", F.col("leaves").alias("n"), "leaves", "digest"), []
    while True:
        made = now.withColumn("block", F.expr(f"pos div {arity**SPAN}")).groupBy("tree", "block").applyInArrow(_block(level, arity), NODES)
        parts.append(materialise(made, "merkle_nodes"))
        most, level = -(-most // arity**SPAN), level + SPAN
        if most <= 1:
            break
        now = parts[-1].where("n > 1").select("tree", "pos", "n", "leaves", "digest")
    all_made = parts[0]
    for p in parts[1:]:
        all_made = all_made.unionByName(p)
    return all_made.where("steps is not null").drop("n", "digest"), all_made.where("n = 1").select("tree", "leaves", "digest")


def proofs(nodes: DataFrame, depth: int, arity: int = ARITY, spread: int = SPREAD) -> DataFrame:
    """``tree, pos, steps`` of every leaf that isn't itself a root: all steps to its tree's root, by pointer jumping.

    ``depth`` is that of the deepest tree. An ancestor stands once for every
    ``spread`` leaves below it, so nodes near a root aren't frequent keys of a join.
    """
    step = 1
    while step < depth:
        behind = nodes.where(f"level % {2 * step} = 0").withColumn("at", F.least(F.col("level") + step, F.col("depth")))
        behind = behind.withColumns({"anc": F.expr(f"pos div cast(pow({arity}, at - level) as long)"), "part": F.expr(f"(pos * cast(pow({arity}, level) as long)) div {spread}")})
        ahead = nodes.where(f"level % {2 * step} = {step}").withColumns({"first": F.expr(f"pos * cast(pow({arity}, level) as long)"), "many": F.expr(f"cast(pow({arity}, level) as long)")})
        copies = F.expr(f"explode(sequence(first div {spread}, (least(first + many, leaves) - 1) div {spread}))")
        ahead = ahead.select("tree", F.col("level").alias("at"), F.col("pos").alias("anc"), copies.alias("part"), F.col("steps").alias("more"))
        joined = behind.join(ahead, ["tree", "at", "anc", "part"], "left")
        nodes = materialise(joined.select("tree", "level", "pos", "leaves", "depth", F.when(F.col("more").isNull(), F.col("steps")).otherwise(F.concat("steps", "more")).alias("steps")), "merkle_steps")
        step *= 2
    return nodes.where("level = 0").select("tree", "pos", "steps")


def _depth(leaves: int, arity: int) -> int:
    depth = 0
    while arity**depth < leaves:
        depth += 1
    return depth


def manifest(docs: DataFrame, now: dict[str, Column] | None = None, arity: int = ARITY, spread: int = SPREAD) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, lang, leaf, subroot, root, proof`` and ``leaf_now``.

    ``leaf_now`` is the leaf with the fields of ``now`` in place of the columns, for
    a check against what a document looks like later: ``folded(leaf_now, proof)``
    equals ``root`` only if nothing changed. ``proof`` is an array of steps
    ``before, after``: the siblings' digests on either side.

    Leaves of a language ascend by ``doc_id``, nulls first, ties by digest, so
    repeated rows are leaves of their own. A null language is one of its own and
    comes first; the others follow bytewise. Any field may be null. Texts are
    hashed whole. Other columns are ignored, whatever their names. An empty table
    gives no rows. A proof may be empty: of one document in one language.
    """
    fields = {c: F.col(c) for c in FIELDS}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree"), leaf(fields).alias("leaf"), leaf(fields | (now or {})).alias("leaf_now"))
    placed = numbered(rows, "tree", "doc_id", "leaf")
    trees = materialise(placed.groupBy("tree").agg(F.min("place").alias("base"), F.count("*").alias("leaves")), "merkle_trees")
    total, most = trees.agg(F.coalesce(F.sum("leaves"), F.lit(0)), F.coalesce(F.max("leaves"), F.lit(0))).first()
    placed = looked_up(placed, trees.withColumn("n", F.col("leaves")), "tree", "n", total)
    placed = materialise(placed.select("tree", "doc_id", "leaf", "leaf_now", (F.col("place") - F.col("base")).alias("pos"), "leaves"), "merkle_leaves")
    nodes, roots = grown(placed.select("tree", "pos", "leaves", F.unhex("leaf").alias("digest")), most, arity)
    lower = proofs(nodes, _depth(most, arity), arity, spread)

    # the tree over the subroots
    ranked = numbered(roots.select(F.col("tree").alias("lang_tree"), F.col("leaves").alias("n"), "digest"), "lang_tree")
    ranked = materialise(ranked.withColumnRenamed("place", "pos"), "merkle_subroots")
    count = ranked.count()
    over, root = grown(ranked.select(F.lit("").alias("tree"), "pos", F.lit(count).cast("long").alias("leaves"), "digest"), count, arity)
    upper = proofs(over, _depth(count, arity), arity, spread).select("pos", F.col("steps").alias("upper"))
    tops = ranked.join(upper, "pos", "left").crossJoin(F.broadcast(root.select(_hex(F.col("digest")).alias("root"))))
    tops = materialise(tops.select(F.col("lang_tree").alias("tree"), "n", _hex(F.col("digest")).alias("subroot"), "root", "upper"), "merkle_tops")

    none = F.array().cast("array<struct<before: binary, after: binary>>")
    out = materialise(placed.drop("leaves").join(lower, ["tree", "pos"], "left"), "merkle_proofs")
    out = looked_up(out, tops, "tree", "n", total)
    proof = F.concat(F.coalesce("steps", none), F.coalesce("upper", none))
    lang = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return out.select("doc_id", lang.alias("lang"), "leaf", "leaf_now", "subroot", "root", proof.alias("proof"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    now = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    out = manifest(docs, now).withColumn("folded_root", folded(F.col("leaf_now"), F.col("proof")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


OP12_SQL = """
WITH RECURSIVE f AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS tail, xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
      lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) AS crc
  FROM documents
), g AS (
  SELECT *, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(m AS VARCHAR)) || ':' || m END || tail) AS leaf_now
  FROM (SELECT *, n_chars + CAST(crc % 7 = 0 AS INTEGER) AS m FROM f)
), l AS MATERIALIZED (
  SELECT doc_id, leaf, leaf_now, coalesce('+' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM g
), t AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS hs FROM l GROUP BY tree
  UNION ALL SELECT tree, level + 1, list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], ''))) FROM t WHERE len(hs) > 1
), low AS MATERIALIZED (SELECT * FROM t),
sub AS MATERIALIZED (SELECT tree, hs[1] AS subroot, level AS depth, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM low WHERE len(hs) = 1),
u AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS hs FROM sub
  UNION ALL SELECT level + 1, list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], ''))) FROM u WHERE len(hs) > 1
), high AS MATERIALIZED (SELECT * FROM u),
steps AS (
  SELECT l.tree, l.pos, low.level, CAST(floor(l.pos / pow(2, low.level)) AS BIGINT) AS place_, hs FROM l JOIN low ON low.tree = l.tree AND len(hs) > 1
  UNION ALL SELECT l.tree, l.pos, depth + high.level, CAST(floor(place / pow(2, high.level)) AS BIGINT), hs FROM l JOIN sub ON sub.tree = l.tree JOIN high ON len(hs) > 1
), sib AS MATERIALIZED (
  SELECT tree, pos, level, CASE WHEN place_ % 2 = 1 THEN hs[place_] ELSE '' END AS before, CASE WHEN place_ % 2 = 0 THEN coalesce(hs[place_ + 2], '') ELSE '' END AS after FROM steps
), proof AS (SELECT tree, pos, string_agg(before || after, '' ORDER BY level) AS p FROM sib GROUP BY tree, pos),
fold AS (
  SELECT tree, pos, 0 AS level, leaf_now AS h FROM l
  UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(before || h || after) FROM fold f JOIN sib s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level
), ended AS (SELECT tree, pos, arg_max(h, level) AS h FROM fold GROUP BY tree, pos),
r AS (SELECT hs[1] AS root FROM high WHERE len(hs) = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM l JOIN sub ON sub.tree = l.tree JOIN ended e ON e.tree = l.tree AND e.pos = l.pos LEFT JOIN proof ON proof.tree = l.tree AND proof.pos = l.pos, r
"""
