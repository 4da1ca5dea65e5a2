"""Operator 12: Merkle manifest of a data set, proved by octopus multiproofs.

Every row is a leaf, the hash of its fields.  The leaves of one language, in order of their
ids, form a tree: runs of ``ARITY`` neighbours become their hash, level by level, until one
node is left.  These subroots, in order of the languages, form the top tree in the same way.

1. Leaves are hashed in the scan and get their places by range slices (``place_in_order``), so
   a language that holds most of the rows is spread over many tasks.
2. A block of ``BLOCK`` neighbouring leaves is hashed up to its top in one task; what is above
   the blocks has 1/BLOCK of the rows and is grouped level by level.
3. Proofs.  A leaf partition is what is asked of one block.  It works out the least set of
   nodes that its leaves' proofs need and that do not follow from its own leaves, in both
   trees, fetches them with one join, derives the interior nodes that the proofs share and
   only then writes the proof of each leaf.

``prove`` takes any rows of the manifest, not only all of them.

Cases: a null field is hashed as ``-`` and so differs from an empty one; rows with a null
language form one tree, which comes first; a null id comes first in its tree and is never
tampered with; rows repeating an id are ordered by their leaves and are leaves of their own;
a lone leaf is its subroot, a lone subroot the root; without any sibling the proof is the
hash of nothing; an empty table gives an empty result.  Texts of any length are hashed as a
whole, by the scan; no text is shuffled.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.operators.ordering import join_on_keys, place_in_order
from proofmark.registry.base import table
from proofmark.workspace import pin

ARITY = 8
# Levels, and so leaves, that one task hashes at once.
DEPTH = 4
BLOCK = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The number of the top tree among the trees of the languages.
TOP = -1

_NODE = "tree long, level int, at long, digest string"


def digest_of(fields: Sequence[Column]) -> Column:
    """Hash of the fields: each with its length in bytes, ``-`` for null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def raised(digests: list[str]) -> list[str]:
    """The next level: every run of ARITY neighbours becomes its hash."""
    return [_hash("".join(digests[i : i + ARITY])) for i in range(0, len(digests), ARITY)]


def missing_nodes(places: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The least set of (level, place) that the proofs of these leaves need from elsewhere.

    On each level these are the others of the runs of what is known there; what is known on
    the next level follows.
    """
    needed = []
    known, level = np.unique(places), 0
    while count > 1:
        runs = np.unique(known // ARITY)
        members = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        others = np.setdiff1d(members[members < count], known, assume_unique=True)
        needed += [(level, int(i)) for i in others]
        known, count, level = runs, -(-count // ARITY), level + 1
    return needed


def derive(leaves: dict[int, str], fetched: dict[tuple[int, int], str], count: int):
    """All nodes, level by level, that proofs of the leaves touch."""
    levels = []
    known, level = dict(leaves), 0
    while True:
        own = sorted(known)
        known |= {i: d for (at, i), d in fetched.items() if at == level}
        levels.append(known)
        if count <= 1:
            return levels
        runs = {i // ARITY for i in own}
        known = {
            r: _hash("".join(known[i] for i in range(r * ARITY, min(r * ARITY + ARITY, count))))
            for r in runs
        }
        count, level = -(-count // ARITY), level + 1


def siblings(levels: list[dict[int, str]], place: int, count: int) -> list[tuple[str, str]]:
    """What stands left and right of the node on each level of its way up."""
    found = []
    for known in levels[:-1]:
        start = place - place % ARITY
        run = range(start, min(start + ARITY, count))
        found.append(
            (
                "".join(known[i] for i in run if i < place),
                "".join(known[i] for i in run if i > place),
            )
        )
        place, count = place // ARITY, -(-count // ARITY)
    return found


def _block_nodes(leaves: pd.DataFrame) -> pd.DataFrame:
    """All nodes of one block; the lower levels of a tree with several blocks are filled up to
    the top of the block, even by runs of one."""
    leaves = leaves.sort_values("at")
    digests, first = leaves["digest"].tolist(), int(leaves["at"].iloc[0])
    several = int(leaves["n"].iloc[0]) > BLOCK
    found, level = [(leaves["tree"].iloc[0], 0, first + i, d) for i, d in enumerate(digests)], 0
    while level < DEPTH and (several or len(digests) > 1):
        digests, first, level = raised(digests), first // ARITY, level + 1
        found += [(leaves["tree"].iloc[0], level, first + i, d) for i, d in enumerate(digests)]
    return pd.DataFrame(found, columns=["tree", "level", "at", "digest"])


def grow(leaves: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Trees over (tree, at, n, digest): all nodes, and (tree, digest) of the roots."""
    block = F.floor(F.col("at") / F.lit(BLOCK)).alias("block")
    nodes = pin(
        leaves.groupBy("tree", block).applyInPandas(_block_nodes, _NODE), f"{label}-nodes"
    )
    sizes = leaves.groupBy("tree").agg(F.max("n").alias("n"))
    parts = [nodes]
    # Trees that have more than one node on the level of the block tops.
    open_trees = pin(sizes.where(F.col("n") > BLOCK), f"{label}-open")
    level, top = DEPTH, nodes.where(F.col("level") == DEPTH)
    largest = open_trees.agg(F.max("n")).first()[0] or 0
    while largest > ARITY**level:
        still = open_trees.where(F.col("n") > ARITY**level).select("tree")
        run = F.floor(F.col("at") / F.lit(ARITY)).alias("at")
        ordered = F.transform(
            F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]
        )
        top = pin(
            top.join(still, "tree", "left_semi")
            .groupBy("tree", run)
            .agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"))
            .select("tree", F.lit(level + 1).alias("level"), "at", "digest"),
            f"{label}-level",
        )
        parts.append(top)
        level += 1
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    last = F.max_by("digest", "level")
    roots = result.where(F.col("at") == 0).groupBy("tree").agg(last.alias("digest"))
    return result, roots


@dataclass
class Manifest:
    """``leaves``: (tree, at, n, doc_id, lang, digest, and the extra columns given);
    ``trees``: (tree, n, lang, subroot); ``nodes``: (tree, level, at, digest) of all trees, the top tree
    being ``TOP``; ``root`` is None for an empty table."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    count: int
    root: str | None


def build(rows: DataFrame, extra: Sequence[str] = ()) -> Manifest:
    """Manifest of (doc_id, lang, digest) and the extra columns."""
    rows = pin(rows, "leaves")
    named = pin(
        place_in_order(
            rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), (), ["lang"]
        ).select(F.col("before").cast("long").alias("tree"), "lang", "n"),
        "languages",
    )
    placed = place_in_order(rows, ["lang"], ["doc_id", "digest"])
    leaves = pin(
        join_on_keys(placed, named, ["lang"]).withColumn("at", F.col("before").cast("long")).select(
            "tree", "at", "n", "doc_id", "lang", "digest", *extra
        ),
        "placed",
    )
    nodes, subroots = grow(leaves.select("tree", "at", "n", "digest"), "trees")
    trees = pin(
        named.join(subroots, "tree").withColumnRenamed("digest", "subroot"), "subroots"
    )
    count = trees.count()
    top, roots = grow(
        trees.select(
            F.lit(TOP).cast("long").alias("tree"),
            F.col("tree").alias("at"),
            F.lit(count).cast("long").alias("n"),
            F.col("subroot").alias("digest"),
        ),
        "top",
    )
    found = roots.first()
    return Manifest(leaves, trees, nodes.unionByName(top), count, found and found["digest"])


def _asks(count: int):
    """The missing nodes of one leaf partition, in its own tree and in the top tree."""

    def run(key: tuple, leaves: pd.DataFrame) -> pd.DataFrame:
        tree, block = key
        own = missing_nodes(leaves["at"].to_numpy(), int(leaves["n"].iloc[0]))
        top = missing_nodes(np.array([tree]), count)
        rows = [(tree, block, tree, *c) for c in own] + [(tree, block, TOP, *c) for c in top]
        return pd.DataFrame(rows, columns=["part", "block", "tree", "level", "at"])

    return run


def _expands(count: int):
    """Proofs of the leaves of one partition from its own leaves and the nodes it fetched."""

    def run(key: tuple, leaves: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        if not len(leaves):
            return pd.DataFrame(
                {c.split()[0]: [] for c in _PROOF.split(", ")}
            ).astype({"tree": "int64", "at": "int64"})
        tree, size = int(leaves["tree"].iloc[0]), int(leaves["n"].iloc[0])
        given = {
            kind: {(r.level, r.at): r.digest for r in fetched[fetched["tree"] == kind].itertuples()}
            for kind in (tree, TOP)
        }
        levels = derive(dict(zip(leaves["at"], leaves["digest"])), given[tree], size)
        subroot = levels[-1][0]
        above = derive({tree: subroot}, given[TOP], count)
        root = above[-1][0]
        upper = siblings(above, tree, count)
        # Ways up are shared by all leaves of a run: they are put together once.
        ways: dict[int, list[tuple[str, str]]] = {}
        rows = []
        for leaf in leaves.itertuples():
            run_of = leaf.at // ARITY
            if len(levels) == 1:
                path = upper
            else:
                if run_of not in ways:
                    ways[run_of] = siblings(levels[1:], run_of, -(-size // ARITY)) + upper
                path = siblings(levels[:2], leaf.at, size) + ways[run_of]
            proof = sha256("".join([s for pair in path for s in pair]).encode()).hexdigest()
            node = leaf.changed if leaf.changed is not None else leaf.digest
            for left, right in path:
                node = _hash(left + node + right)
            rows.append((tree, leaf.at, subroot, root, proof, node))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PROOF.split(", ")])

    return run


_PROOF = "tree long, at long, subroot string, root string, proof_sha256 string, folded_root string"


def prove(manifest: Manifest, asked: DataFrame) -> DataFrame:
    """Proofs of the asked leaves (tree, at, n, digest, changed): the subroot and root derived
    from them, the hash of the proof, and the root that follows from ``changed`` (null: from
    the digest itself) and the same proof."""
    block = F.floor(F.col("at") / F.lit(BLOCK)).alias("block")
    narrow = asked.select("tree", block, "at", "n", "digest", "changed")
    wanted = narrow.groupBy("tree", "block").applyInPandas(
        _asks(manifest.count), "part long, block long, tree long, level int, at long"
    )
    wanted = pin(wanted, "missing")
    fetched = wanted.join(manifest.nodes, ["tree", "level", "at"]).select(
        "part", "block", "tree", "level", "at", "digest"
    )
    return (
        narrow.groupBy("tree", "block")
        .cogroup(fetched.groupBy("part", "block"))
        .applyInPandas(_expands(manifest.count), _PROOF)
    )


def tampered_text(text: Column) -> Column:
    """The text with A-Z in lower case, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def document_proofs(documents: DataFrame) -> DataFrame:
    """Proof of every document, and what becomes of it where the text is tampered with."""
    fields = [F.col(c) for c in FIELDS]
    changed = [tampered_text(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select(
        "doc_id",
        "lang",
        digest_of(fields).alias("digest"),
        F.when(crc % 3 == 0, digest_of(changed)).alias("changed"),
    )
    manifest = build(rows, ["changed"])
    proofs = prove(manifest, manifest.leaves)
    return (
        manifest.leaves.select("tree", "at", "doc_id", F.col("digest").alias("leaf"))
        .join(proofs, ["tree", "at"])
        .select(
            "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


def op12_merkle_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return document_proofs(table(spark, directory, "documents"))


OP12_SQL = """
WITH RECURSIVE
f AS (SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    list_reduce(list_prepend(4294967295::BIGINT,
        [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))
      AS turned FROM documents),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor(turned, 4294967295::BIGINT) % 3 = 0
      THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS changed
  FROM f),
p AS (SELECT *, coalesce(lang, '-') || (lang IS NULL) AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM t WHERE n > 1 GROUP BY tree, level, pos // 8),
r AS (SELECT s.tree, digest AS subroot, row_number() OVER (ORDER BY s.lang NULLS FIRST) - 1 AS place,
    count(*) OVER () AS n
  FROM t JOIN (SELECT DISTINCT tree, lang FROM p) s ON t.tree = s.tree WHERE t.n = 1),
u AS (SELECT '' AS tree, 0 AS level, place AS pos, n, subroot AS digest FROM r
  UNION ALL
  SELECT tree, level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM u WHERE n > 1 GROUP BY tree, level, pos // 8),
a AS (SELECT * FROM t UNION ALL SELECT * FROM u),
b AS (SELECT x.tree, x.level, x.pos,
    coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS lefts,
    coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS rights
  FROM a x JOIN a y ON x.tree = y.tree AND x.level = y.level AND x.pos // 8 = y.pos // 8
  WHERE x.n > 1 GROUP BY x.tree, x.level, x.pos),
w AS (SELECT p.tree, p.pos,
    string_agg(lefts || rights, '' ORDER BY b.tree = '', b.level) AS proof,
    list(lefts || '|' || rights ORDER BY b.tree = '', b.level) AS path
  FROM p JOIN r ON p.tree = r.tree
  JOIN b ON (b.tree = p.tree AND b.pos = p.pos // (8 ** b.level)::BIGINT)
    OR (b.tree = '' AND b.pos = r.place // (8 ** b.level)::BIGINT)
  GROUP BY p.tree, p.pos)
SELECT doc_id, leaf, subroot, z.digest AS root,
  sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(changed, leaf), coalesce(path, [])), lambda d, x:
    sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root,
  folded_root = z.digest AS verified
FROM p JOIN r ON p.tree = r.tree JOIN u z ON z.n = 1 LEFT JOIN w ON w.tree = p.tree AND w.pos = p.pos
"""
