"""Operator 5: near-duplicate groups by MinHash banding.

1. Each text becomes the set of its word shingles (64-bit hashes).  Equal sets are
   collapsed to one node, the least id among them.
2. 128 universal hash minima per node form 32 bands of 4.  At a similarity of 0.8 a pair
   shares no band with probability 5e-8.
3. Every node of a bucket is compared with the bucket's least node on the full sets, which
   needs one row per member, however large the bucket is.  The confirmed links give first
   components (alternating large-star and small-star).
4. Buckets that still hold several components are finished: members outside the bucket's
   main component meet all others, in blocks of bounded size, and their full sets are
   compared.  So no link of a bucket is lost and no list of all pairs is made.

Cases: a text with fewer words than the shingle length is one shingle; null, empty and
wordless texts have no shingles and are linked with nothing; rows without id take no part
in links and have no component; rows repeating an id are judged by their own texts; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.llm.components import connected_components
from proofmark.operators.ordering import place_in_order
from proofmark.registry.base import table
from proofmark.workspace import pin

SHINGLE = 5
PERCENT = 80
MINIMA = 128
ROWS = 4
SEED = 20
# Members of one bucket that a task compares with as many others.
BLOCK = 512
# Shingles hashed at once (stays in the processor cache), distinct words remembered.
_CHUNK = 1 << 15
_WORDS = 100_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Sets of word shingles as sorted arrays of 64-bit hashes."""

    def __init__(self, width: int):
        self.width = width
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        try:
            codes = [known[w] for w in words]
        except KeyError:
            if len(known) >= _WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            codes = [known[w] for w in words]
        hashes = np.array(codes, np.uint64)
        width = min(self.width, len(hashes))
        count = len(hashes) - width + 1
        joined = np.full(count, np.uint64(width))
        for i in range(width):
            joined = joined * _MULTIPLIER + hashes[i : i + count]
        joined ^= joined >> np.uint64(32)
        joined *= _MULTIPLIER
        joined ^= joined >> np.uint64(29)
        return np.unique(joined)


def minima(sets: list[np.ndarray], multipliers: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Least value of each hash function over each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    found = np.empty((len(sets), len(multipliers)), np.uint64)
    work = np.empty_like(flat)
    for i, (a, b) in enumerate(zip(multipliers, shifts)):
        np.multiply(flat, a, out=work)
        np.add(work, b, out=work)
        found[:, i] = np.minimum.reduceat(work, starts)
    return found


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One bucket key per band; the number of the band is part of the key."""
    count = signatures.shape[1] // rows
    parts = signatures.reshape(len(signatures), count, rows)
    keys = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        keys = (keys ^ parts[:, :, i]) * _MULTIPLIER
        keys ^= keys >> np.uint64(31)
    return keys


def _sketches(width: int, rows: int, count: int):
    """Batches of (id, text) to (id, n_shingles, h1, h2, keys)."""

    def run(batches):
        random = np.random.default_rng(SEED)
        multipliers = random.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = random.integers(0, 2**63, count, dtype=np.uint64)
        shingles = Shingles(width)
        for batch in batches:
            sizes, digests = [], []
            keys = np.zeros((len(batch), count // rows), np.uint64)
            chunk, places, held = [], [], 0

            def finish():
                keys[places] = bands(minima(chunk, multipliers, shifts), rows)

            for i, text in enumerate(batch.column(1)):
                found = shingles(text.as_py())
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                if len(found):
                    chunk.append(found)
                    places.append(i)
                    held += len(found)
                if held >= _CHUNK:
                    finish()
                    chunk, places, held = [], [], 0
            if chunk:
                finish()
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.ListArray.from_arrays(
                        pa.array(offsets), pa.array(keys.view(np.int64).reshape(-1))
                    ),
                ],
                ["id", "n_shingles", "h1", "h2", "keys"],
            )

    return run


def _sets(width: int):
    """Batches of (id, text) to (id, set)."""

    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            # Portions, so that lists of long texts do not add up.
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                found = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["id", "set"],
                )

    return run


def _enough(shared, size_a, size_b, percent: int):
    return 100 * shared >= percent * (size_a + size_b - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("u"), F.col("set").alias("_a"))
    b = sets.select(F.col("id").alias("v"), F.col("set").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    return (
        pairs.join(a, "u")
        .join(b, "v")
        .where(_enough(shared, F.size("_a"), F.size("_b"), percent))
        .select("u", "v")
        .distinct()
    )


def _block_links(percent: int):
    """Links between the left and the other members of one block, across components.

    For a left member the number of shared shingles with all others is one pass over their
    concatenated sets.  One link per pair (left member, component) is enough.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["set"].map(len).to_numpy()
        codes = np.unique(np.concatenate(group["set"].to_list()), return_inverse=True)[1]
        starts = np.cumsum([0, *sizes[:-1]])
        ids, labels = group["id"].to_numpy(), group["label"].to_numpy()
        present = np.zeros(codes.max() + 1, np.int64)
        links = []
        for i in np.flatnonzero(group["left"].to_numpy()):
            own = codes[starts[i] : starts[i] + sizes[i]]
            present[own] = 1
            shared = np.add.reduceat(present[codes], starts)
            present[own] = 0
            near = _enough(shared, sizes, sizes[i], percent) & (labels != labels[i])
            _, first = np.unique(labels[near], return_index=True)
            links += [(ids[i], ids[near][j]) for j in first]
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def _unfinished(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label, left) of buckets with unchecked pairs across components.

    All pairs with the least member are checked already.  Buckets with equal members
    count once.  ``left`` marks members outside the main component of the bucket.
    """
    labelled = members.join(
        labels.withColumnRenamed("node", "id"), "id", "left"
    ).withColumn("label", F.coalesce("component", "id"))
    rest = F.when(F.col("id") != F.col("least"), F.col("label"))
    same = ["_n", "_sum", "_xor"]
    open_keys = pin(
        labelled.groupBy("key")
        .agg(
            F.min(rest).alias("_low"),
            F.max(rest).alias("_high"),
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.hash("id").cast("long")).alias("_sum"),
            F.bit_xor(F.xxhash64("id")).alias("_xor"),
        )
        .where(F.col("_low") < F.col("_high"))
        .groupBy(*same)
        .agg(F.min("key").alias("key"))
        .select("key", F.col("_n").alias("n")),
        "unfinished",
    )
    rows = pin(
        labelled.join(open_keys, "key").select("key", "n", "id", "label"), "open"
    )
    main = pin(
        rows.groupBy("key", "label")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("key")
        .agg(F.max(F.struct("_n", "label")).alias("_main"))
        .select("key", F.col("_main._n").alias("_held"), F.col("_main.label").alias("_label")),
        "main",
    )
    return rows.join(main, "key").select(
        "key", "id", "label", "n", (F.col("n") - F.col("_held")).alias("n_left"),
        (F.col("label") != F.col("_label")).alias("left"),
    )


def _finish(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the comparison with the least member of each bucket has not shown."""
    rows = _unfinished(members, labels)
    blocks_left = F.ceil(F.col("n_left") / F.lit(BLOCK)).cast("int")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    i, j = F.pmod(F.xxhash64("id"), blocks_left), F.pmod(F.xxhash64("id"), blocks)
    left = rows.where("left").select(
        "key", "id", "label", "left", i.cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"),
    )
    others = rows.withColumn("left", F.lit(False)).select(
        "key", "id", "label", "left",
        F.explode(F.sequence(F.lit(0), blocks_left - 1)).alias("i"), j.cast("int").alias("j"),
    )
    return (
        left.unionByName(others)
        .join(sets, "id")
        .groupBy("key", "i", "j")
        .applyInPandas(_block_links(percent), "u long, v long")
        .distinct()
    )


def near_duplicates(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    minima_count: int = MINIMA,
    rows: int = ROWS,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row, linked from ``percent`` on."""
    narrow = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string"))
    sketches = pin(
        narrow.mapInArrow(
            _sketches(shingle, rows, minima_count),
            "id long, n_shingles long, h1 long, h2 long, keys array<long>",
        ),
        "sketches",
    )
    nodes = pin(
        sketches.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("id"), F.first("keys").alias("keys")),
        "nodes",
    )
    placed = nodes.select("id", F.explode("keys").alias("key"))
    # Aggregates are written before they are joined back: a join right above an aggregate of
    # the same key keeps the rows of a hot bucket together, a join of two tables splits them.
    shared = pin(
        placed.groupBy("key")
        .agg(F.min("id").alias("least"), F.max("id").alias("_most"))
        .where(F.col("least") < F.col("_most"))
        .drop("_most"),
        "buckets",
    )
    members = pin(placed.join(shared, "key"), "members")
    pairs = (
        members.where(F.col("id") != F.col("least"))
        .select(F.col("id").alias("u"), F.col("least").alias("v"))
        .distinct()
    )
    sets = pin(
        narrow.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(
            _sets(shingle), "id long, set array<long>"
        ),
        "sets",
    )
    links = pin(_confirmed(pairs, sets, percent), "links")
    labels = connected_components(links)
    more = pin(_finish(members, labels, sets, percent), "more")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    groups = (
        nodes.select("h1", "h2", "id")
        .join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("h1", "h2", F.coalesce("component", "id").alias("component_id"))
    )
    linked = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    return (
        sketches.withColumn("_h1", F.when(linked, F.col("h1")))
        .join(groups.withColumnRenamed("h1", "_h1"), ["_h1", "h2"], "left")
        .select(
            F.col("id").alias(key),
            "n_shingles",
            F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
        )
    )


def keep_one(documents: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents without the others of each group.

    Rows are judged by their own texts: rows that share an id but not the text are documents
    of their own, in order of a digest.  Of rows equal in id and text one stays, the least by
    its other columns.  Rows without id stay.  All columns are returned unchanged.
    """
    several = pin(
        documents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_id"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > 1)
        .select("_id"),
        "repeated",
    )
    if several.isEmpty():
        judged = near_duplicates(documents, text, key, **options)
        removed = judged.where(~F.col("kept")).select(key)
        return documents.join(removed, key, "left_anti")

    columns = documents.columns
    mark = "_"
    while any(c.startswith(mark) for c in columns):
        mark += "_"
    number, digest, times = mark + "number", mark + "digest", mark + "times"
    of, by = mark + "of", mark + "by"
    value = F.col(text).cast("string")
    digested = documents.withColumn(
        digest, F.when(F.col(key).isNotNull(), F.coalesce(F.sha2(value, 256), F.lit("")))
    )
    # Numbers in order of ids, then of digests, stand for the ids.
    numbers = pin(
        place_in_order(
            digested.where(F.col(key).isNotNull())
            .groupBy(F.col(key).alias(of), F.col(digest).alias(by))
            .agg(F.count(F.lit(1)).alias(times)),
            (),
            [of, by],
        ).select(of, by, times, F.col("before").cast("long").alias(number)),
        "numbers",
    )
    same = (F.col(key) == F.col(of)) & (F.col(digest) == F.col(by))
    numbered = pin(digested.join(numbers, same, "left").drop(of, by, digest), "numbered")
    judged = near_duplicates(numbered, text, number, **options)
    removed = judged.where(~F.col("kept")).select(number).distinct()
    kept = numbered.join(removed, number, "left_anti")
    alone = F.coalesce(F.col(times) == 1, F.lit(True))
    once = kept.where(alone).select(*columns)
    again = (
        kept.where(~alone)
        .groupBy(number)
        .agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
        .select("_row.*")
    )
    return once.unionByName(again)


def op5_minhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return near_duplicates(documents, shingle=2, percent=80)
