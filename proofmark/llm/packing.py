"""Operator 8: best-fit packing with certified bin counts.

Every text becomes its ids and a closing id 0; longer ones are cut into pieces of the
capacity.  Pieces are dealt evenly to groups of bounded size and each group is packed by
best-fit decreasing.  Dual feasible functions bound from below how many bins the group's
lengths need.  Where the group needs exactly that many and wastes less than a bin, its
bins are certified; a group with a gap gives up its loosest bins, and the given-up
documents of all groups are dealt anew to fewer groups and packed again.

Cases: a null or empty text is one piece of length 1 (the closing id); repeated rows are
packed one by one; ties in length keep the order of dealing; an empty table gives an empty
result; input columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.llm.vocabulary import WordIds, loaded
from proofmark.registry.base import table
from proofmark.workspace import pin

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
# Pieces packed by one task.
GROUP = 60_000
# A group with a gap gives up the bins filled less than this share.
LOOSE = 15 / 16

_PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, _deal long"
)
_PACKED = _PIECES + ", _bin long, offset long, _given_up boolean, certified boolean"


def cut(
    documents: DataFrame, text: str, key: str, path: str, capacity: int
) -> DataFrame:
    """One row per piece; ``_deal`` counts the pieces of a task, for even groups."""

    def pieces(batches):
        encoder = loaded(WordIds, path)
        width, deal = 4 * capacity, 0
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in
                                        ("doc_id", "piece", "start", "length", "crc", "deal")}
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, value in zip(ids, texts):
                data = encoder(value.as_py() or "") + b"\0\0\0\0"
                for i in range(0, len(data), width):
                    part = data[i : i + width]
                    columns["doc_id"].append(doc_id)
                    columns["piece"].append(i // width)
                    columns["start"].append(i // 4)
                    columns["length"].append(len(part) // 4)
                    columns["crc"].append(zlib.crc32(part))
                    if not deal:
                        deal = zlib.crc32(part) + 1
                    columns["deal"].append(deal)
                    deal += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns.values(), types)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_deal"],
            )

    narrow = documents.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return narrow.mapInArrow(pieces, _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins.

    Open bins are kept by their free space; a bit mask of the occurring spaces finds the
    tightest one that fits.
    """
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    mask = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            stack = open_bins[free]
            found = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            found, free, used = used, capacity, used + 1
        bins[i], offsets[i] = found, capacity - free
        free -= length
        if free:
            if not open_bins[free]:
                mask |= 1 << free
            open_bins[free].append(found)
    return bins, offsets, used


def needed_bins(lengths: np.ndarray, capacity: int) -> float:
    """Lower bound of the bins: the largest total under a family of dual feasible functions.

    The identity gives the area.  For a threshold t <= half, lengths above capacity - t
    count as whole bins, those below t as nothing, the others by their length.  For k, the
    rounding function counts floor((k+1) * x) / k, or x itself where (k+1) * x is whole.
    """
    if not len(lengths):
        return 0.0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.float64)
    sizes = np.arange(capacity + 1)
    best = float((counts * sizes).sum() / capacity)
    whole = np.cumsum(counts[::-1])[::-1]
    area = np.concatenate([[0.0], np.cumsum(counts * sizes)])
    for t in range(1, capacity // 2 + 1):
        large = whole[capacity - t + 1]
        middle = (area[capacity - t + 1] - area[t]) / capacity
        best = max(best, float(large + middle))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes / capacity, (scaled // capacity) / k)
        best = max(best, float((counts * value).sum()))
    return best


def _packer(capacity: int, last: bool):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_deal", kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        bound = needed_bins(lengths, capacity)
        certified = used <= int(np.ceil(bound - 1e-6))
        given_up = np.zeros(len(bins), bool)
        if not last and used - bound > 1e-6:
            fill = np.bincount(bins, weights=lengths, minlength=used)
            loose = fill < LOOSE * capacity if not certified else fill == fill.min()
            given_up = loose[bins]
        return group.drop(columns="_part").assign(
            _bin=bins, offset=offsets, _given_up=given_up, certified=certified
        )

    return pack


def pack_documents(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    path: str | None = None,
    capacity: int = CAPACITY,
    group: int = GROUP,
) -> DataFrame:
    """Pieces with their place: sequence_id, offset; ``certified`` marks proven groups.

    Each round keeps at most the given-up share, dealt to strictly fewer groups, and the
    last round is one group of at most ``group`` pieces, so the rounds end.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    rest = pin(cut(documents, text, key, path, capacity), "pieces")
    kept, groups, level = [], None, 0
    while True:
        n = rest.count()
        few = max(1, -(-n // group))
        last = few == 1 or (groups is not None and few >= groups)
        groups = few
        packed = pin(
            rest.withColumn("_part", F.pmod(F.col("_deal"), F.lit(groups)))
            .groupBy("_part")
            .applyInPandas(_packer(capacity, last), _PACKED)
            .withColumn(
                "sequence_id",
                F.shiftleft(F.lit(level).cast("long"), 58)
                + F.shiftleft(F.pmod(F.col("_deal"), F.lit(groups)), 26)
                + F.col("_bin"),
            ),
            "packed",
        )
        kept.append(packed.where(~F.col("_given_up")))
        if last:
            break
        rest = packed.where("_given_up").select(*rest.columns)
        level += 1
    result = kept[0]
    for part in kept[1:]:
        result = result.unionByName(part)
    return result.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"
    )


def op8_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return pack_documents(table(spark, directory, "documents"))
