"""Frequency of every distinct term, by vertical bitmaps.

Method: each task turns its batches into a vertical layout: for every term and every container of
65,536 record numbers, the record numbers as a compressed bitmap (sorted 16-bit numbers, or 8 KB of
bits where that is shorter) and beside it a counter of occurrences. Containers of one term are
merged by union, the counters by sum; the document frequency is the cardinality of the union. The
merge key is (term, container), so no task ever holds a term whole, however common it is.

- a term is a run of letters and digits 0-9, single hyphens between two such runs join them;
- null and blank texts hold no term but a non-empty text counts as a row;
- repeated record numbers count as one row, for union is idempotent; their occurrences add up;
- keys that are no integers are numbered first; a row without a key is a record of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regelspur.session import cut
from regelspur.llm.consistent import ScriptModel, consistent_form, fit_scripts
from regelspur.llm.words import terms_of

CONTAINER = 1 << 16
#: From so many numbers on, bits are shorter than 16-bit numbers.
DENSE = CONTAINER // 16
#: Occurrences that a task gathers before it writes its containers.
GATHER = 2_000_000


def pack(numbers: np.ndarray) -> bytes:
    """A container of sorted distinct 16-bit numbers: as they are, or as 8 KB of bits."""
    if len(numbers) < DENSE:
        return numbers.astype(np.uint16).tobytes()
    bits = np.zeros(CONTAINER, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The numbers of a container."""
    if len(packed) < CONTAINER // 8:
        return np.frombuffer(packed, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8))).astype(np.uint16)


class _Index(dict):
    """Terms numbered in the order met."""

    def __missing__(self, term: str) -> int:
        n = self[term] = len(self)
        return n


def _containers(index: _Index, terms: list[np.ndarray], records: list[np.ndarray]) -> pd.DataFrame:
    """The vertical layout of what was gathered."""
    t, r = np.concatenate(terms), np.concatenate(records)
    names = np.array(list(index), object)
    order = np.lexsort((r, t))
    t, r = t[order], r[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
    box = r >> 16
    start = np.ones(len(t), bool)
    start[1:] = (t[1:] != t[:-1]) | (box[1:] != box[:-1])
    starts = np.flatnonzero(start)
    occurrences = np.diff(np.append(starts, len(t)))
    low, at = (r[first] & 0xFFFF).astype(np.uint16), np.append(np.cumsum(first)[starts] - 1, first.sum())
    raw = low.tobytes()
    size = np.diff(at)
    bitmaps = [raw[2 * a : 2 * b] if b - a < DENSE else pack(low[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    assert len(size) == len(bitmaps)
    return pd.DataFrame({"term": names[t[starts]], "box": box[starts], "occurrences": occurrences, "records": bitmaps})


def _numbered(rows: DataFrame) -> DataFrame:
    """(record, text) of (key, text): integers are record numbers themselves, other keys get numbers that lie close together."""
    if rows.schema["key"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        numbers = cut(rows.select("key").where("key is not null").distinct().withColumn("record", F.monotonically_increasing_id()), "records")
        alone = rows.where("key is null").withColumn("record", F.lit(None).cast("long"))
        rows = rows.where("key is not null").join(numbers, "key").unionByName(alone)
    else:
        rows = rows.withColumn("record", F.col("key").cast("long"))
    # without a key: negative numbers, no two alike
    return rows.select(F.coalesce("record", -1 - F.monotonically_increasing_id()).alias("record"), "text")


def vertical(df: DataFrame, key: str, text: str, model: ScriptModel) -> DataFrame:
    """(term, box, occurrences, records): the containers each task made."""

    def layout(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, terms, records, gathered = _Index(), [], [], 0
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                found = [terms_of(consistent_form(t, model).lower()) for t in part["text"].tolist()]
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                n = int(lengths.sum())
                terms.append(np.fromiter(map(index.__getitem__, (t for ts in found for t in ts)), np.int64, n))
                records.append(np.repeat(part["record"].to_numpy(np.int64), lengths))
                gathered += n
                if gathered >= GATHER:
                    yield _containers(index, terms, records)
                    index, terms, records, gathered = _Index(), [], [], 0
        if gathered:
            yield _containers(index, terms, records)

    rows = _numbered(df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0))
    return rows.mapInPandas(layout, "term string, box long, occurrences long, records binary")


def merge(containers: DataFrame) -> DataFrame:
    """(term, box, occurrences, records): one container a term and box, the union of all of them.

    Equal keys lie side by side after the sort; what the end of a batch leaves open is carried on
    as one container, so memory stays at a batch and 8 KB.
    """

    def unite(group: pd.DataFrame) -> tuple:
        numbers = np.unique(np.concatenate([unpack(p) for p in group["records"]]))
        return group["term"].iloc[0], group["box"].iloc[0], int(group["occurrences"].sum()), pack(numbers), len(numbers)

    def union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["term", "box", "occurrences", "records", "rows"]
        left: pd.DataFrame | None = None
        for pdf in batches:
            if left is not None:
                pdf = pd.concat([left, pdf], ignore_index=True)
            term, box = pdf["term"].to_numpy(object), pdf["box"].to_numpy()
            new = np.ones(len(pdf), bool)
            new[1:] = (term[1:] != term[:-1]) | (box[1:] != box[:-1])
            starts = np.append(np.flatnonzero(new), len(pdf))
            last = unite(pdf.iloc[starts[-2] :])
            left = pd.DataFrame([last[:4]], columns=columns[:4])
            alone = np.diff(starts[:-1]) == 1
            one = pdf.iloc[starts[:-2][alone]]
            sizes = np.fromiter((len(p) // 2 if len(p) < CONTAINER // 8 else len(unpack(p)) for p in one["records"]), np.int64, len(one))
            yield one.assign(rows=sizes)
            several = [(a, b) for a, b in zip(starts[:-2][~alone].tolist(), starts[1:-1][~alone].tolist())]
            if several:
                yield _united(pdf, several)
        if left is not None:
            yield left.assign(rows=[len(unpack(p)) for p in left["records"]])

    def _united(pdf: pd.DataFrame, several: list[tuple[int, int]]) -> pd.DataFrame:
        """All groups at once: unpack, sort by group and number, drop repeated ones, cut again."""
        records, occurrences = pdf["records"].to_numpy(object), pdf["occurrences"].to_numpy()
        numbers = [unpack(records[i]) for a, b in several for i in range(a, b)]
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        group = np.repeat(np.arange(len(several)), [b - a for a, b in several])
        both = np.unique((np.repeat(group, sizes) << 16) | np.concatenate(numbers).astype(np.int64))
        rows = np.bincount(both >> 16, minlength=len(several))
        ends = np.cumsum(rows)
        low = (both & 0xFFFF).astype(np.uint16)
        at = [a for a, _ in several]
        return pd.DataFrame({
            "term": pdf["term"].to_numpy(object)[at],
            "box": pdf["box"].to_numpy()[at],
            "occurrences": [int(occurrences[a:b].sum()) for a, b in several],
            "records": [pack(low[e - n : e]) for e, n in zip(ends.tolist(), rows.tolist())],
            "rows": rows,
        })

    ordered = containers.repartition("term", "box").sortWithinPartitions("term", "box")
    return ordered.mapInPandas(union, "term string, box long, occurrences long, records binary, rows long")


def term_frequencies(df: DataFrame, key: str, text: str, least: int = 3, most: float = 0.25, model: ScriptModel | None = None) -> DataFrame:
    """(term, occurrences, rows, mark): ``rare`` in fewer than ``least`` rows, ``common`` in more than
    the share ``most`` of the non-empty rows, else null. A term both rare and common is rare."""
    model = model or fit_scripts(df, text)
    total = df.where(F.length(text) > 0).agg(F.count(F.lit(1)).alias("total"))
    counted = merge(vertical(df, key, text, model)).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("rows").alias("rows"))
    mark = F.when(F.col("rows") < least, "rare").when(F.col("rows") > most * F.col("total"), "common")
    return counted.crossJoin(F.broadcast(total)).select("term", "occurrences", "rows", mark.alias("mark"))  # one row of totals
