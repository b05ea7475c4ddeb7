"""Near-duplicate records with small edits.

Method: a fingerprint of min-hash slots over the distinct runs of ``n`` words is split into blocks; their
number and width follow from the threshold (``shape``). Two texts that differ in fewer slots than there are
blocks share a block (pigeonhole); more distant ones do so with probability 1 - (1 - s^width)^blocks, at the
threshold 0.993 or more (0.994 at 0.6 with 21 blocks of 3, 0.9988 at 0.65). Texts are joined on equal blocks, the Hamming distance
of two bits a slot is verified inside that join, and the pairs left are checked exactly. ``exact=True`` adds
the pairs that share one of their rarest runs (a prefix that no similar pair can avoid), so none is missing.

Texts of equal words are one class, represented by its smallest id, so a group of copies, however
large, costs one representative. Classes are joined with classes; members are attached after. Blocks
of more than ``HOT`` classes are split into parts and joined part by part, and so are the members of
large classes where pairs of rows are asked for, so no task holds a group whole.

- null or blank texts, and texts of fewer than ``n`` words: in no pair, a class of their own;
- repeated ids: kept as they come; ties: the smaller id comes first;
- empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regelspur.session import cut, fits
from regelspur.llm.consistent import ScriptModel, consistent_form, fit_scripts
from regelspur.llm.words import MIX, Hashes, mix, runs, shingles, words_of

#: Classes of a block, and members of a class, that are joined in one piece.
HOT, HOT_MEMBERS = 2000, 1000
#: Copies of a class from which on its members are told by a broadcast of such classes (at most rows / COPIES).
COPIES = 100_000
#: Share of the pairs at the threshold that may share no block, and blocks and slots at most.
MISSED, MOST_BLOCKS, MOST_SLOTS = 0.0062, 50, 80
#: Ids up to which the ids of candidates are broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 250_000


def shape(threshold: float) -> tuple[int, int, int]:
    """(blocks, slots of a block, largest Hamming distance) for a threshold.

    Blocks are as wide as ``MISSED`` allows. Of 64 slots at most two bits each are compared; three of four that
    differ do so in them, and four deviations more than at the threshold are let through.
    """
    if not 0.1 <= threshold <= 1:
        raise ValueError("a threshold from 0.1 to 1; below it nearly all texts would have to be compared")
    for width in range(8, 0, -1):
        blocks = max(1, math.ceil(math.log(MISSED) / math.log(1 - min(threshold, 0.999) ** width)))
        if blocks <= MOST_BLOCKS and blocks * width <= MOST_SLOTS:
            break
    slots, differ = min(64, blocks * width), 0.75 * (1 - threshold)
    return blocks, width, min(slots, math.floor(slots * differ + 4 * math.sqrt(slots * differ * (1 - differ))))


def _hashed(texts: list[str], model: ScriptModel, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and the number of words of each."""
    words = [words_of(consistent_form(t, model).lower()) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    return hashes.array(flat), lengths


def fingerprints(df: DataFrame, key: str, text: str, model: ScriptModel, n: int, number: int, width: int) -> DataFrame:
    """(id, words: hash of the word sequence, blocks: array of block hashes, low, high: two bits a slot)."""

    def fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        seeds = mix(np.arange(1, number * width + 1, dtype=np.uint64) * MIX)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                hashed, lengths = _hashed(part["text"].tolist(), model, hashes)
                keep = lengths >= n
                ends = np.cumsum(lengths)
                if not keep.any():
                    continue
                inside = runs(lengths, n)
                found = shingles(hashed, n)[inside]
                starts = np.concatenate([[0], np.cumsum(lengths[keep] - n + 1)[:-1]])
                slots = np.empty((len(seeds), int(keep.sum())), np.uint64)
                for k, seed in enumerate(seeds):
                    slots[k] = np.minimum.reduceat((found ^ seed) * MIX, starts)
                blocks = np.zeros((number, slots.shape[1]), np.uint64)
                for k in range(width):
                    blocks = mix(blocks * MIX + slots[k::width] + np.uint64(k))
                blocks = mix(blocks + np.arange(number, dtype=np.uint64)[:, None])
                low, high = np.zeros((2, slots.shape[1]), np.uint64)
                for k in range(min(64, len(slots))):
                    two = mix(slots[k])
                    low |= (two & np.uint64(1)) << np.uint64(k)
                    high |= (two >> np.uint64(1) & np.uint64(1)) << np.uint64(k)
                yield pd.DataFrame({
                    "id": part["id"].to_numpy()[keep],
                    "words": [xxhash.xxh3_128_digest(hashed[e - c : e].tobytes()) for e, c in zip(ends[keep], lengths[keep])],
                    "blocks": list(blocks.T.astype(np.int64)),
                    "low": low.astype(np.int64),
                    "high": high.astype(np.int64),
                })

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(fingerprint, f"id {kind}, words binary, blocks array<long>, low long, high long")


def _sets(df: DataFrame, key: str, text: str, ids: DataFrame, model: ScriptModel, n: int) -> DataFrame:
    """(id, runs: the distinct hashes of its runs of words) of the rows whose id is among ``ids``."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for pdf in batches:
            hashed, lengths = _hashed(pdf["text"].tolist(), model, hashes)
            found, ends = shingles(hashed, n).astype(np.int64), np.cumsum(lengths)
            yield pd.DataFrame({"id": pdf["id"], "runs": [np.unique(found[e - c : max(e - c, e - n + 1)]) for e, c in zip(ends, lengths)]})

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kept = rows.join(F.broadcast(ids) if fits(ids, BROADCAST_IDS) else ids, "id", "left_semi")
    return kept.mapInPandas(build, f"id {rows.schema['id'].dataType.simpleString()}, runs array<long>")


def _block_join(classes: DataFrame, far: int) -> DataFrame:
    """(a, b): the classes that share a block and whose fingerprints are near.

    A block of more than ``HOT`` classes is cut into parts; every two parts of it are a key of their own.
    """
    rows = classes.select("rep", "low", "high", F.explode("blocks").alias("block"))
    hot = cut(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("block", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "hot")
    few = F.broadcast(hot) if fits(hot, BROADCAST_IDS) else hot
    usual = rows.join(few, "block", "left_anti").withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).withColumn("part", F.lit(0))
    split = rows.join(few, "block").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    columns = ["block", "i", "j", "part", "rep", "low", "high"]
    keyed = usual.select(columns).unionByName(split.select(columns)) if hot.limit(1).count() else usual.select(columns)
    a, b = keyed.alias("a"), keyed.alias("b")
    differ = F.col("a.low").bitwiseXOR(F.col("b.low")).bitwiseOR(F.col("a.high").bitwiseXOR(F.col("b.high")))
    same = (F.col("a.block") == F.col("b.block")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    once = (F.col("a.rep") < F.col("b.rep")) & ((F.col("a.i") == F.col("a.j")) | (F.col("a.part") != F.col("b.part")))
    return a.join(b, same & once & (F.bit_count(differ) <= far)).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def _prefix_join(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the sets that share one of their rarest runs. Two sets of that similarity share one of the first
    size - ceil(threshold * size) + 1 of each, in any order that both keep to."""
    runs_ = sets.select(F.col("id").alias("rep"), F.size("runs").alias("size"), F.explode("runs").alias("run"))
    often = runs_.groupBy("run").agg(F.count(F.lit(1)).alias("df"))
    ranked = runs_.join(often, "run").withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("df", "run")))
    kept = ranked.where(F.col("at") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).select("rep", "size", "run")
    a, b = kept.alias("a"), kept.alias("b")
    alike = F.least("a.size", "b.size") >= F.lit(threshold) * F.greatest("a.size", "b.size") - 1e-9
    return a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.rep") < F.col("b.rep")) & alike).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def similar_classes(df: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 5, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes of equal words and the similar pairs of them.

    Returns ``members(id, rep, copies)``, a row for each text with a run of ``n`` words, and
    ``pairs(a, b, similarity)`` with a < b, both representatives.
    """
    number, width, far = shape(threshold)
    model = fit_scripts(df, text)
    prints = cut(fingerprints(df, key, text, model, n, number, width), "prints")
    grouped = prints.groupBy("words").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), *(F.any_value(c).alias(c) for c in ("blocks", "low", "high")))
    classes = cut(grouped, "classes")
    many = classes.where(F.col("copies") > COPIES).select("words", "rep", "copies")
    rows = prints.select("id", "words")
    members = rows.join(classes.where(F.col("copies") <= COPIES).select("words", "rep", "copies"), "words")
    if many.limit(1).count():
        members = members.unionByName(rows.join(F.broadcast(many) if fits(many, BROADCAST_IDS) else many, "words"))
    members = members.select("id", "rep", "copies")
    found = _block_join(classes, far)
    if exact:
        found = found.unionByName(_prefix_join(_sets(df, key, text, classes.select(F.col("rep").alias("id")), model, n), threshold))
    candidates = cut(found.distinct(), "candidates")
    ids = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _sets(df, key, text, ids, model, n)
    both = (
        candidates.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b")), "b")
        .withColumn("shared", F.size(F.array_intersect("runs_a", "runs_b")))
    )
    similarity = F.col("shared") / (F.size("runs_a") + F.size("runs_b") - F.col("shared"))
    pairs = both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    return members, pairs


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 5, exact: bool = False) -> DataFrame:
    """Every pair of similar rows (a < b), copies included: members of similar classes and of one class.

    A class of many members is joined in parts of ``HOT_MEMBERS``.
    """
    members, pairs = similar_classes(df, key, text, threshold, n, exact)
    of = F.ceil(F.col("copies") / HOT_MEMBERS).cast("int")
    parted = members.withColumn("parts", of).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    large = members.where(F.col("copies") > HOT_MEMBERS).select("rep", of.alias("parts")).distinct()
    large = F.broadcast(large) if fits(large, BROADCAST_IDS) else large

    def in_parts(rows: DataFrame, c: str) -> DataFrame:
        """A row of pairs once for each part of its class ``c``."""
        known = rows.join(large.select(F.col("rep").alias(c), "parts"), c, "left")
        return known.withColumn(f"part_{c}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    left = parted.select(F.col("rep").alias("a"), F.col("part").alias("part_a"), F.col("id").alias("id_a"))
    right = parted.select(F.col("rep").alias("b"), F.col("part").alias("part_b"), F.col("id").alias("id_b"))
    across = in_parts(in_parts(pairs.select("a", "b"), "a").join(left, ["a", "part_a"]), "b").join(right, ["b", "part_b"]).select("id_a", "id_b")
    several = parted.where("copies > 1").select(F.col("rep").alias("b"), F.col("id").alias("id_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_b"))
    within = several.join(right, ["b", "part_b"]).where("id_a < id_b").select("id_a", "id_b")
    both = across.unionByName(within)
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root): the smallest id of each connected component of ``pairs(a, b)``.

    Every round each node takes the smallest label around it and then its label's label; a round is
    a join and two aggregations, written to the shared folder. It ends when no label changes.
    """
    links = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = cut(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels").withColumnRenamed("a", "id")
    for _ in range(rounds):
        around = links.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("least"))
        least = labels.join(around, labels["id"] == around["a"]).select("id", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        # hooking: the old root also learns the smaller label, so long chains shrink quickly
        told = least.select(F.col("old").alias("id"), "root").unionByName(least.select("id", "root")).groupBy("id").agg(F.min("root").alias("next"))
        jump = told.select(F.col("id").alias("next"), F.col("next").alias("further"))
        new = cut(
            told.join(jump, "next", "left")
            .select("id", F.coalesce("further", "next").alias("root"))
            .join(labels.select("id", F.col("root").alias("before")), "id"),
            "labels",
        )
        changed = new.where(F.col("root") != F.col("before")).limit(1).count()
        labels = new.select("id", "root")
        if not changed:
            return labels
    raise RuntimeError(f"no end after {rounds} rounds")


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """One row a record: its id, its group (the smallest id in it), its class of equal words and the
    number of other classes it is similar to. Records similar to none stand alone."""
    members, pairs = similar_classes(df, key, text, threshold, n)
    pairs = cut(pairs.select("a", "b"), "pairs")
    roots = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    own = members.drop("copies").join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(links, "rep", "left")
    everyone = df.select(F.col(key).alias("id"))
    return everyone.join(own, "id", "left").select(
        "id",
        F.coalesce("root", "rep", "id").alias("group_id"),
        F.coalesce("rep", "id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )
