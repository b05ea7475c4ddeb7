"""Mixing sources to target weights.

Method: the tokens of each source are packed into blocks of fixed length. For every output shard the
number of blocks of each source is drawn from a multinomial with the target shares. The slots of a
source, numbered through all shards, are mapped through a pseudorandom permutation of its block
numbers (a Feistel network, a new one each time the source has been used up), and blocks are joined
by number. What a source then lacks of its target, by the chance of the draw, is wanted in slots of one
more shard. A source can be used up ``max_repeats`` times; slots beyond that stay empty, and a source
with empty slots that has not reached its target falls short.

Packing runs in buckets of a source, so no task sorts a whole source, however large its share of the
rows. Sources, buckets and shards may be any number: their counts, offsets and draws are tables, made in
tasks; sources are drawn in groups first and in their group then.

- null and empty texts have no tokens; documents without a source or of a source that is not in
  the targets are not drawn; a target source without documents has 0 tokens and falls short;
- repeated rows count as so many documents; shares need not sum to one (they are scaled);
- the output has as many blocks as the documents of all target sources fill, and those of the last shard;
- null sources in the targets are left out, of repeated ones the shares add up and the largest max_repeats counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regelspur.session import cut

#: Tokens of a block, blocks of an output shard, slots made at once.
BLOCK, SHARD_BLOCKS, SLICE = 512, 4096, 1 << 20
#: Documents that a packing bucket holds on average.
BUCKET_ROWS = 20_000
#: Sources of a group on average, shards whose counts are summed together.
GROUP_SOURCES, SHARD_GROUP = 1024, 4096
#: Sources up to which their small table is broadcast to the documents; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 250_000


#: How texts are cut before byte pairs are merged (fixed value: the public pattern that vocabularies of this kind are made with).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """A public vocabulary file of this machine; pass a path of your own on others."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, to: str = "tokens", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the number of tokens of ``text``, special tokens read as ordinary text; null and empty: 0.

    ``vocabulary`` is a file of lines (base64 of a token, its rank), ``pattern`` the one it was made with.
    """
    path = vocabulary or default_vocabulary()

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path, pattern).encode_ordinary
        for s in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int64")

    return df.withColumn(to, count(F.col(text)))


def permuted(numbers: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 applied to ``numbers``: a Feistel network, walked until it lands inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & mask
        for k in range(4):
            f = (b + np.uint64((seed * 4 + k + 1) % 2**32)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(20)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _seed(source: str, epoch: int, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{seed}|{source}|{epoch}") % 2**30


class Mix:
    """A mixing plan: the packed sources, the drawn blocks and the report."""

    def __init__(self, docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, block: int = BLOCK, seed: int = 42, vocabulary: str | None = None, pattern: str = PATTERN):
        self.block, self.seed, self.spark = block, seed, docs.sparkSession
        wanted = targets.where("source is not null").groupBy("source").agg(
            F.greatest(F.lit(0.0), F.sum(F.col("target_share").cast("double"))).alias("target_share"), F.greatest(F.lit(0), F.max(F.col("max_repeats").cast("int"))).alias("max_repeats")
        )
        self.targets = cut(wanted.na.fill(0.0, ["target_share"]).na.fill(0, ["max_repeats"]), "targets")
        self.sources = self.targets.count()
        named = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.col(source).alias("source"))
        named = named.join(self._small(self.targets.select("source")), "source", "left_semi")
        self.sizes = cut(token_counts(named, "text", "tokens", vocabulary, pattern).select("doc", "source", "tokens"), "sizes")
        totals = self.sizes.groupBy("source").agg(F.count_if(F.col("tokens") > 0).alias("docs"), F.sum("tokens").alias("tokens"))
        totals = self.targets.join(totals, "source", "left").na.fill(0, ["docs", "tokens"])
        #: (source, target_share, max_repeats, docs, tokens, buckets), a row a target source
        self.totals = cut(totals.withColumn("buckets", F.ceil(F.greatest(F.col("docs"), F.lit(1)) / BUCKET_ROWS)), "totals")
        whole = self.totals.agg(F.sum("tokens").alias("tokens"), F.sum("target_share").alias("share")).first()
        self.total, self.share = whole["tokens"] or 0, whole["share"] or 1.0
        self.packed = cut(self._pack(), "packed")
        #: (source, blocks, ...), a row a target source
        self.held = self.totals.join(self.packed.groupBy("source").agg(F.max("block").alias("last")), "source", "left").withColumn("blocks", F.coalesce(F.col("last") + 1, F.lit(0))).drop("last")
        self.held = cut(self.held, "held")
        self.slots = self.held.agg(F.sum("blocks").alias("n")).first()["n"] or 0
        self.shards = -(-self.slots // SHARD_BLOCKS)
        self.tokens_of = self.packed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
        self.counts = cut(self._draw(), "counts")
        self.counts = self.counts.unionByName(cut(self._rest(), "rest"))

    def _small(self, sources: DataFrame) -> DataFrame:
        return F.broadcast(sources) if self.sources <= BROADCAST_SOURCES else sources

    def _pack(self) -> DataFrame:
        """(source, block, doc, from_token, tokens): the part of a document in each block it reaches into.

        A bucket is packed by itself; its last block may be short.
        """
        at = self._small(self.totals.select("source", "buckets"))
        rows = self.sizes.where("tokens > 0").join(at, "source").withColumn("bucket", F.pmod(F.xxhash64("doc", F.lit(self.seed)), F.col("buckets")))
        b = F.lit(self.block)
        filled = rows.groupBy("source", "bucket").agg(F.ceil(F.sum("tokens") / b).alias("n"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        offsets = filled.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
        ends = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc"), "doc").rowsBetween(Window.unboundedPreceding, 0))
        placed = rows.withColumn("end", ends).withColumn("start", F.col("end") - F.col("tokens")).join(offsets, ["source", "bucket"])
        spread = placed.select("source", "offset", "doc", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b))).alias("local"))
        low, high = F.greatest("start", F.col("local") * b), F.least("end", (F.col("local") + 1) * b)
        return spread.select("source", (F.col("offset") + F.col("local")).alias("block"), "doc", (low - F.col("start")).alias("from_token"), (high - low).alias("tokens"))

    def pieces(self) -> DataFrame:
        """(source, block, doc, from_token, tokens): the part of a document in each block it reaches into."""
        return self.packed

    def _draw(self) -> DataFrame:
        """(shard, source, first, n): multinomial counts, a generator a shard, and the first slot of each.

        Groups of sources are drawn first, then the sources of a group, which is the same multinomial.
        """
        groups, seed, slots = max(1, -(-self.sources // GROUP_SOURCES)), self.seed, self.slots
        of = self.targets.where("target_share > 0").select(F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int").alias("g"), "source", "target_share")
        members = of.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("source", "target_share"))).alias("members"), F.sum("target_share").alias("share"))
        heavy = np.zeros(groups)
        for r in members.select("g", "share").collect():  # a thousandth of the sources
            heavy[r["g"]] = r["share"]
        sent = self.spark.sparkContext.broadcast(heavy / (heavy.sum() or 1.0))

        def of_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for shard in pdf["id"].tolist():
                    n = min(SHARD_BLOCKS, slots - shard * SHARD_BLOCKS)
                    drawn = np.random.default_rng([seed, shard]).multinomial(n, sent.value)
                    g = np.flatnonzero(drawn)
                    yield pd.DataFrame({"shard": shard, "g": g, "k": drawn[g]})

        def of_sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for shard, g, k, rows in zip(pdf["shard"].tolist(), pdf["g"].tolist(), pdf["k"].tolist(), pdf["members"]):
                    share = np.array([r["target_share"] for r in rows])
                    drawn = np.random.default_rng([seed, shard, g + 1]).multinomial(k, share / share.sum())
                    there = np.flatnonzero(drawn)
                    yield pd.DataFrame({"shard": shard, "source": [rows[i]["source"] for i in there], "n": drawn[there]})

        shards = self.spark.range(self.shards if heavy.sum() > 0 else 0)
        drawn = shards.mapInPandas(of_groups, "shard long, g int, k long").join(members.select("g", "members"), "g").mapInPandas(of_sources, "shard long, source string, n long")
        drawn = cut(drawn, "drawn").withColumn("part", F.floor(F.col("shard") / SHARD_GROUP))
        # running sums in two steps, so that no task sums all shards of a source one by one
        sums = drawn.groupBy("source", "part").agg(F.sum("n").alias("sum"))
        base = F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        inner = F.sum("n").over(Window.partitionBy("source", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
        joined = drawn.withColumn("inner", inner).join(sums.select("source", "part", base.alias("base")), ["source", "part"])
        return joined.select("shard", "source", (F.coalesce("base", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("first"), "n")

    def _rest(self) -> DataFrame:
        """The slots of the last shard: what the draw lacks of a source's target, in blocks.

        Every bucket may end in a short block, so one block more for each is wanted: if all of a source's turns
        cannot reach the target, some of these slots stay empty.
        """
        got = self.filled().groupBy("source").agg(F.sum("tokens").alias("reached"))
        n = self.counts.groupBy("source").agg(F.sum("n").alias("n"))
        lack = F.ceil((F.col("target_share") / F.lit(self.share) * F.lit(self.total) - F.coalesce("reached", F.lit(0))) / self.block)
        rows = self.held.join(got, "source", "left").join(n, "source", "left").withColumn("lack", lack).where("lack > 0")
        return rows.select(F.lit(self.shards).cast("long").alias("shard"), "source", F.coalesce("n", F.lit(0)).alias("first"), (F.col("lack") + F.col("buckets") + 1).alias("n"))

    def slot_table(self) -> DataFrame:
        """(shard, source, slot, block, turn): every slot and the block its permutation gives it; an empty slot has none."""
        seed = self.seed

        def numbered(rows: list[tuple]) -> pd.DataFrame:
            """All slots of the rows at once; a permutation serves all slots of its source and turn."""
            shard, source, first, n, blocks, repeats = (np.array(c) for c in zip(*rows))
            at = np.repeat(np.arange(len(n)), n)
            slot = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[at]
            size = np.maximum(1, blocks)[at]
            turn = slot // size
            block = np.full(len(slot), -1, np.int64)
            names, number = np.unique(source.astype(str), return_inverse=True)
            open_ = np.flatnonzero((turn < repeats[at]) & (blocks[at] > 0))
            key = number[at[open_]] * (int(turn.max()) + 1) + turn[open_]
            order = np.argsort(key, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(part):
                    i = open_[part]
                    block[i] = permuted(slot[i] % size[i], int(size[i[0]]), _seed(str(source[at[i[0]]]), int(turn[i[0]]), seed))
            return pd.DataFrame({"shard": shard[at], "source": source[at], "slot": slot, "block": block, "turn": turn})

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                held, count = [], 0
                for shard, source, first, n, blocks, repeats in pdf.itertuples(index=False):
                    for start in range(first, first + n, SLICE):
                        k = min(SLICE, first + n - start)
                        held.append((shard, source, start, k, blocks, repeats))
                        count += k
                        if count >= SLICE:
                            yield numbered(held)
                            held, count = [], 0
                if held:
                    yield numbered(held)

        rows = self.counts.join(self._small(self.held.select("source", "blocks", "max_repeats")), "source").select("shard", "source", "first", "n", "blocks", "max_repeats")
        made = rows.repartition("shard", "source").mapInPandas(fill, "shard long, source string, slot long, block long, turn long")
        return made.withColumn("block", F.nullif("block", F.lit(-1).cast("long")))

    def filled(self) -> DataFrame:
        """(source, block, tokens, turn): every slot that has a block, with the tokens of that."""
        return self.slot_table().where("block is not null").hint("merge").join(self.tokens_of, ["source", "block"]).select("source", "block", "tokens", "turn")

    def drawn(self) -> DataFrame:
        """(shard, source, slot, turn, block, doc, from_token, tokens): what was drawn, a row a part of a document."""
        # both sides grow with the data, which the planner cannot tell of the slots: no broadcast
        full = self.slot_table().where("block is not null")
        return full.hint("merge").join(self.pieces(), ["source", "block"]).select("shard", "source", "slot", "turn", "block", "doc", "from_token", "tokens")

    def report(self) -> DataFrame:
        """One row a target source: what it has, what it should and what it does contribute.

        ``short``: slots of it stayed empty and what was drawn does not reach its target.
        """
        slots = self.slot_table().join(self.tokens_of.hint("merge"), ["source", "block"], "left")
        reached = slots.groupBy("source").agg(
            F.sum(F.coalesce("tokens", F.lit(0))).alias("drawn_tokens"), F.count_if(F.col("block").isNull()).alias("empty_slots"), F.max(F.when(F.col("block").isNotNull(), F.col("turn"))).alias("last_turn")
        )
        out = self.totals.join(reached, "source", "left").na.fill(0, ["drawn_tokens", "empty_slots"])
        target = F.col("target_share") / F.lit(self.share) * F.lit(self.total)
        out = cut(out.withColumn("target_tokens", target), "report")
        drawn = F.broadcast(out.agg(F.sum("drawn_tokens").alias("all_tokens")))  # one row
        share = F.try_divide(F.col("drawn_tokens"), F.col("all_tokens"))
        short = (F.col("empty_slots") > 0) & (F.col("drawn_tokens") < F.col("target_tokens"))
        return out.crossJoin(drawn).select(
            "source", "target_share", "max_repeats", "tokens", "target_tokens", short.alias("short"), "drawn_tokens", "empty_slots",
            F.coalesce(share, F.lit(0.0)).alias("actual_share"), F.coalesce(F.col("last_turn") + 1, F.lit(0)).alias("repeats"),
        )
