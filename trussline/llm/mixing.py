"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trussline.operators.common import blank_trim, cut, salted_join

#: Blocks that the whole mixture is made of, at least: shares are exact to a part in so many.
BLOCKS = 20_000
#: Blocks for each shard that serves the mixture, at least.
SHARD_BLOCKS = 64
#: Rows that a shard of a source holds, about, and more where that would make too many shards.
SHARD_ROWS = 20_000
#: Shards of all sources together, about: bounds what the driver holds.
SHARDS = 8192
#: Records that a shard gives to the mixture, about, before the source's next one serves too.
LEAST_RECORDS = 64


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, tokens: size of each text by the public tokenizer, 0 for null or empty."""
    from trussline.llm.bpe import vocabulary_path

    place = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(place, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            sizes = [len(own.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": sizes})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, tokens long")


def apportion[K](weights: Mapping[K, float], seats: int, caps: Mapping[K, int]) -> dict[K, int]:
    """Seats by highest quotients weight / (2k + 1), none beyond a source's cap; ties by name.

    Seats that no source may take are left over.
    """
    got = dict.fromkeys(weights, 0)
    heap = [(-w, s) for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, s = heapq.heappop(heap)
        got[s] += 1
        if got[s] < caps[s]:
            heapq.heappush(heap, (-weights[s] / (2 * got[s] + 1), s))
    return got


def _shards(rows: int, wanted: float, share_of_rows: float) -> tuple[int, int]:
    """Shards that a source's records are spread over, and how many of them serve the mixture.

    As many as the rows ask for, within the source's part of :data:`SHARDS`. Of a source that
    gives few of its records only so many shards serve that each gives :data:`LEAST_RECORDS`.
    """
    n = max(1, min(-(-rows // SHARD_ROWS), int(SHARDS * share_of_rows)))
    return n, max(1, min(n, int(rows * wanted / LEAST_RECORDS)))


def mixture(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``sizes``: doc_id, source, tokens. ``targets``: source, target_share, max_repeats. The
    mixture: doc_id, source, tokens, copies (1 or more). The report has a row for every source
    of either table: its target, supply, blocks, tokens in the mixture, and share.

    Without ``total`` the mixture is as large as all targets allow: the least of cap / share
    over the sources that have records. A target without records cannot be met; the others
    keep their proportions. Records of sources without a target, and records without tokens,
    are not used. Repeated targets: the first by share and repeats counts.

    Blocks of equal tokens are apportioned to the sources, and each source's blocks to its
    shards. A shard's records, in a seeded order, make up its blocks; it gives whole rounds of
    all blocks first, and then as many blocks as its quota has left, from a seeded one on. A
    record goes with the block that its middle lies in. All that the driver holds is a row for
    each target and each shard, of which there are :data:`SHARDS` and one for each target at most.
    """
    spark = sizes.sparkSession
    named = targets.select(blank_trim("source").alias("source"), F.coalesce(F.greatest(F.nanvl("target_share", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce(F.greatest("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")).where("source <> ''")
    named = named.groupBy("source").agg(F.max(F.struct("target_share", (-F.col("max_repeats")).alias("less"))).alias("t")).select("source", "t.target_share", (-F.col("t.less")).alias("max_repeats"))
    placed = sizes.select("doc_id", blank_trim("source").alias("source"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("tokens"))
    supply = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("tokens").alias("supply_tokens"))
    open_ = {r["source"]: r for r in named.join(supply, "source").where("target_share > 0 and max_repeats > 0 and supply_tokens > 0").collect()}
    whole = sum(r["target_share"] for r in open_.values())
    weights = {s: r["target_share"] / whole for s, r in open_.items()}
    caps = {s: r["supply_tokens"] * r["max_repeats"] for s, r in open_.items()}
    most = min((caps[s] / w for s, w in weights.items()), default=0.0)
    size = min(most, total) if total is not None else most
    all_rows = sum(r["n_records"] for r in open_.values())
    shards = {s: _shards(r["n_records"], size * weights[s] / r["supply_tokens"], r["n_records"] / all_rows) for s, r in open_.items()}
    count = max(BLOCKS, SHARD_BLOCKS * sum(m for _, m in shards.values()))
    block = max(1.0, size / count)
    blocks = apportion(weights, int(size // block), {s: int(c / block) for s, c in caps.items()})

    at = lambda i: F.coalesce(*[F.when(F.col("source") == s, F.lit(n[i])) for s, n in shards.items()], F.lit(0)) if shards else F.lit(0)
    sharded = placed.where("tokens > 0").withColumn("shard", F.when(at(0) > 0, F.pmod(F.xxhash64("doc_id", F.lit(seed)), at(0))).cast("int")).where(F.col("shard") < at(1))
    held: dict[str, dict[int, int]] = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).toLocalIterator():
        held.setdefault(r["source"], {})[r["shard"]] = r["t"]
    quotas = spark.createDataFrame([q for s, of in held.items() for q in _quotas(s, of, blocks[s], block, open_[s]["max_repeats"], seed)], "source string, shard int, held long, rounds int, first double, rest double")
    chosen = salted_join(sharded, quotas, ["source", "shard"], F.lit(False), F.col("doc_id"), "inner")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "tokens")
    middle = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens") / 2
    copies = F.col("rounds") + F.when(F.pmod(F.col("middle") - F.col("first"), F.col("held").cast("double")) < F.col("rest"), 1).otherwise(0)
    mix = chosen.withColumn("middle", middle).withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    return mix, _report(mix, named, supply, weights, blocks)


def _quotas(source: str, held: dict[int, int], seats: int, block: float, repeats: int, seed: int) -> list[tuple]:
    """A source's blocks apportioned to its shards: held tokens, whole rounds of them, and the
    place of the first token and the number of tokens that the blocks beyond those have.

    Each shard is cut into equal blocks, about as large as ``block``, without a remainder. As
    they differ a little, all are scaled to reach the source's quota. A shard's quota is at
    most what it holds, ``repeats`` times.
    """
    cuts = {k: max(1, round(t / block)) for k, t in held.items()}
    parts = apportion({k: float(t) for k, t in held.items()}, seats, {k: c * repeats for k, c in cuts.items()})
    got = sum(n * held[k] / cuts[k] for k, n in parts.items())
    scale = min(seats * block, sum(held.values()) * repeats) / got if got else 0.0
    out = []
    for k, n in parts.items():
        quota = min(n * held[k] / cuts[k] * scale, held[k] * float(repeats))
        rounds = int(quota // held[k])
        start = random.Random(f"{seed} {source} {k}").randrange(cuts[k])
        out.append((source, k, held[k], rounds, start * held[k] / cuts[k], quota - rounds * held[k]))
    return out


def _report(mix: DataFrame, named: DataFrame, supply: DataFrame, weights: Mapping[str, float], blocks: Mapping[str, int]) -> DataFrame:
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.sum(F.col("copies").cast("long")).alias("mix_records"), F.max("copies").alias("most_copies"))
    planned = mix.sparkSession.createDataFrame([(s, w, blocks[s]) for s, w in weights.items()], "source string, possible_share double, blocks long")
    # Only sources with a quota are in the mixture; their number is that of the targets.
    shares = planned.join(got, "source", "left").withColumn("actual_share", F.col("mix_tokens") / F.sum("mix_tokens").over(Window.partitionBy()))
    told = named.join(supply.where("source <> ''"), "source", "full").join(shares, "source", "left")
    whole = ["max_repeats", "n_records", "supply_tokens", "blocks", "mix_tokens", "mix_records", "most_copies"]
    return told.fillna(0, [*whole, "target_share", "possible_share", "actual_share"]).select("source", "target_share", "max_repeats", "n_records", "supply_tokens", "possible_share", "blocks", "mix_tokens", "mix_records", "most_copies", "actual_share")


def sized(documents: DataFrame) -> DataFrame:
    """Token counts, computed once."""
    return cut(token_counts(documents))
