"""Filling fixed-capacity containers with items (problem 6).

Texts are measured in tokens of a public tokenizer. A text longer than the capacity
is cut into full pieces, which are containers of their own, and a rest; everything
else stays whole. The rest is packed by a grouping genetic algorithm whose genes are
whole containers: a crossover injects the best-filled containers of one parent into
the other, drops the containers that would repeat an item, and best-fits the items
that lost their place; a mutation empties the worst containers likewise.

Before they are best-fitted, displaced items are swapped for smaller ones of open
containers wherever that fills the container better.

Items are spread at random over shards of a bounded number, which are problems of
their own. Each shard is solved on several islands, which are different tasks with
different seeds; between rounds each island passes its elite to the next. An island
rests when its best solution meets a lower bound, or has not gained for a stated
number of crossovers. What a shard can't fill well on its own, its worst containers,
is pooled with that of other shards and packed again, until one shard is left; so
sharding costs next to nothing.

Defined results: a null text, and one without tokens, has size 0 and lies in some
container all the same; rows without id are ignored, repeated ids count once; a
capacity that is null or below 1 is ignored; no container is ever overfull; the same
input gives the same packing.
"""

from __future__ import annotations

import base64
import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .words import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Items of a shard, islands, rounds, members of a population; an island rests after so many crossovers without gain.
SHARD, ISLANDS, ROUNDS, POPULATION, PATIENCE = 600, 2, 2, 5, 10
#: Share of the containers that a mutation empties, and the worst containers of a shard that are packed again with those of others.
EMPTIED, POOLED = 0.08, 3


@cache
def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens): whole texts, measured where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


# A solution is a list of bins, a bin a list of item numbers. Room: a sorted list of (free space, bin number) of open bins.


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], fills: list[int]) -> None:
    """Put the items, largest first, each into the bin that it fills best; opens bins where none has room."""
    room = sorted((capacity - f, i) for i, f in enumerate(fills) if f < capacity)
    for item in sorted(items, key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, i = room.pop(at)
            bins[i].append(item)
        else:
            free, i = capacity, len(bins)
            bins.append([item])
            fills.append(0)
        fills[i] += size
        if free > size:
            insort(room, (free - size, i))


def fitness(fills: list[int], capacity: int) -> float:
    """Mean of the squared shares of space used: few full bins beat many half-full ones."""
    return sum((f / capacity) ** 2 for f in fills) / len(fills) if fills else 1.0


def _solution(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[float, list[list[int]]]:
    return fitness([sum(map(sizes.__getitem__, b)) for b in bins], capacity), bins


def random_fill(sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """A start: part of the items in random order by first room, the rest best-fitted."""
    bins: list[list[int]] = []
    fills: list[int] = []
    items = list(range(len(sizes)))
    if rng.random() < 0.75:
        rng.shuffle(items)
        head = items[: len(items) // 3]
        for item in head:
            if fills and fills[-1] + sizes[item] <= capacity:
                bins[-1].append(item)
                fills[-1] += sizes[item]
            else:
                bins.append([item])
                fills.append(sizes[item])
        items = items[len(items) // 3 :]
    best_fit(items, sizes, capacity, bins, fills)
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing goes below: by the sum, and by the items that can't share a bin (Martello and Toth's second bound)."""
    ordered = sorted(sizes)
    total, n = [0], len(ordered)
    for x in ordered:
        total.append(total[-1] + x)
    best = -(-total[-1] // capacity)
    half = bisect_right(ordered, capacity // 2)
    for small in sorted({0, *ordered[:half]}):
        big = bisect_right(ordered, capacity - small)
        first = bisect_left(ordered, small)
        middle = (n - big) + (big - half)
        spare = (big - half) * capacity - (total[big] - total[half])
        best = max(best, middle + max(0, -(-((total[half] - total[first]) - spare) // capacity)))
    return best


def exchange(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], fills: list[int]) -> list[int]:
    """Swap displaced items, the largest first, for smaller ones of a bin where that leaves least room; returns what is displaced then."""
    waiting = sorted(items, key=sizes.__getitem__)
    out = []
    # the widest room first: no bin further on can gain more than its room
    opened = sorted((i for i, f in enumerate(fills) if f < capacity), key=fills.__getitem__)
    held = {i: sorted((sizes[x], x) for x in bins[i]) for i in opened}
    while waiting:
        item = waiting.pop()
        size, best, gain = sizes[item], None, 0
        for i in opened:
            free = capacity - fills[i]
            if free <= gain:
                continue
            # the largest item of the bin that is smaller than this one and makes room for it
            at = bisect_left(held[i], (size, -1)) - 1
            low = bisect_left(held[i], (size - free, -1))
            if 0 <= low <= at and size - held[i][low][0] > gain:
                best, gain = (i, low), size - held[i][low][0]
        if best is None:
            out.append(item)
            continue
        i, at = best
        _, gone = held[i].pop(at)
        insort(held[i], (size, item))
        bins[i].remove(gone)
        bins[i].append(item)
        fills[i] += gain
        out.append(gone)
    return out


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The well-filled bins of b go into a as they are; bins of a with an item of theirs go, their other items are refitted."""
    fill = {i: sum(map(sizes.__getitem__, x)) for i, x in enumerate(b)}
    ranked = sorted(fill, key=lambda i: (-fill[i], i))
    inject = [b[i] for i in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.6]
    taken = {x for bin_ in inject for x in bin_}
    kept, displaced = [], []
    for bin_ in a:
        if taken.isdisjoint(bin_):
            kept.append(bin_[:])
        else:
            displaced += [x for x in bin_ if x not in taken]
    return _refit([x[:] for x in inject] + kept, displaced, sizes, capacity)


def _refit(bins: list[list[int]], displaced: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    fills = [sum(map(sizes.__getitem__, x)) for x in bins]
    best_fit(exchange(displaced, sizes, capacity, bins, fills), sizes, capacity, bins, fills)
    return bins


def mutate(a: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empty the worst-filled bins and some random ones, and refit their items."""
    fill = [sum(map(sizes.__getitem__, x)) for x in a]
    worst = sorted(range(len(a)), key=lambda i: (fill[i], i))[: max(1, int(len(a) * EMPTIED))]
    out = set(worst) | {rng.randrange(len(a)) for _ in worst}
    return _refit([x[:] for i, x in enumerate(a) if i not in out], [x for i in sorted(out) for x in a[i]], sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], patience: int = PATIENCE, population: int = POPULATION) -> list[list[int]]:
    """The best solution that an island reaches from the elites it was given."""
    rng = random.Random(seed)
    if not sizes:
        return []
    least = max(1, lower_bound(sizes, capacity))
    pool = [_solution(x, sizes, capacity) for x in elites]
    if not pool:
        bins: list[list[int]] = []
        best_fit(list(range(len(sizes))), sizes, capacity, bins, [])
        pool = [_solution(bins, sizes, capacity)]
    order = lambda x: (len(x[1]), -x[0])
    pool.sort(key=order)
    idle = 0
    while idle < patience and len(pool[0][1]) > least:
        while len(pool) < population:
            pool.append(_solution(random_fill(sizes, capacity, rng), sizes, capacity))
        before = order(pool[0])
        i, j = sorted(rng.sample(range(len(pool)), 2))
        pool.append(_solution(crossover(pool[j][1], pool[i][1], sizes, capacity, rng), sizes, capacity))
        pool.append(_solution(mutate(pool[0][1], sizes, capacity, rng), sizes, capacity))
        pool.sort(key=order)
        del pool[population:]
        idle = 0 if order(pool[0]) < before else idle + 1
    return pool[0][1]


def _flat(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for i, b in enumerate(bins):
        out[b] = i
    return out


def _bins(flat: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(flat.max()) + 1)] if len(flat) else []
    for item, i in enumerate(flat.tolist()):
        out[i].append(item)
    return out


_STATE = "kind string, capacity bigint, shard bigint, island int, items array<struct<doc_id:bigint,piece:bigint,size:bigint>>, elites array<array<int>>"


def _island(round_: int, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for capacity, shard, island, items, elites in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("capacity", "shard", "island", "items", "elites"))):
                sizes = [x["size"] for x in items]
                seed = hash((capacity, shard, island, round_))
                best.append([_flat(evolve(sizes, capacity, seed, [_bins(np.array(e)) for e in elites or []], 0 if plain else PATIENCE), len(sizes)).tolist()])
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"elites": pa.array(best, pa.list_(pa.list_(pa.int32())))}
            yield pa.RecordBatch.from_arrays([columns[n] for n in batch.schema.names], names=batch.schema.names)

    return run


def pieces(counts: DataFrame, capacities: DataFrame) -> DataFrame:
    """(kind, capacity, doc_id, piece, token_start, size): texts whole, or cut where they exceed the capacity."""
    # a handful of capacities: the table is an input of fixed size, and is checked to be one
    kinds = capacities.where("container_kind is not null and capacity_tokens >= 1").groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity")).limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    if not kinds:
        return counts.select(F.lit("").alias("kind"), F.lit(1).cast("long").alias("capacity"), "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("token_start"), F.col("n_tokens").alias("size")).where("false")
    each = counts.select("doc_id", "n_tokens", F.explode(F.array(*[F.struct(F.lit(k.container_kind).alias("kind"), F.lit(k.capacity).cast("long").alias("capacity")) for k in kinds])).alias("c"))
    last = F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("c.capacity")))
    cut = each.select("c.kind", "c.capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    return cut.select("kind", "capacity", "doc_id", "piece", start.alias("token_start"), F.least(F.col("capacity"), F.col("n_tokens") - start).alias("size"))


def _solved(items: DataFrame, shards: int, level: int, plain: bool) -> DataFrame:
    """(kind, capacity, shard, bin, items, fill, place): the containers of every shard of items (kind, capacity, doc_id, piece, size), place counting from the worst-filled."""
    cut = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "kind", F.lit(level)), F.lit(shards)))
    problems = cut.groupBy("kind", "capacity", "shard").agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece", "size"))).alias("items"))
    islands, rounds = (1, 1) if plain else (ISLANDS, ROUNDS)
    state = problems.select("kind", "capacity", "shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "items", F.array().cast("array<array<int>>").alias("elites"))
    for r in range(rounds):
        spread = state.repartition("kind", "shard", "island") if r == 0 else state
        state = spread.mapInArrow(_island(r, plain), _STATE)
        if r + 1 < rounds:
            # migration: the elite of an island joins that of the next one in the ring
            on = Window.partitionBy("kind", "shard")
            elite = F.col("elites")[0]
            ring = F.map_from_entries(F.collect_list(F.struct(F.pmod(F.col("island") + 1, F.lit(islands)), elite)).over(on))
            state = state.withColumn("elites", F.array(elite, F.element_at(ring, F.col("island"))))
    best = state.groupBy("kind", "capacity", "shard").agg(F.min(F.struct(F.array_max(F.col("elites")[0]).alias("bins"), "island", F.col("elites")[0].alias("bin"), "items")).alias("best"))
    each = best.select("kind", "capacity", "shard", F.explode(F.arrays_zip("best.bin", "best.items")).alias("x"))
    bins = each.groupBy("kind", "capacity", "shard", F.col("x.bin").alias("bin")).agg(F.collect_list("x.items").alias("items"), F.sum("x.items.size").alias("fill"))
    return bins.withColumn("place", F.row_number().over(Window.partitionBy("kind", "shard").orderBy("fill", "bin")))


def fill_containers(documents: DataFrame, capacities: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER, shard_items: int = SHARD, plain: bool = False) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, token_start, n_tokens): every text of every kind of container.

    ``plain``: best fit of each shard only, to compare with.
    """
    counts = checkpoint(token_counts(documents, doc_id, text, path))
    cut = pieces(counts, capacities)
    full = F.col("size") == F.col("capacity")
    whole = cut.where(full).select(
        F.col("kind").alias("container_kind"), F.concat_ws("-", "kind", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", F.col("piece").alias("piece_no"), "token_start", F.col("size").alias("n_tokens")
    )
    items, out, level = cut.where(~full).select("kind", "capacity", "doc_id", "piece", "size"), [whole], 0
    shards = max(1, -(-counts.count() // shard_items))
    while True:
        bins = checkpoint(_solved(items, shards, level, plain))
        again = (F.col("place") <= POOLED) if shards > 1 and not plain else F.lit(False)
        done = bins.where(~again).select("kind", "capacity", F.concat_ws("-", "kind", F.lit(level), "shard", "bin").alias("container_id"), F.explode("items").alias("x"))
        out.append(done.select(F.col("kind").alias("container_kind"), "container_id", "x.doc_id", F.col("x.piece").alias("piece_no"), (F.col("x.piece") * F.col("capacity")).alias("token_start"), F.col("x.size").alias("n_tokens")))
        if shards == 1 or plain:
            break
        items = bins.where(again).select("kind", "capacity", F.explode("items").alias("x")).select("kind", "capacity", "x.*")
        left = items.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
        # each level has fewer shards, the last one
        shards, level = max(1, min(-(-left // shard_items), shards // 2)), level + 1
    return reduce(DataFrame.unionByName, out)
