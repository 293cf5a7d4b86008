"""Best-fit packing by a grouping genetic algorithm: islands evolve whole bins and pass their elites on."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import drop, saved, table, unpack
from .base import pack as pack_arrays
from .wordblocks import Block, bring_back, encoding, look_up, store

LENGTH = 2048
#: Pieces of a shard, islands of a shard, generations between migrations, epochs (with a migration between), solutions on an island.
SHARD_PIECES, ISLANDS, GENERATIONS, EPOCHS, POPULATION = 4096, 2, 8, 2, 4
#: Share of the bins that a crossover injects, at most, and bins that a mutation dissolves on average.
INJECTED, DISSOLVED = 0.1, 3
#: Bins filled to less go on to the next level, where they meet bins of other shards.
WELL_FILLED = 0.995
#: What the tokenizer takes as white space beyond ASCII: it drops white space, so that the parts between don't touch each other.
_WIDE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: With bytes of the tokenizer's parts and ids in small memory, larger blocks cost less: fewer words stand in several of them.
BLOCK_BYTES = 12 << 20

_tokenizers: dict = {}


class Tokenizer:
    """Ids of blank-separated parts of texts, each distinct part at the cost of one look-up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tokenizers

        self.own = tokenizers.Tokenizer.from_file(path)
        vocabulary = self.own.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.split = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.added = [t["content"] for t in rules["added_tokens"]]

    def ids(self, parts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each part.

        The words of Latin-1 parts are encoded together, once each: a word's last token, and no other, is one that ends words. Other parts,
        where normalisation can change what a word is, and parts with the string of a special token go to the tokenizer by themselves.
        """
        known: dict[str, bytes] = {}
        words: list = []
        for p in parts:
            if not (p.isascii() or max(p) <= "\xff"):
                words.append(None)
            elif p.isalpha():
                words.append(w := p.lower())  # one word: the common case
                known[w] = b""
            elif any(a in p for a in self.added):
                words.append(None)
            else:
                words.append(own := self.split(p.lower()))
                known.update(dict.fromkeys(own))
        order = list(known)
        for i in range(0, len(order), 1024):
            some = order[i : i + 1024]
            ids = np.array(self.own.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")  # without offsets
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                known.update((w, self._one(w)) for w in some)
                continue
            data = ids.tobytes()
            known.update((w, data[4 * a : 4 * z]) for w, a, z in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        return [known[x] if x.__class__ is str else self._one(p) if x is None else b"".join(map(known.__getitem__, x)) for p, x in zip(parts, words, strict=True)]

    def _one(self, part: str) -> bytes:
        return np.array(self.own.encode(part, add_special_tokens=False).ids, "<u4").tobytes()


def _parts(texts: list[str]):
    """Parts between blanks. The tokenizer's lower case is applied here where it is plain, so that fewer parts differ."""
    for t in texts:
        if t.isascii():
            b = t.encode()
            yield (b if b"<|" in b else b.lower()).split()  # special tokens keep their case
        else:
            yield _WIDE_BLANK.sub(" ", t).encode().split()  # bytes: the ASCII blanks only


def pieces_of(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32, ids): a document's ids and a closing 0, cut only where they exceed a sequence.

    Each distinct part between blanks is tokenized once for all documents. item numbers the pieces of one run.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")

    def ids_of(words: list[bytes]) -> list[bytes]:
        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer(path)
        return _tokenizers[path].ids([w.decode() for w in words])

    def finish(b: Block) -> pa.Table:
        rows: list[tuple] = []
        first = (b.number >> 32 << 41) | (b.number & 0xFFFFFFFF) << 20
        for doc, ids in zip(b.ids.to_pylist(), b.sequences(), strict=True):
            ids += b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at : at + 4 * length]
                rows.append((first + len(rows), doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
        columns = list(zip(*rows, strict=True))
        kinds = {"item": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)})

    blocks = store(docs, _parts, block_bytes=BLOCK_BYTES)
    return bring_back(blocks, [look_up(blocks, encoding(ids_of))], finish, "item long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


class Bins:
    """A solution: a bin for each item, and the room left in each bin."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity, self.of, self.room = sizes, capacity, np.full(len(sizes), -1, np.int32), []

    def put(self, items: np.ndarray) -> None:
        """Best fit, the largest first; open is kept sorted by room."""
        open_bins = sorted((r, k) for k, r in enumerate(self.room) if r > 0)
        for i in items[np.argsort(-self.sizes[items], kind="stable")].tolist():
            s = int(self.sizes[i])
            at = bisect_left(open_bins, (s, -1))
            if at < len(open_bins):
                r, k = open_bins.pop(at)
            else:
                r, k = self.capacity, len(self.room)
                self.room.append(r)
            self.of[i] = k
            self.room[k] = r - s
            if r > s:
                insort(open_bins, (r - s, k))

    def fitness(self) -> tuple:
        """Fewer bins first, then uneven filling, which leaves bins that can be emptied."""
        fill = (self.capacity - np.array(self.room)) / self.capacity
        return len(self.room), -float((fill**2).sum())


def solve(sizes: np.ndarray, capacity: int, of: np.ndarray | None = None, drop: np.ndarray | None = None) -> Bins:
    """A solution by best fit, from scratch, or from the bins in `of` without those that `drop` marks, whose items are placed anew."""
    out = Bins(sizes, capacity)
    if of is not None and len(of):
        keep = np.ones(of.max() + 1, bool) if drop is None else ~drop
        ranks = np.cumsum(keep) - 1
        stays = keep[of]
        out.of[stays] = ranks[of[stays]]
        fill = np.bincount(out.of[stays], sizes[stays], keep.sum()).astype(np.int64)
        out.room = (capacity - fill).tolist()
    out.put(np.flatnonzero(out.of < 0))
    return out


def first_fit(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """The items in a random order, each into the first of the last open bins that takes it."""
    out, open_bins = Bins(sizes, capacity), []
    for i in rng.permutation(len(sizes)).tolist():
        s = int(sizes[i])
        k = next((k for k in open_bins if out.room[k] >= s), None)
        if k is None:
            k = len(out.room)
            out.room.append(capacity)
            open_bins = [*open_bins[-15:], k]
        out.of[i] = k
        out.room[k] -= s
    return out


def crossover(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """Well-filled bins of b are injected whole into a; bins of a that share items with them go, and their other items are best-fitted."""
    fill = b.capacity - np.array(b.room)
    order = np.argsort(-fill + rng.uniform(0, b.capacity / 64, len(fill)))
    chosen = np.zeros(len(fill), bool)
    chosen[order[: max(1, int(len(fill) * rng.uniform(0, INJECTED)))]] = True
    taken = chosen[b.of]
    broken = np.zeros(len(a.room), bool)
    broken[a.of[taken]] = True
    of = np.full(len(a.of), -1, np.int64)
    ranks = np.cumsum(chosen) - 1
    of[taken] = ranks[b.of[taken]]
    stays = ~taken & ~broken[a.of]
    of[stays] = chosen.sum() + (np.cumsum(~broken) - 1)[a.of[stays]]
    out = Bins(a.sizes, a.capacity)
    out.of = of.astype(np.int32)
    n = int(chosen.sum() + (~broken).sum())
    out.room = (a.capacity - np.bincount(of[of >= 0], a.sizes[of >= 0], n).astype(np.int64)).tolist()
    out.put(np.flatnonzero(of < 0))
    return out


def mutate(a: Bins, rng: np.random.Generator) -> Bins:
    """The emptiest bin and a few others are dissolved."""
    room = np.array(a.room)
    drop = rng.random(len(room)) < DISSOLVED / len(room)
    drop[room.argmax()] = True
    return solve(a.sizes, a.capacity, a.of.astype(np.int64), drop)


def found(sizes: np.ndarray, capacity: int, island: int, rng: np.random.Generator) -> list[Bins]:
    """The first solutions of an island: random ones by first fit, and on the first island the one by best fit, so none ends up worse."""
    return [solve(sizes, capacity)] * (island == 0) + [first_fit(sizes, capacity, rng) for _ in range(POPULATION - (island == 0))]


def evolve(pool: list[Bins], rng: np.random.Generator) -> tuple[list[Bins], int]:
    """The solutions of an island after its generations, the best first, and the number of crossovers.

    The parents of a generation are the better of two drawn at random and any other; the children, one as it is and one mutated, take the
    places of the worst. The best stays.
    """
    crossovers = 0
    for _ in range(GENERATIONS):
        pool.sort(key=Bins.fitness)
        if len(pool) < 2:
            break
        first = min(rng.integers(0, len(pool), 2).tolist())
        second = int(rng.choice([k for k in range(len(pool)) if k != first]))
        child = crossover(pool[first], pool[second], rng)
        crossovers += 1
        pool = [*pool[: max(1, POPULATION - 2)], child, mutate(child, rng)]
    return sorted(pool, key=Bins.fitness)[:POPULATION], crossovers


def _gather(items: DataFrame) -> DataFrame:
    """(shard, n, items): a blob for each shard of items(shard, item, length), the largest first."""

    def run(t: pa.Table) -> pa.Table:
        sizes, item = t["length"].to_numpy(), t["item"].to_numpy()
        order = np.lexsort((item, sizes))[::-1]
        return pa.table({"shard": t["shard"][:1], "items": pa.array([pack_arrays(sizes[order].astype(np.int32), item[order])], pa.binary())})

    return items.groupBy("shard").applyInArrow(run, "shard long, items binary")


def _epoch(shards: DataFrame, states: DataFrame | None, capacity: int, seed: int) -> DataFrame:
    """(shard, island, best, crossovers, pool): each island's solutions after the generations of an epoch; an island is a row of its own.

    states: what the epoch before left, which is stored; the elite of the island before, in a ring, comes along.
    """
    islands = shards.select("shard", "items", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    if states is None:
        given = islands.select("shard", "island", "items", F.lit(None).cast("binary").alias("pool"), F.lit(None).cast("binary").alias("elite"))
    else:
        elites = states.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("pool").alias("elite"))
        given = islands.join(states.select("shard", "island", "pool"), ["shard", "island"]).join(elites, ["shard", "island"]).select("shard", "island", "items", "pool", "elite")

    def run(batches):
        for b in batches:
            out = []
            for shard, island, items, pool, elite in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                sizes = unpack(items)[0].astype(np.int64)
                rng = np.random.default_rng([seed, shard, island])
                if pool is None:
                    own = found(sizes, capacity, island, rng)
                else:
                    own = [solve(sizes, capacity, of.astype(np.int64)) for of in (*unpack(pool), unpack(elite)[0])]
                own, crossovers = evolve(own, rng)
                out.append((shard, island, len(own[0].room), own[0].fitness()[1], crossovers, pack_arrays(*[x.of for x in own])))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names=["shard", "island", "n_bins", "fill", "crossovers", "pool"])

    return given.repartition("shard", "island").mapInArrow(run, "shard long, island int, n_bins int, fill double, crossovers int, pool binary")


def islands(items: DataFrame, capacity: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(item, sequence_id, offset, fill, bin) for items(shard, item, length), and the islands of the last epoch.

    Each pair of a shard and an island is evolved by itself. Between epochs its solutions are stored, and its elite goes to the next island
    of the shard. In the end the best island of a shard decides. A sequence is named by its smallest item.
    """
    shards, states = saved(_gather(items)), None
    for epoch in range(EPOCHS):
        old, states = states, saved(_epoch(shards, states, capacity, seed * 1000 + epoch))
        if old is not None:
            drop(old)
    best = states.groupBy("shard").agg(F.min(F.struct("n_bins", "fill", "island")).alias("x")).select("shard", "x.island")

    def run(batches):
        for b in batches:
            for items, pool in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sizes, item = unpack(items)
                sizes, of = sizes.astype(np.int64), unpack(pool)[0]
                order = np.lexsort((item, of))
                of, sizes, item = of[order], sizes[order], item[order]
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                n = np.diff(np.r_[first, len(of)])
                ends = np.cumsum(sizes)
                columns = {"item": item, "length": sizes, "sequence_id": np.repeat(item[first], n), "offset": ends - sizes - np.repeat((ends - sizes)[first], n), "fill": np.repeat(np.add.reduceat(sizes, first), n)}
                yield pa.RecordBatch.from_pydict(columns)

    chosen = shards.join(states.join(best, ["shard", "island"]).select("shard", "pool"), "shard").select("items", "pool")
    return chosen.mapInArrow(run, "item long, length long, sequence_id long, offset long, fill long"), states


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces(item, length, ...), item being unique and no piece longer than a sequence.

    Full pieces are sequences by themselves. The others are dealt over shards of bounded size, each packed by its islands. The pieces of
    bins that stay less than WELL_FILLED meet again in new shards, until they fit in one shard or a level leaves as many such bins as the
    one before.
    """
    alone = pieces.where(F.col("length") == length).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, level, before = pieces.where(F.col("length") < length).select("item", "length"), [alone], 0, None
    n = rest.count()
    while n:
        shards = -(-n // SHARD_PIECES)
        placed = saved(islands(rest.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards))), length, level)[0])
        again = placed.where(F.col("fill") < int(WELL_FILLED * length))
        left, bins = again.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if shards == 1 or (before is not None and bins >= before):
            done.append(placed.select("item", "sequence_id", "offset"))
            break
        done.append(placed.where(F.col("fill") >= int(WELL_FILLED * length)).select("item", "sequence_id", "offset"))
        rest, n, level, before = again.select("item", "length"), left, level + 1, bins
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return pieces.join(out, "item")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of docs(doc_id, text).

    A null or empty text is one piece with the closing 0 alone; repeated rows are packed as often as they come, null ids too; very long
    texts are cut into pieces; other columns are ignored; an empty table gives an empty result.
    """
    return pack(saved(pieces_of(docs, path, length).drop("ids")), length).drop("item")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
