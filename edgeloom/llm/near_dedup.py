"""MinHash near-dedup by fast similarity sketching: hashed bin placement in rounds, banding, exact verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import components, drop, id_and_text, id_map, lean, map_bits, marked, mix, pack, parts_for, saved, table, unpack
from .wordblocks import MOST_BUCKETS, spans

WORDS, PERCENT = 5, 85
#: A pair that shares 85 % of its union shares no band once in some 170 million times, one that shares 80 % once in some 190,000.
BANDS, ROWS = 40, 6
#: Shingles that are sketched at a time, and words whose hashes a Python worker keeps.
AT_ONCE, CACHE_WORDS = 100_000, 150_000
#: Longs of the map of a set's shingles, which tells what two sets can't share.
MAP_LONGS = 32
#: Members of a bucket that one task compares with each other.
CELL = 2048
#: Rounds of links to one centre of each bucket, before what is left in a bucket is compared.
ROUNDS = 2
_ONE, _M = np.uint64(1), [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


class _Hashes(dict):
    """word -> 64-bit hash; it starts afresh when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of WORDS words; with fewer words all of them are one; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    x = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(h))):
        x = mix(x * _M[k] + h[k : k + n])
    return np.unique(x)


def sketches(sets: list[np.ndarray], bins: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketches, a row of bins for each set; sets must not be empty.

    In each round every element of a set falls in one bin by that round's hash, with a value of the round first and a hash second; a bin
    keeps the least, so a later round fills only what is still empty. The rounds of the second half go over the bins one by one, so after
    twice as many rounds as bins every coordinate is filled; sets with more than bins * ln(bins) elements mostly need but a few.
    """
    out = np.full((len(sets), bins), np.uint64(0xFFFFFFFFFFFFFFFF))
    if not sets:
        return out
    owner, elements = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    flat = out.reshape(-1)
    for r in range(2 * bins):
        h = mix(elements ^ mix(np.array([r], np.uint64)))
        at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if r < bins else np.full(len(h), r - bins)
        value = (np.uint64(r) << np.uint64(54)) | (mix(h) >> np.uint64(10))
        place = owner * bins + at
        np.minimum.at(flat, place, value)
        if r < 4 or r % 4 == 0:
            todo = (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)[owner]
            if not todo.any():
                break
            owner, elements = owner[todo], elements[todo]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sketch.reshape(len(sketch), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = mix(key * _M[0] + rows[:, :, k])
    return key.view(np.int64)


def _describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, whole, keys): whole identifies the set, keys are its bands."""
    import xxhash

    def out(ids: list, sets: list):
        keys = iter(band_keys(sketches([s for s in sets if len(s)])))
        rows = [list(next(keys)) if len(s) else [] for s in sets]
        whole = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "whole", "keys"])

    @lean
    def run(batches):
        ids, sets, size = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc)
                sets.append(shingles(text))
                size += len(sets[-1]) + 100
                if size >= AT_ONCE:
                    yield out(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield out(ids, sets)
        _hashes.clear()

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, whole binary, keys array<long>")


def bitmap(shingle_set: np.ndarray) -> list[int]:
    """MAP_LONGS longs with a bit set for each shingle. A bit that only one of two sets has stands for a shingle that only it has."""
    bits = np.zeros(64 * MAP_LONGS, bool)
    bits[(shingle_set % np.uint64(64 * MAP_LONGS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _sets(docs: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """(id, shingles, bits) of the documents in wanted(id), computed from their whole texts and stored in buckets by id."""

    @lean
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 128):
                own = b.slice(i, 128)
                sets = [shingles(t) for t in own.column(1).cast(pa.binary()).to_pylist()]
                yield pa.record_batch([own.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles", "bits"])
        _hashes.clear()

    bits = id_map(wanted, lambda b: b.column(0).to_numpy(), map_bits(wanted.count()))
    some = marked(id_and_text(docs).where("doc_id is not null"), bits).join(wanted.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    return saved(some.mapInArrow(run, "id long, shingles binary, bits array<long>"), (min(parts, MOST_BUCKETS), "id"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The stored sets stay in place, and come once for each pair."""

    @lean
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _members(keys: DataFrame) -> DataFrame:
    """(key, id, n, w) of the buckets that hold two sets or more, from (id, n, keys). w, what an id's buckets hold together, is large for
    sets in the middle of many like them.

    Here and below, what is aggregated by a key is stored before it is joined by that key: rows of one key can then be dealt over tasks.
    """
    rows = keys.select("id", "n", F.explode("keys").alias("key"))
    shared = saved(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    own = saved(rows.join(shared, "key").select("key", "id", "n", "size"))
    members = saved(own.join(own.groupBy("id").agg(F.sum("size").alias("w")), "id").select("key", "id", "n", "w"))
    drop(shared)
    drop(own)
    return members


def _shared_counts(sets: DataFrame, ids: DataFrame, parts: int) -> DataFrame:
    """(id, k): how many shingles of each of the ids' sets are in another of them too.

    Blobs of shingles are shuffled, one a batch and part, and then blobs of counts by the hash of the id. Sets that share nothing are left out.
    """

    def deal(batches):
        for b in batches:
            arrays = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            if not arrays:
                continue
            x = np.concatenate(arrays)
            own = np.repeat(b.column(0).to_numpy(), [len(a) for a in arrays])
            part = (x % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            out = [(int(part[order[a]]), pack(own[order[a:z]], x[order[a:z]])) for a, z in spans(part[order])]
            yield pa.record_batch([pa.array([p for p, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["part", "rows"])

    def count(t: pa.Table) -> pa.Table:
        own, x = (np.concatenate(c) for c in zip(*[unpack(v) for v in t["rows"].to_pylist()], strict=True))
        _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
        ids, k = np.unique(own[n[inverse] > 1], return_counts=True)
        home = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        out = [(int(home[order[a]]), pack(ids[order[a:z]], k[order[a:z]])) for a, z in spans(home[order])]
        return pa.table({"home": pa.array([h for h, _ in out], pa.int32()), "rows": pa.array([v for _, v in out], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        ids, k = (np.concatenate(c) for c in zip(*[unpack(v) for v in t["rows"].to_pylist()], strict=True))
        found, inverse = np.unique(ids, return_inverse=True)
        return pa.table({"id": found, "k": np.bincount(inverse, k).astype(np.int64)})

    some = sets.join(ids, "id", "left_semi").select("id", "shingles").mapInArrow(deal, "part int, rows binary")
    return some.groupBy("part").applyInArrow(count, "home int, rows binary").groupBy("home").applyInArrow(add, "id long, k long")


def _possible(members: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b): pairs of members(key, id, n, c, k, bits, keys) of a bucket in different components that may be similar enough.

    What two sets share is at most what either shares with any set, and what is left of either without the bits that only it has. These
    bounds are exact and leave little more than the similar pairs. A pair comes from the smallest of its buckets only. Large buckets are
    dealt over cells of bounded size.
    """
    size = saved(members.groupBy("key").agg(F.count("*").alias("size")))
    q = F.ceil(F.col("size") / CELL).cast("int")
    dealt = members.join(size, "key").withColumn("q", q).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("q")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).select("key", "id", "n", "c", "k", "bits", "keys", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def run(t: pa.Table) -> pa.Table:
        key, i, j, ids, n, c, k, chunk = (t[x].to_numpy() for x in ("key", "i", "j", "id", "n", "c", "k", "chunk"))
        bits = t["bits"].combine_chunks().flatten().to_numpy().reshape(len(ids), MAP_LONGS)
        keys = t["keys"].combine_chunks()
        ends, flat = keys.offsets.to_numpy(), keys.values.to_numpy()
        order = np.lexsort((ids, j, i, key))
        cut = np.flatnonzero(np.r_[True, (np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)])
        out: tuple[list, list] = ([], [])
        for cell in np.split(order, cut[1:]):
            across = i[cell[0]] != j[cell[0]]
            for at, r in enumerate(cell[:-1].tolist()):
                rest = cell[at + 1 :]
                rest = rest[(c[rest] != c[r]) & ((chunk[rest] != chunk[r]) | ~across)]
                if not len(rest):
                    continue
                mine, theirs = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (bits[r] & ~bits[rest], bits[rest] & ~bits[r]))
                most = np.minimum(np.minimum(k[rest], n[rest] - theirs), np.minimum(k[r], n[r] - mine))
                for s in rest[100 * most >= percent * (n[rest] + n[r] - most)].tolist():
                    if np.intersect1d(flat[ends[r] : ends[r + 1]], flat[ends[s] : ends[s + 1]])[0] == key[r]:
                        out[0].append(min(ids[r], ids[s]))
                        out[1].append(max(ids[r], ids[s]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    # many cells to a task, so that small buckets cost little; a cell stays whole
    return cells.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(2 * parts)).alias("task")).applyInArrow(run, "a long, b long")


def _links(members: DataFrame, docs: DataFrame, percent: int, parts: int) -> DataFrame | None:
    """Links (a, b) between representatives whose components are those of all pairs that share a bucket and are similar.

    First the members of a bucket are compared with its most central one, then what isn't connected to that one with the most central of
    the rest; so a group of copies costs as many comparisons as it has members. What remains are members of a bucket in different
    components. Of these, _possible() leaves out pairs that can't reach the threshold; the others are compared in full.
    """
    sets = _sets(docs, members.select("id").distinct(), parts)
    links, known = None, None
    for r in range(ROUNDS + 1):
        own = members if known is None else members.join(known, "id", "left")
        own = own.select("key", "id", "n", "w", (F.coalesce("component", "id") if known is not None else F.col("id")).alias("c"))
        if known is not None:
            own = saved(own)
            open_keys = saved(own.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key"))
            own = saved(own.join(open_keys, "key"))
            if own.isEmpty():
                break
        middle = lambda df: saved(df.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("o"), F.col("id").alias("other"), F.col("n").alias("m"), F.col("c").alias("d"))).alias("x")).select("key", "x.*"))
        if r < ROUNDS:
            centre = middle(own)
            for _ in range(r):
                centre = middle(saved(own.join(centre.select("key", "d"), "key").where("c <> d").drop("d")))
            pairs = own.join(centre, "key").where((F.col("c") != F.col("d")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent))
        else:
            counts = _shared_counts(sets, own.select("id").distinct(), parts).join(sets.select("id", "bits"), "id")
            held = own.groupBy("id").agg(F.collect_set("key").alias("keys"))  # BANDS keys at most
            pairs = _possible(saved(own.join(counts, "id").join(held, "id")), percent, parts).toDF("id", "other")
        pairs = saved(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
        found = saved(_confirm(pairs, sets, percent))
        links = found if links is None else saved(links.union(found))
        if r < ROUNDS:
            known = saved(components(links))
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Documents are linked whose sets of distinct 5-word shingles (A-Z lower-cased) share percent of their union; component_id is the smallest
    doc_id that links reach. Documents with equal sets are represented by one of them. Null and empty texts have no shingles and are linked
    with nothing; a null doc_id is linked with nothing, its component_id is null and it is kept; rows that repeat a doc_id are one document
    of several texts, and each row is returned; long texts are read whole; other columns are ignored; an empty table gives an empty result.
    """
    described = saved(_describe(docs))
    parts = parts_for(8 * (described.agg(F.sum("n_shingles")).first()[0] or 0))
    real = described.where("doc_id is not null and n_shingles > 0")
    first = saved(real.groupBy("whole").agg(F.min("doc_id").alias("rep")))
    same = saved(real.join(first, "whole").select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys")))
    members = _members(same.where("keys is not null").select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "keys").distinct())
    links = _links(members, docs, percent, parts)
    odd = described.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # a doc_id with several texts ties the groups of copies together that they belong to
    tied = same.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).where("b < c").select("doc_id")
    ties = same.join(tied, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = ties if links is None else links.union(ties)
    known = saved(components(links).select(F.col("id").alias("rep"), "component"))
    rest = same.join(known, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return rest.union(odd).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def filter_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names: one document of each group."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    return docs.select(docs["doc_id"].cast("long").alias("id"), F.struct("*").alias("row")).join(gone, "id", "left_anti").select("row.*")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash_dedup": op3_minhash_dedup}
ORACLE_SQL = {
    "op3_minhash_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {WORDS} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(len(words) - {WORDS - 1}), lambda i: array_to_string(words[i + 1 : i + {WORDS}], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(sh) AS shingle FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM x a JOIN x b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON i.a = p.doc_id JOIN n q ON i.b = q.doc_id WHERE 100 * both_have >= {PERCENT} * (p.n_shingles + q.n_shingles - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept
FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON n.doc_id = c.doc_id"""
}
