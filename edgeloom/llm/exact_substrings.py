"""Suffix-array dedup by bucket-pointer refinement: bytes in strings of LENGTH that also start earlier are removed.

Sorting every suffix of the corpus would shuffle each byte many times over, so it is done in three steps that get smaller:

1. Every string of LENGTH bytes belongs to the least GRAM-gram in it (by a hash), as equal strings do alike. Neighbouring strings of one
   gram are one run; initial buckets are the grams, and within a bucket runs of equal contents, which 128 bits identify.
2. Of equal runs all but the first go. A bucket with several different runs can still have equal strings in them.
3. The first runs of such buckets come with their bytes, and their suffixes are sorted: buckets by the q-gram itself, each refined by
   sorting its members on the bucket pointers of later offsets, the refined pointers serving the next pass, until LENGTH bytes are
   compared. Nothing is hashed there: strings in one bucket at the end are equal byte by byte.

Only runs are shuffled, as blobs: for each block of texts one for each part that has any, in which equal runs of the block are one already.
A repeat within a block is known to go, so it isn't sent to the part of its gram but to one by its home: a passage comes to the part of its
gram once from each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import NO_ID, column, dealt, id_map, lean, lean_group, map_bits, marked, mix, pack, parts_for, saved, table, trim, unpack
from .wordblocks import spans

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Texts are cut into segments of so many bytes for the hashing, which overlap by a string less one.
SEGMENT = 1 << 19
#: Bytes of texts in a block, and for each part and home.
GROUP_BYTES = 8 << 20
#: Bytes of runs that are refined at a time, which takes up to 50 times as much memory; runs of one gram stay together, however many.
REFINE_BYTES = 1 << 19
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * c) for c in _C[:2]]
#: Bytes of the initial buckets.
Q = 8


def gram_hashes(data: np.ndarray, upto: int, salt: int = 0) -> dict[int, np.ndarray]:
    """Identifiers of the upto-grams and of the GRAM-grams at every offset, by doubling; salt: 0 or 1, for independent ones."""
    h, out, q = _BYTES[salt][data], {}, 1
    while q < upto:
        h = h[:-q] * _C[(q.bit_length() + 3 * salt) % 8] + h[q:]
        q *= 2
        if q in (GRAM, upto):
            out[q] = h
    return out


def suffix_buckets(data: np.ndarray) -> np.ndarray:
    """For every offset the pointer of its bucket of equal LENGTH bytes: the place of the bucket's first member in the sorted order.

    Offsets without so many bytes are in no order. Initial buckets are by Q bytes, as numbers. A pass sorts the members of each bucket that
    has several on the pointers of the offsets `depth` later and splits it where these differ; then pointers stand for twice the depth.
    """
    n = len(data) - Q + 1
    if n < 1:
        return np.empty(0, np.int64)
    whole = np.int32 if n < 1 << 31 else np.int64
    key = np.zeros(n, np.uint64)
    for k in range(Q):
        key <<= np.uint64(8)
        key |= data[k : k + n]
    order = np.argsort(key).astype(whole)
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    del key
    pointer = np.empty(n, whole)
    pointer[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=whole), whole(0)))
    del order, first
    depth = Q
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        several = (np.bincount(pointer, minlength=n) > 1)[pointer]
        own = np.flatnonzero(several[: max(0, n - step)]).astype(whole)
        del several
        sort = np.argsort(pointer[own].astype(np.int64) * n + pointer[own + step])
        own = own[sort]
        del sort
        at, later = pointer[own], pointer[own + step]
        bucket = np.r_[True, at[1:] != at[:-1]][: len(own)]
        split = bucket | np.r_[True, later[1:] != later[:-1]][: len(own)]
        del later
        place = np.arange(len(own), dtype=whole)
        at += np.maximum.accumulate(np.where(split, place, whole(0)))
        at -= np.maximum.accumulate(np.where(bucket, place, whole(0)))
        pointer[own] = at
        depth += step
    return pointer


def runs(segments: list[bytes]) -> tuple[np.ndarray, ...]:
    """(segment, first, before, count, gram, content, check) of the runs: count strings from first on, whose gram stands before bytes later;
    content and check identify the bytes."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    n = len(data) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 3
    h = gram_hashes(data, 64)
    order = mix(h[GRAM])
    least = (order & ~np.uint64(0xFFFFFF)) | np.arange(len(order), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOW - width
    least = np.minimum(least[:n], least[rest : rest + n])
    gram = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:n]
    gram[np.arange(n) + LENGTH > ends[owner]] = -1  # strings never cross a segment's end
    cut = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    last = np.r_[cut[1:], n] - 1
    real = gram[cut] >= 0
    a, z = cut[real], last[real]
    g = gram[a]
    name = order[g]
    extent = mix(name + ((g - a) * 128 + z - a).astype(np.uint64))
    # the 64-grams at these three places cover a run
    whole = lambda x: mix(((x[a] * _C[1] + x[np.minimum(a + 52, z + 36)]) * _C[2] + x[z + 36]) ^ extent)
    seg = owner[a]
    return seg, a - (ends - sizes)[seg], g - a, z - a + 1, name, whole(h[64]), whole(gram_hashes(data, 64, 1)[64])


def _segments(text: bytes) -> list[tuple[int, bytes]]:
    return [(i, text[i : i + SEGMENT + LENGTH - 1]) for i in range(0, max(1, len(text) - LENGTH + 1), SEGMENT)]


def _repeated(name: np.ndarray) -> np.ndarray:
    """Rows whose name others have too, sorted by name."""
    order = np.argsort(name)
    s = name[order]
    same = s[1:] == s[:-1]
    return order[(np.r_[same, False] | np.r_[False, same])[: len(s)]]


def text_number(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def _find(parts: int):
    """mapInArrow: from (doc_id, text, home) the runs of each block, a blob for each part."""

    def flush(docs: list, found: list):
        ids, numbers, homes = (np.array(x, t) for x, t in zip(zip(*docs, strict=True), (np.int64, np.uint64, np.uint32), strict=True))
        doc, first, before, count, name, content, check = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = _repeated(content)
        order = rows[np.lexsort((first[rows], numbers[doc[rows]], ids[doc[rows]], check[rows], content[rows]))]
        later = np.zeros(len(doc), bool)
        if len(order):
            new = np.r_[True, (content[order][1:] != content[order][:-1]) | (check[order][1:] != check[order][:-1])]
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            later[order] = (ids[doc[order]] != ids[doc[lead]]) | (numbers[doc[order]] != numbers[doc[lead]]) | (first[order] != first[lead])
        part = np.where(later, homes[doc].astype(np.int64), (name % np.uint64(parts)).astype(np.int64))
        sort = np.argsort(part * 2 + later, kind="stable")
        place = lambda r: (ids[doc[r]], numbers[doc[r]], homes[doc[r]], first[r].astype(np.uint32), count[r].astype(np.uint8))
        out: tuple[list, list] = ([], [])
        for a, z in spans(part[sort]):
            own = sort[a:z]
            fresh, known = own[~later[own]], own[later[own]]
            out[0].append(int(part[own[0]]))
            out[1].append(pack(*place(fresh), before[fresh].astype(np.uint8), name[fresh], content[fresh], check[fresh], *place(known)))
        return pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["part", "runs"])

    @lean
    def run(batches):
        docs, found, size = [], [], 0
        wait: list[tuple[int, int, bytes]] = []
        waiting = 0

        def work():
            seg, first, before, count, name, content, check = runs([s for _, _, s in wait])
            number = np.array([d for d, _, _ in wait], np.int64)
            offset = np.array([o for _, o, _ in wait], np.int64)
            found.append((number[seg], first + offset[seg], before, count, name, content, check))

        for b in batches:
            for i in range(0, b.num_rows, 64):
                own = b.slice(i, 64)
                for doc, text, home in zip(own.column(0).to_pylist(), own.column(1).cast(pa.binary()).to_pylist(), own.column(2).to_pylist(), strict=True):
                    if len(text) < LENGTH:
                        continue
                    docs.append((NO_ID if doc is None else doc, text_number(text), home))
                    for o, s in _segments(text):
                        wait.append((len(docs) - 1, o, s))
                        waiting += len(s)
                        if waiting >= SEGMENT:
                            work()
                            wait, waiting = [], 0
                    size += len(text)
                if size >= GROUP_BYTES:
                    if wait:
                        work()
                        wait, waiting = [], 0
                    yield flush(docs, found)
                    docs, found, size = [], [], 0
                    trim()
        if wait:
            work()
        if docs:
            yield flush(docs, found)

    return run


def _by_home(homes: np.ndarray, arrays: list[np.ndarray]) -> tuple[list, list]:
    order = np.argsort(homes, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(homes[order].astype(np.int64)) != 0]) if len(order) else np.empty(0, np.int64)
    return homes[order[cut]].tolist(), [pack(*[a[r] for a in arrays]) for r in np.split(order, cut[1:])] if len(cut) else []


@lean_group
def _sort_out(t: pa.Table) -> pa.Table:
    """Of a part's runs: the repeats, and what must be refined, by the home of the document."""
    blobs = [unpack(x) for x in t["runs"].to_pylist()]
    ids, numbers, homes, first, count, before, name, content, check, *known = (np.concatenate(x) for x in zip(*blobs, strict=True))
    rows = _repeated(name)
    order = rows[np.lexsort((first[rows], numbers[rows], ids[rows], check[rows], content[rows], name[rows]))]
    n, c, k = name[order], content[order], check[order]
    new_name = np.r_[True, n[1:] != n[:-1]][: len(order)]
    new = new_name | np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])][: len(order)]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = (ids[order] != ids[lead]) | (numbers[order] != numbers[lead]) | (first[order] != first[lead])
    group = np.cumsum(new_name) - 1
    several = np.bincount(group, new, group[-1] + 1 if len(group) else 0)[group] > 1
    gone, open_ = order[later], order[new & several]
    kinds, keys, values = [], [], []
    for kind, key, arrays in (
        (0, np.r_[homes[gone], known[2]], [np.r_[ids[gone], known[0]], np.r_[numbers[gone], known[1]], np.r_[first[gone], known[3]], np.r_[count[gone], known[4]]]),
        (1, homes[open_], [x[open_] for x in (ids, numbers, first, count, before, name)]),
    ):
        k, v = _by_home(key, arrays)
        kinds, keys, values = kinds + [kind] * len(k), keys + k, values + v
    return pa.table({"home": pa.array(keys, pa.int32()), "kind": pa.array(kinds, pa.int32()), "flags": pa.array(values, pa.binary())})


def _flagged(b: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([unpack(x)[0] for x in b.column(0).to_pylist()]) if b.num_rows else np.empty(0, np.int64)


def _texts(t: pa.Table) -> list[tuple[tuple[int, int], bytes]]:
    texts = t["text"].cast(pa.binary()).to_pylist()
    return [((NO_ID if i is None else i, text_number(x)), x) for i, x in zip(t["doc_id"].to_pylist(), texts, strict=True)]


def _per_document(ids: np.ndarray, numbers: np.ndarray):
    """(document, its rows) for each document."""
    order = np.lexsort((numbers, ids))
    if len(order):
        cut = np.flatnonzero(np.r_[True, (np.diff(ids[order]) != 0) | (numbers[order][1:] != numbers[order][:-1])])
        for r in np.split(order, cut[1:]):
            yield (int(ids[r[0]]), int(numbers[r[0]])), r


def _fetch(parts: int):
    """cogroup of texts and runs to refine: the runs with their bytes, a blob for each part."""

    @lean_group
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = [unpack(x) for x in right["flags"].to_pylist()]
        home = right["home"][0].as_py() if right.num_rows else 0
        out: tuple[list, list] = ([], [])
        if blobs and left.num_rows:
            ids, numbers, first, count, before, name = (np.concatenate(x) for x in zip(*blobs, strict=True))
            texts = dict(_texts(left))
            part = (name % np.uint64(parts)).astype(np.int64)
            order, pieces = [], []
            for doc, rows in _per_document(ids, numbers):
                text = texts[doc]
                rows = rows[np.argsort(first[rows], kind="stable")]
                order.append(rows)
                pieces += [text[a : a + n + LENGTH - 1] for a, n in zip(first[rows].tolist(), count[rows].tolist(), strict=True)]
            order = np.concatenate(order)
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part[order] == p)
                r = order[at]
                out[0].append(p)
                out[1].append(pack(ids[r], numbers[r], np.full(len(r), home, np.uint32), first[r], count[r], name[r], np.frombuffer(b"".join([pieces[k] for k in at.tolist()]), np.uint8), level=3))
        return pa.table({"part": pa.array(out[0], pa.int32()), "runs": pa.array(out[1], pa.binary())})

    return run


def _pieces(name: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Rows in pieces of some REFINE_BYTES, all those of a name in one."""
    order = np.argsort(name, kind="stable")
    begin = np.cumsum(sizes[order]) - sizes[order]
    group = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]][: len(order)])
    cut = group[1:][np.diff(begin[group] // REFINE_BYTES) != 0]
    return np.split(order, cut) if len(order) else []


def _again(ids: np.ndarray, numbers: np.ndarray, first: np.ndarray, count: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run, first, count) of the strings of runs that also start earlier in one of them; data: the bytes of the runs, one after the other."""
    begin = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    run = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    string = suffix_buckets(data)[begin[run] + step]
    rows = _repeated(string)
    r, at = run[rows], first[run[rows]].astype(np.int64) + step[rows]
    order = np.lexsort((at, numbers[r], ids[r], string[rows]))
    s, r, at = string[rows][order], r[order], at[order]
    lead = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]][: len(s)], np.arange(len(s)), 0))
    later = (ids[r] != ids[r[lead]]) | (numbers[r] != numbers[r[lead]]) | (at != at[lead])
    r, at = r[later], at[later]
    # neighbouring strings of a run as one
    sort = np.lexsort((at, r))
    r, at = r[sort], at[sort]
    cut = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(at) != 1)][: len(r)])
    return r[cut], at[cut].astype(np.uint32), np.diff(np.r_[cut, len(r)]).astype(np.uint8)


@lean_group
def _refine(t: pa.Table) -> pa.Table:
    """Of the strings of a part's runs: those that also start earlier, by the home of the document. Equal strings have the same gram and part."""
    ids, numbers, homes, first, count, name, data = (np.concatenate(x) for x in zip(*[unpack(x) for x in t["runs"].to_pylist()], strict=True))
    count = count.astype(np.int64)
    sizes = count + LENGTH - 1
    end = np.cumsum(sizes)
    found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint8))]
    for own in _pieces(name, sizes):
        texts = np.concatenate([data[a:z] for a, z in zip((end - sizes)[own].tolist(), end[own].tolist(), strict=True)])
        r, at, n = _again(ids[own], numbers[own], first[own], count[own], texts)
        found.append((own[r], at, n))
    r, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
    k, v = _by_home(homes[r], [ids[r], numbers[r], at, n])
    return pa.table({"home": pa.array(k, pa.int32()), "kind": pa.array([0] * len(k), pa.int32()), "flags": pa.array(v, pa.binary())})


@lean_group
def _remove(left: pa.Table, right: pa.Table, whole_characters: bool) -> pa.Table:
    """The texts of a home without their marked strings."""
    blobs = [unpack(x) for x in right["flags"].to_pylist()]
    marks = {}
    if blobs:
        ids, numbers, first, count = (np.concatenate(x) for x in zip(*blobs, strict=True))
        marks = {doc: (first[r].astype(np.int64), count[r].astype(np.int64)) for doc, r in _per_document(ids, numbers)}
    removed, spans, kept = [], [], []
    for doc, text in _texts(left):
        if doc not in marks:
            removed.append(0)
            spans.append(0)
            kept.append(text)
            continue
        a, n = marks[doc]
        edge = np.bincount(a, minlength=len(text) + 1)[: len(text) + 1] - np.bincount(a + n + LENGTH - 1, minlength=len(text) + 1)[: len(text) + 1]
        gone = np.cumsum(edge)[:-1] > 0
        removed.append(int(gone.sum()))
        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
        kept.append(rest.decode("utf-8", "ignore").encode() if whole_characters else rest)
    return pa.table({"doc_id": left["doc_id"], "n_bytes": pa.array([len(x) for x in left["text"].cast(pa.binary()).to_pylist()], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "row": left["row"]})


def remove_repeats(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, row) for every row of docs(doc_id, text); row: its further columns.

    whole_characters: what is left of a character of which bytes are removed isn't kept either.

    kept has the bytes of the UTF-8 text that are in no string of LENGTH bytes which also starts earlier: in a document with a smaller
    doc_id, or earlier in the same. Strings never cross documents and are judged on the input. Null and empty texts have no bytes; texts of
    less than LENGTH bytes stay whole; long texts are read whole, in overlapping segments. A null doc_id comes before all others; rows that
    repeat a doc_id with another text come in the order of a hash of their texts, and rows that repeat both are one document, of which each
    row is returned. An empty table gives an empty result.
    """
    others = [F.struct(*([column(docs, c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(None).cast("int").alias("none")])).alias("row")]
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *others)
    size, n = given.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts, bits = parts_for(size or 0, GROUP_BYTES), map_bits(n)
    home = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("home")  # with the text, as an id may be null or repeated
    found = given.select("doc_id", "text", home).mapInArrow(_find(parts), "part int, runs binary")
    flagged = "home int, kind int, flags binary"
    flags = saved(dealt(found, parts, "part").groupBy("part").applyInArrow(_sort_out, flagged))
    some, open_ = (id_map(flags.where(c).select("flags"), _flagged, bits) for c in ("true", "kind = 1"))
    gone = flags.where("kind = 0")
    if open_.any():
        left = dealt(marked(given.select("doc_id", "text", home), open_), parts, "home").groupBy("home")
        fetched = left.cogroup(dealt(flags.where("kind = 1"), parts, "home").groupBy("home")).applyInArrow(_fetch(parts), "part int, runs binary")
        gone = gone.union(dealt(fetched, parts, "part").groupBy("part").applyInArrow(_refine, flagged))
    out = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), given.schema["row"]])
    left = dealt(marked(given.select("doc_id", "text", "row", home), some), parts, "home").groupBy("home")
    cleaned = left.cogroup(dealt(gone, parts, "home").groupBy("home")).applyInArrow(lambda a, b: _remove(a, b, whole_characters), out)
    same = marked(given, some, False).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"), "row")
    return cleaned.union(same)


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs with what is kept of each text, in the columns of docs; documents of which nothing is left are dropped.

    A character of which bytes are missing is dropped; n_chars, where there is such a column, counts what is left.
    """
    out = remove_repeats(docs, True).where(F.length("kept") > 0).select("doc_id", F.col("kept").cast("string").alias("text"), "row")
    columns = [F.col("doc_id").cast(f.dataType).alias(f.name) if f.name == "doc_id" else F.col("text") if f.name == "text" else F.length("text").cast(f.dataType).alias("n_chars") if f.name == "n_chars" else F.col("row.`" + f.name.replace("`", "``") + "`") for f in docs.schema]
    return out.select(*columns)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_array_dedup": op4_suffix_array_dedup}
#: Texts as hex digits, two for each byte; a string that comes again starts at a row whose rank is over one.
ORACLE_SQL = {
    "op4_suffix_array_dedup": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM d),
c AS (SELECT doc_id, n_bytes - {LENGTH - 1} - 1000 * k AS left_over, 1000 * k AS o, substr(h, 2000 * k + 1, {2000 + 2 * LENGTH - 2}) AS part
      FROM (SELECT *, unnest(range((n_bytes + 999) // 1000)) AS k FROM n)),
w AS (SELECT doc_id, o + i AS s, md5(substr(part, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT *, unnest(range(least(1000, left_over))) AS i FROM c WHERE left_over > 0)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS rank FROM w),
g AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM r WHERE rank > 1),
x AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM g),
p AS (SELECT doc_id, span, min(s) AS a, max(s) + {LENGTH} AS z FROM x GROUP BY doc_id, span),
q AS (SELECT doc_id, span, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM p),
k AS (SELECT q.doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
      FROM q JOIN n ON q.doc_id = n.doc_id GROUP BY q.doc_id)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN k ON n.doc_id = k.doc_id"""
}
