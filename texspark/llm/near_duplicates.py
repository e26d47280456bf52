"""Exact Jaccard join of word-shingle sets by a token-group matrix.

Documents with equal sets are one class. Similar classes are put into groups (the most
popular of a few min-hash bands of each class), and the matrix holds which group has which
token. Two different sets that are similar share their SHARED first tokens in a common
order of all tokens, and these lie in the first |set| - ceil(t |set|) + SHARED tokens of
either. So the matrix keeps just these prefixes, and only pairs of groups that share
SHARED tokens are looked at. There the group's token union, kept as a bitmap of hashed
tokens, bounds the overlap: bits of a class that the union lacks are tokens it lacks. The
group is opened, and those of its members whose own bitmaps pass are compared with the
class token by token, only if t |set| tokens may be common.

Any order and any grouping give the same links. The order puts tokens that many documents
share last, so that common lines and passages don't bring documents together; for that, all
tokens of all documents are counted. Groups are
connected first: members of a cell (a group's part of a bounded size) are held against each
other, and a few leaders of the group against all its cells. Whatever is connected then
need not meet again: where two groups, or two cells of one, are held against each other,
only classes outside the component that most of the other side belongs to are sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texspark.llm.common import dropped, saved, table, text_slices
from texspark.llm.components import components
from texspark.llm.shingles import shingle_sets

U = np.uint64
#: Popular bands that make groups, at most.
POPULAR = 1 << 18
#: Bits by which tokens are counted; parts, by the bits before the last 32 of these, that the counts travel in; and cells of a part, a byte each, by which the order knows tokens (16 MB in all).
KNOWN_BITS, CELL_BITS, PARTS, CELLS = 40, 24, 1 << 8, 1 << 16
#: Bands of two min-hashes each, from which a class takes its group.
BANDS = 4
#: Members of a cell at most (about), and leaders of a group that meet all its cells.
GROUP, LEADERS = 512, 8
#: Tokens that the prefixes of two similar sets must share, if the threshold allows that many.
SHARED = 4
#: Bits of the bitmap by which rows are looked up before they are joined (8 MB).
LOOKUP = 1 << 26
#: Digests that a task remembers, to describe a copied text once.
SEEN = 1 << 17
_BAND_AT = np.arange(BANDS, dtype=U) << U(62)
_NO_ID = -(1 << 63)

#: Bits of the bitmap of a set of up to half as many tokens; larger sets have larger bitmaps.
BITS = 2048

_SETS = "did long, key long, doc_id long, n long, fp binary, gid long, bits binary, rare array<long>, common array<long>"


def smallest(percent: int) -> int:
    """Tokens of the smallest set that is similar to a different one; such pairs share as many at least."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def prefix(n: int, percent: int) -> int:
    """Tokens of a set of n among which those lie that a similar set's prefix must share."""
    return n - needed(n, percent) + min(SHARED, smallest(percent))


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any set it is similar to, at least."""
    return -(-percent * n // 100)


def bands_of(tokens: np.ndarray) -> np.ndarray:
    """A sorted set's min-hash bands: pairs of neighbours at fixed places of the hash range."""
    at = np.searchsorted(tokens, _BAND_AT) % len(tokens)
    with np.errstate(over="ignore"):
        return tokens[at] * U(0x9E3779B97F4A7C15) ^ tokens[(at + 1) % len(tokens)]


def counted(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """How many documents have each token and each band: rows (part, levels) and (band, n), for bands that two have or more.

    levels has the level() of each of a part's cells, in order: that of the cell's most
    frequent token. band is a band's first KNOWN_BITS bits; bands, and tokens, that share
    them count as one. Every token of every set that may be similar to a different one is
    counted, and counts don't depend on how documents are dealt to tasks. They travel as
    arrays.
    """
    least = smallest(percent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = ([], []), 0

        def handed() -> Iterator[pa.RecordBatch]:
            for kind, values in enumerate(waiting):
                tokens, counts = np.unique(np.concatenate([np.zeros(0, U), *values]) >> U(64 - KNOWN_BITS), return_counts=True)
                cuts = np.searchsorted(tokens, np.arange(PARTS + 1, dtype=U) << U(32))
                some = np.flatnonzero(np.diff(cuts)).tolist()
                blobs = [pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()) for x in (tokens.astype(np.uint32), counts.astype(np.uint32))]
                yield pa.record_batch({"part": pa.array([kind * PARTS + k for k in some], pa.int32()), "tokens": blobs[0], "counts": blobs[1]})

        for batch in batches:
            for part in text_slices(batch):
                for s in shingle_sets(part.column("text"), size):
                    if len(s) >= least:
                        waiting[0].append(s)
                        waiting[1].append(bands_of(s))
                        held += len(s)
                if held > 1 << 20:
                    yield from handed()
                    waiting, held = ([], []), 0
        yield from handed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrays that come part by part; one part is held at a time."""
        at, tokens, counts, waiting, held = None, np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, which = np.unique(np.concatenate([tokens, *(x for x, _ in waiting)]), return_inverse=True)
            return found, np.bincount(which, weights=np.concatenate([counts, *(n for _, n in waiting)]), minlength=len(found)).astype(np.int64)

        def done() -> pa.RecordBatch:
            found, n = merged()
            if at >= PARTS:
                some = n >= 2
                band, n = found[some].astype(np.int64) + (at - PARTS << 32), n[some]
                return pa.record_batch({"part": pa.nulls(len(n), pa.int32()), "levels": pa.nulls(len(n), pa.binary()), "band": pa.array(band), "n": pa.array(n)})
            levels = np.zeros(CELLS, np.uint8)
            np.maximum.at(levels, found >> np.uint32(16), level(n))
            return pa.record_batch({"part": pa.array([at], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary()), "band": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64())})

        for batch in batches:
            for part, *blobs in zip(batch.column("part").to_pylist(), batch.column("tokens").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if part != at:
                    if at is not None:
                        yield done()
                    at, tokens, counts, waiting, held = part, tokens[:0], counts[:0], [], 0
                waiting.append(tuple(np.frombuffer(x, np.uint32) for x in blobs))
                held += len(waiting[-1][0])
                if held > 1 << 22:
                    (tokens, counts), waiting, held = merged(), [], 0
        if at is not None:
            yield done()

    partial = docs.select("text").mapInArrow(count, "part int, tokens binary, counts binary")
    return partial.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, levels binary, band long, n long")


def frequent(docs: DataFrame, size: int, percent: int) -> tuple[np.ndarray, ...]:
    """The levels of all cells of tokens; and the bands that most documents have, POPULAR at most, sorted, with counts.

    The driver sees PARTS * CELLS bytes, and 16 bytes for each of these bands.
    """
    counts = saved(counted(docs, size, percent), "frequent")
    levels = np.zeros((PARTS, CELLS), np.uint8)
    for row in counts.where("part is not null").select("part", "levels").collect():
        levels[row.part] = np.frombuffer(row.levels, np.uint8)
    own = counts.where("band is not null")
    steps = own.groupBy("n").count().orderBy(F.desc("n")).limit(POPULAR).collect()  # sizes of the list by its least count
    at_least, total = 1 << 62, 0
    for row in steps:
        if total + row["count"] > POPULAR:
            break
        total, at_least = total + row["count"], row.n
    found = own.where(F.col("n") >= at_least).select("band", "n").toArrow()
    bands, n = found["band"].to_numpy().view(U), found["n"].to_numpy()
    order = np.argsort(bands)
    dropped(counts)
    return levels.reshape(-1), bands[order], n[order]


def level(n: np.ndarray) -> np.ndarray:
    """A count in eighths of a power of two, as a byte; 0 for tokens of fewer than four documents, which are rare."""
    return np.where(n < 4, 0, np.minimum(8 * np.log2(np.maximum(n, 1)), 255)).astype(np.uint8)


def in_order(tokens: np.ndarray, first: int, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of a sorted set: rare ones by value, then common ones by count."""
    if not len(common):
        return tokens[:first], tokens[:0]
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    is_common = common[at] == tokens
    rare = tokens[~is_common][:first]
    at, rest = at[is_common], tokens[is_common]
    return rare, rest[np.lexsort((rest, counts[at]))][: first - len(rare)]


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit for each token's hash; a larger bitmap folds into a smaller one."""
    size = max(BITS, 1 << (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(tokens & U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded_to(bits: bytes, size: int) -> np.ndarray:
    """The bitmap folded to `size` bytes, as zeros and ones."""
    return np.unpackbits(np.bitwise_or.reduce(np.frombuffer(bits, dtype=np.uint8).reshape(-1, size), axis=0), bitorder="little")


def may_link(members: list[tuple[int, bytes]], queries: list[tuple[int, bytes]] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members and queries (size, bitmap) may link with another, by the bitmaps' bound.

    Bits of a set that another lacks are tokens that it lacks. Without queries, the
    members are queries to one another.
    """
    asking = members if queries is None else queries
    size = min(1024, *(len(b) for _, b in [*members, *asking]))
    mine = np.array([folded_to(b, size) for _, b in members])
    lacking = (1 - mine).astype(np.float32)
    n_mine, n_asking = np.array([n for n, _ in members]), np.array([n for n, _ in asking])
    union = mine.any(axis=0)
    keep_members, keep_asking = np.zeros(len(members), dtype=bool), np.zeros(len(asking), dtype=bool)
    for k in range(0, len(asking), 256):
        theirs = np.array([folded_to(b, size) for _, b in asking[k : k + 256]])
        n = n_asking[k : k + 256]
        open_ = n - (theirs & ~union).sum(axis=1) >= -(-percent * n // 100)  # the group's bound
        if not open_.any():
            continue
        at, theirs, n = k + np.flatnonzero(open_), theirs[open_], n[open_]
        most = np.minimum(n[:, None] - theirs.astype(np.float32) @ lacking.T, n_mine[None, :] - (1 - theirs).astype(np.float32) @ mine.T.astype(np.float32))
        alike = 100 * most >= percent * (n[:, None] + n_mine[None, :] - most)
        if queries is None:
            alike[np.arange(len(at)), at] = False
        keep_members |= alike.any(axis=0)
        keep_asking[at] |= alike.any(axis=1)
    return keep_members, keep_asking


def described(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Each document's set: its size, digest, group, bitmap and prefix. A task gives the last two once for equal sets."""
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, size, percent))
    least = smallest(percent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, popular, sizes = known.value
        seen: set[bytes] = set()
        for batch in batches:
            for part in text_slices(batch):
                n, fp, gid, bits, rare, common = [], [], [], [], [], []
                for s in shingle_sets(part.column("text"), size):
                    n.append(len(s))
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    fp.append(digest)
                    gid.append(int.from_bytes(digest[:8], "big", signed=True) if digest else None)
                    bands = bands_of(s) if len(s) >= least else s[:0]
                    short = bands >> U(64 - KNOWN_BITS)
                    at = np.searchsorted(popular, short)
                    hits = [(sizes[k], b) for k, b, x in zip(at.tolist(), bands.tolist(), short.tolist(), strict=True) if k < len(popular) and popular[k] == x]
                    if hits:
                        gid[-1] = int(U(max(hits)[1]).view(np.int64))
                    if digest is None or digest in seen:
                        for column in (bits, rare, common):
                            column.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    bits.append(bitmap(s))
                    own = levels[(s >> U(64 - CELL_BITS)).astype(np.int64)]
                    for column, part_of in zip((rare, common), in_order(s, prefix(len(s), percent) if len(s) >= least else 0, s[own > 0], own[own > 0]), strict=True):
                        column.append(part_of.view(np.int64))
                long, longs, binary = pa.int64(), pa.list_(pa.int64()), pa.binary()
                yield pa.record_batch({"did": part.column("did"), "key": part.column("key"), "doc_id": part.column("doc_id"), "n": pa.array(n, long), "fp": pa.array(fp, binary), "gid": pa.array(gid, long), "bits": pa.array(bits, binary), "rare": pa.array(rare, longs), "common": pa.array(common, longs)})

    return saved(docs.mapInArrow(describe, _SETS), "sets")


def compared(members: list[np.ndarray], queries: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links (query, member) of similar sets, or among the members if there are no queries: as many as join them up."""
    sizes = np.array([len(m) for m in members])
    union, ids = np.unique(np.concatenate(members), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    flags = np.zeros(len(union) + 1, dtype=np.int64)
    own = 0 if queries is None else len(members)  # queries come after the members
    root = np.arange(own + len(members if queries is None else queries))
    for q, tokens in enumerate(members if queries is None else queries):
        if queries is None:
            at = ids[begins[q] : begins[q] + sizes[q]]
        else:
            at = np.searchsorted(union, tokens)
            at = at[(at < len(union)) & (union[np.minimum(at, len(union) - 1)] == tokens)]
            if len(at) < needed(len(tokens), percent):  # the union's bound, now exactly
                continue
        flags[at] = 1
        overlap = np.add.reduceat(flags[ids], begins)
        flags[at] = 0
        alike = np.flatnonzero(100 * overlap >= percent * (sizes + len(tokens) - overlap))
        for m in alike.tolist():
            if root[m] != root[own + q]:
                root[root == root[m]] = root[own + q]
                yield q, m


def visits_of(batches: Iterator[pa.RecordBatch], inside: bool, *columns: str) -> Iterator[tuple[int, dict, dict]]:
    """From rows (to, role, fp, columns) sorted by the first two: each cell with its members and up to GROUP queries.

    The members come with each block of queries, and before that with none, if `inside` asks for it.
    """
    cell, members, queries = None, {}, {}
    for batch in batches:
        values = batch.column(columns[0]).to_pylist() if len(columns) == 1 else list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for to, role, fp, value in zip(*(batch.column(c).to_pylist() for c in ("to", "role", "fp")), values, strict=True):
            if to != cell:
                if queries or inside and len(members) > 1:
                    yield cell, members, queries
                cell, members, queries = to, {}, {}
            if not role:
                members[fp] = value
                continue
            if inside and not queries and len(members) > 1:
                yield cell, members, {}
            queries[fp] = value
            if len(queries) >= GROUP:
                yield cell, members, queries
                queries = {}
    if queries or inside and len(members) > 1:
        yield cell, members, queries


def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, gid) sorted by both, the distinct ones whose token is in two groups or more."""

    def shared(tokens: np.ndarray, gids: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (gids[1:] != gids[:-1])
        tokens, gids = tokens[new], gids[new]
        _, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
        some = n[at] > 1
        return pa.record_batch({"token": pa.array(tokens[some]), "gid": pa.array(gids[some])})

    tokens = gids = np.zeros(0, np.int64)
    for batch in batches:
        tokens, gids = np.concatenate([tokens, batch.column("token").to_numpy()]), np.concatenate([gids, batch.column("gid").to_numpy()])
        if len(tokens):
            last = np.searchsorted(tokens, tokens[-1])  # its other rows may still come
            yield shared(tokens[:last], gids[:last])
            tokens, gids = tokens[last:], gids[last:]
    yield shared(tokens, gids)


def among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key (a long) may be in the one column of keys: all that are, and a few others.

    The keys are hashed into a bitmap of LOOKUP bits, which is broadcast (2,048 rows of 4 KB at most).
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(LOOKUP))
    bits = keys.select(place(F.col(keys.columns[0])).alias("_at")).select(F.shiftright("_at", 15).alias("_page"), (F.col("_at") % 32768).alias("_at"))
    pages = bits.groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    found = rows.withColumn("_key", place(key)).withColumn("_page", F.shiftright("_key", 15)).join(F.broadcast(pages), "_page")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_key") % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return found.where(F.bit_get(byte, (F.col("_key") % 8).cast("int")) == 1).select(*rows.columns)


def links_of(visits: DataFrame, classes: DataFrame, docs: DataFrame, inside: bool, size: int, percent: int) -> DataFrame:
    """Links (a, b) of similar classes that visits (fp, gid, chunk, role) bring together: those that join them up.

    Members (role 0) of a cell (gid, chunk) meet its queries (role 1), and each other if
    `inside` says so. A cell with many queries is copied, and they are dealt to the copies.
    """
    cell = ["gid", "chunk"]
    copies = visits.where("role = 1").groupBy(*cell).agg(F.ceil(F.count("*") / (2 * GROUP)).alias("copies")).where("copies > 1")
    dealt = visits.join(copies, cell, "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("copies")))
    dealt = dealt.withColumn("copy", F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(own)))
    dealt = saved(dealt.select("fp", "role", F.xxhash64("gid", "chunk", "copy").alias("to")), "dealt")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, members, queries in visits_of(batches, inside, "did", "key", "n", "bits"):
            if not members:
                continue
            kept = may_link([x[2:] for x in members.values()], [x[2:] for x in queries.values()] if queries else None, percent)
            for role, rows, keep in ((0, members, kept[0]), (1, queries, kept[1])):
                some = [(fp, *x[:2]) for (fp, x), k in zip(rows.items(), keep.tolist(), strict=False) if k]
                yield pa.record_batch({"fp": pa.array([x[0] for x in some], pa.binary()), "did": pa.array([x[1] for x in some], pa.int64()), "key": pa.array([x[2] for x in some], pa.int64()), "to": pa.array([to] * len(some), pa.int64()), "role": pa.array([role] * len(some), pa.int32())})

    asked = among(classes.select("fp", "did", "key", "n", "bits"), F.xxhash64("fp"), dealt.select(F.xxhash64("fp").alias("k"))).join(dealt, "fp")
    bounded = asked.repartition("to").sortWithinPartitions("to", "role", "fp").mapInArrow(bound, "fp binary, did long, key long, to long, role int")
    opened = saved(bounded.distinct().groupBy("fp", "did", "key").agg(F.collect_list(F.struct("to", "role")).alias("visits")), "opened")

    # One text for each class that is opened; ids and texts may repeat.
    texts = among(docs.select("did", "key", "text"), F.xxhash64("did", "key"), opened.select(F.xxhash64("did", "key").alias("k")))
    wanted = texts.groupBy("did", "key").agg(F.first("text").alias("text")).join(opened, ["did", "key"])

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets_of = [s.tobytes() for s in shingle_sets(part.column("text"), size)]
                yield pa.record_batch({"fp": part.column("fp"), "visits": part.column("visits"), "tokens": pa.array(sets_of, pa.binary())})

    rows = wanted.select("text", "fp", "visits").mapInArrow(tokens_of, "fp binary, visits array<struct<to:long,role:int>>, tokens binary")
    rows = rows.select("fp", "tokens", F.explode("visits").alias("v")).select("v.to", "v.role", "fp", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members, queries in visits_of(batches, inside, "tokens"):
            if not members:
                continue
            names, sets_of = list(members), [np.frombuffer(t, dtype=U) for t in members.values()]
            asking, tokens = list(queries or names), [np.frombuffer(t, dtype=U) for t in queries.values()] if queries else None
            found = [(asking[q], names[m]) for q, m in compared(sets_of, tokens, percent)]
            yield pa.record_batch({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    links = saved(rows.repartition("to").sortWithinPartitions("to", "role", "fp").mapInArrow(compare, "a binary, b binary"), "links")
    dropped(dealt, opened)
    return links


def matrix_of(sets: DataFrame) -> DataFrame:
    """Which group's prefixes have which token (token, gid), for tokens that two groups or more have.

    Common tokens are made distinct before they are dealt out, so no token has many rows.
    """
    entries = sets.select(F.explode("rare").alias("token"), "gid").unionByName(sets.select(F.explode("common").alias("token"), "gid").distinct())
    return saved(entries.repartition("token").sortWithinPartitions("token", "gid").mapInArrow(shared_tokens, "token long, gid long"), "matrix")


def similar(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near duplicates of documents (doc_id, text).

    Returns a row for each document: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach, its own included; null only if all of them are null), key
    (the text's xxhash64) and leads (whether the row's doc_id and key are the smallest in
    its component, so that each component has one leading document, and its repetitions).
    Sets are those of distinct shingles of `size` words ([^\\x20\\x09-\\x0D]+, A-Z in lower
    case), or the whole sequence of fewer words; two link if 100 * intersection >= percent
    * union. Null and empty texts have no set and link with nothing, not even with each
    other; each leads. Repeated rows are copies of one another. A very long text is held
    whole, by a task, as some 40 bytes of arrays for each of its bytes. An empty table
    gives no rows; other columns are ignored.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = described(docs, size, percent)
    full = sets.where("n > 0")
    classes = full.groupBy("fp").agg(F.min(F.struct("did", "key")).alias("first"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("bits", True).alias("bits"))
    classes = saved(classes.select("fp", "first.*", "doc_id", "n", "gid", "bits"), "classes")

    # Groups, and the cells of a group of more than GROUP classes.
    groups = classes.groupBy("gid").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("most")).withColumn("chunks", F.ceil(F.col("members") / GROUP))
    large = groups.where("members > 1").select("gid", "chunks")
    placed = classes.select("fp", "gid").join(large, "gid", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = saved(placed.select("fp", "gid", "chunks", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk")), "placed")
    every = lambda chunks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1)).alias("chunk")

    # Connect each group: its cells' members meet, and its leaders meet all cells.
    home = placed.join(large.select("gid"), "gid", "left_semi").select("fp", "gid", "chunk", F.lit(0).alias("role"))
    leaders = placed.where("chunks > 1").groupBy("gid", "chunks", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(LEADERS)).alias("slot")).agg(F.min("fp").alias("fp"))
    first = links_of(home.unionByName(leaders.select("fp", "gid", every("chunks"), F.lit(1).alias("role"))), classes, docs, True, size, percent)

    # What is connected, and the component that most of a group belongs to.
    known = components(first)
    labelled = saved(placed.join(known, F.col("fp") == F.col("node"), "left").select("fp", "gid", "chunk", "chunks", F.coalesce("label", "fp").alias("label")), "labelled")
    major = labelled.where("chunks > 1 or label <> fp").groupBy("gid", "label").count().groupBy("gid").agg(F.max_by("label", F.struct("count", "label")).alias("major"))
    groups = saved(groups.join(major, "gid", "left"), "groups")

    # Pairs of groups that share tokens enough. Of the smaller one, classes outside the larger one's major component ask it;
    # if others are inside, the larger one's outsiders ask back. In a group, outsiders ask its other cells.
    matrix = matrix_of(sets)
    a, b = matrix.alias("a"), matrix.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.gid") < F.col("b.gid"))).groupBy(F.col("a.gid").alias("x"), F.col("b.gid").alias("y")).count()
    pairs = pairs.where(F.col("count") >= min(SHARED, smallest(percent))).select("x", "y")
    for s in "xy":
        pairs = pairs.join(groups.select(*(F.col(c).alias(f"{c}_{s}") for c in groups.columns)), F.col(s) == F.col(f"gid_{s}"))
    pairs = pairs.where(f"100 * most_x >= {percent} * least_y and 100 * most_y >= {percent} * least_x")
    sides = [F.struct(*(F.col(f"{c}_{s}").alias(c) for c in ("gid", "chunks", "major"))) for s in "xy"]
    smaller = F.col("members_x") <= F.col("members_y")
    pairs = saved(pairs.select(F.when(smaller, sides[0]).otherwise(sides[1]).alias("s"), F.when(smaller, sides[1]).otherwise(sides[0]).alias("l")), "pairs")
    outside = ~F.col("label").eqNullSafe(F.col("major"))
    asks = labelled.join(pairs.select(F.col("s.gid").alias("gid"), F.col("l.gid").alias("to"), F.col("l.chunks").alias("of"), F.col("l.major").alias("major")), "gid").where(outside).select("fp", F.col("to").alias("gid"), every("of"))
    inside = pairs.where("l.major is not null").select(F.col("s.gid").alias("gid"), F.col("s.chunks").alias("of"), F.col("l.gid").alias("from"), F.col("l.major").alias("label"))
    inside = inside.join(labelled.select("gid", "label").distinct(), ["gid", "label"], "left_semi").select(F.col("gid").alias("to"), "of", F.col("from").alias("gid"), F.col("label").alias("major"))
    back = labelled.join(inside, "gid").where(outside).select("fp", F.col("to").alias("gid"), every("of"))
    own = labelled.where("chunks > 1").withColumnRenamed("chunk", "at").join(groups.select("gid", "major"), "gid").where(outside).select("fp", "gid", "at", every("chunks")).where("chunk <> at").select("fp", "gid", "chunk")
    queries = saved(asks.unionByName(back).unionByName(own).distinct().withColumn("role", F.lit(1)), "queries")
    members = labelled.join(queries.select("gid", "chunk").distinct(), ["gid", "chunk"], "left_semi").select("fp", "gid", "chunk", F.lit(0).alias("role"))
    second = links_of(queries.unionByName(members), classes, docs, False, size, percent)
    dropped(matrix, pairs, queries, placed, labelled, groups)

    labels = components(first.unionByName(second))
    placed = classes.select("fp", "doc_id", "did", "key").join(labels, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", "did", "key", F.coalesce("label", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("did", "key")).alias("lead"))
    of_class = saved(placed.select("fp", "component").join(least, "component").select("fp", "component_id", "lead"), "components")
    dropped(first, second, classes)
    leads = (F.col("did") == F.col("lead.did")) & (F.col("key") == F.col("lead.key"))
    linked = full.select("doc_id", "did", "key", "n", "fp").join(of_class, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "key", leads.alias("leads"))
    return linked.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key", F.lit(True).alias("leads")))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document's shingle count and near-duplicate component."""
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def oracle() -> str:
    """The columns and rows of op5_near_duplicates in DuckDB."""
    return r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS seen FROM sets UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.seen = links.x)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, least.component_id FROM sets JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) least USING (doc_id)"""
