"""Mixture-controlled packing of tokenised documents into fixed windows.

Documents are hashed to lanes of a few megabytes. A first pass tokenises each lane and
keeps it as one row in the shared folder, together with its tokens per source. From
these sums each lane learns the deficits that the lanes before it have left, so lanes
run in parallel and yet carry whole deficits from one to the next, which are paid off
over as many windows as it takes. Texts of more than 4 MB are cut before single spaces,
which changes no ids, and dealt over lanes in turn. A second pass runs a deficit
round-robin over the source queues of each lane: every window credits each
queue with its share of the window, queues with credit for a whole quantum are served
in turn, and what is left of the credit goes to the next window. Queues that run dry
hand their share to the others.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texspark.llm.common import given_back, saved

_LANE = "lane long, sources array<string>, source_tokens array<long>, doc_ids array<long>, doc_source array<int>, doc_tokens array<long>, doc_rows array<long>, doc_parts array<int>, ids binary"
_PIECE = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
# Fixed value: the public pattern of byte_bpe_50k, with the same splits as public_tokenizers.PATTERN but less backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: White space so long that the pattern would run out of stack, as the characters with Unicode's property.
_LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")


def added_tokens(vocabulary_path: str) -> dict[str, int]:
    """The tokens that a tokenizers file adds to its vocabulary; they are found in texts before all else."""
    with open(vocabulary_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Encoder:
    """Byte-level BPE with added tokens."""

    def __init__(self, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = dict(added)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.dtype = "<u2" if max([*ranks.values(), *self.added.values()]) < 1 << 16 else "<u4"

    def __call__(self, text: str) -> bytes:
        if self.split and any(t in text for t in self.added):
            return b"".join(np.array([self.added[s]], self.dtype).tobytes() if s in self.added else self.ordinary(s) for s in self.split.split(text))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without added tokens. White space is one piece but for its last character, if a word follows."""
        ids, at = [], 0
        for m in _LONG_BLANK.finditer(text):
            ids += [self.plain(text[at : m.start()]), self.bpe._encode_single_piece(m.group()[: None if m.end() == len(text) else -1])]
            at = m.end() if m.end() == len(text) else m.end() - 1
        return b"".join(np.asarray(x, self.dtype).tobytes() for x in (*ids, self.plain(text[at:])))

    def plain(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=())


_encoders: dict[tuple, Encoder] = {}


def encoder(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...]) -> Encoder:
    """One encoder for each worker process."""
    key = (ranks_path, pattern, added)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def deficit_round_robin(lengths: list[list[int]], shares: list[float], carry: list[float], rooms: Iterator[int], quantum: int):
    """Serve the queues (token lengths of their documents) into windows of the given rooms.

    Yields (queue, document in it, start, length, window, offset).
    """
    n = len(lengths)
    credit, head, at = list(carry), [0] * n, [0] * n
    left = [sum(x) for x in lengths]
    turn = 0
    for window, size in enumerate(rooms):
        room = size
        active = [q for q in range(n) if left[q]]
        weight = sum(shares[q] for q in active)
        for q in active:
            credit[q] += size * (shares[q] / weight if weight > 0 else 1 / len(active))
        while room:
            served = False
            for step in range(n):
                q = (turn + step) % n
                if room and left[q] and credit[q] >= min(quantum, left[q], room):
                    budget, served = min(room, left[q], int(credit[q])), True
                    turn = q + 1
                    break
            if not served:  # nobody has a quantum: the queue with most credit goes into debt
                q = max((q for q in range(n) if left[q]), key=lambda q: (credit[q], -q))
                budget = min(room, left[q], quantum)
            credit[q] -= budget
            left[q] -= budget
            while budget:
                take = min(budget, lengths[q][head[q]] - at[q])
                yield q, head[q], at[q], take, window, size - room
                at[q] += take
                room -= take
                budget -= take
                if at[q] == lengths[q][head[q]]:
                    head[q], at[q] = head[q] + 1, 0


def rooms_of(total: int, window: int) -> Iterator[int]:
    """Full windows, then the rest as powers of two, which need no padding."""
    yield from [window] * (total // window)
    rest = total % window
    yield from (1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1)


def pack(docs: DataFrame, ranks_path: str, pattern: str, *, added: dict[str, int] | None = None, window: int = 1024, end_id: int = 0, targets: dict[str | None, float] | None = None, quantum: int = 128, lane_bytes: int = 4 << 20, part_bytes: int = 4 << 20) -> DataFrame:
    """Pack documents (doc_id, text, source) into windows of `window` tokens.

    added: tokens that are found in texts before all else, and their ids.
    targets: token share by source; by default each source's share of all tokens, which
    keeps the mixture the same from the first window to the last. Returns a row for each
    piece: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids (unsigned
    32-bit little-endian). A null text is an empty one, and each document ends with
    end_id, so an empty one is a single token. Null sources form a queue of their own;
    repeated rows are packed once each; an empty table gives no rows; other columns are
    ignored. Texts of more than part_bytes are cut and dealt over lanes.
    """
    extra = tuple((added or {}).items())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    lanes = max(1, -(-total // lane_bytes))
    # Texts above part_bytes come in parts of about that many bytes, known by their row and dealt to one lane after the other; others are one part.
    large = F.octet_length("text") > part_bytes
    least = F.greatest(F.lit(1), F.floor(F.length("text").cast("double") * part_bytes / F.octet_length("text"))).cast("string")
    cut = F.regexp_extract_all("text", F.concat(F.lit("(?s).{"), least, F.lit(",}?[A-Za-z0-9](?= [A-Za-z0-9])|.+")), F.lit(0))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # rows that are alike go to different lanes
    rows = rows.select("doc_id", "source", "_row", F.when(large, F.col("_row")).alias("row"), F.posexplode(F.when(large, cut).otherwise(F.array("text"))).alias("part", "text"), F.when(large, F.size(cut)).otherwise(1).alias("_parts"))
    rows = rows.select("doc_id", "text", "source", "row", "part", (F.col("part") == F.col("_parts") - 1).alias("last"), F.pmod(F.pmod(F.xxhash64("_row"), F.lit(lanes)) + F.col("part"), F.lit(lanes)).alias("lane"))

    def tokenise(group: pa.Table) -> pa.Table:
        encode = encoder(ranks_path, pattern, extra)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        width = len(end)
        order = np.lexsort((np.arange(group.num_rows), group["doc_id"].fill_null(-1).to_numpy()))
        ids, lengths = [], []
        texts, last = group["text"], group["last"].to_pylist()
        for i in order.tolist():
            ids.append(encode(texts[i].as_py()) + (end if last[i] else b""))
            lengths.append(len(ids[-1]) // width)
        sources = [group["source"][i].as_py() for i in order.tolist()]
        names = sorted(set(sources), key=lambda s: (s is None, s or ""))
        index = {s: k for k, s in enumerate(names)}
        which = np.array([index[s] for s in sources])
        sums = np.bincount(which, weights=lengths, minlength=len(names)).astype(np.int64)
        one = lambda x, kind: pa.array([x], kind)
        given_back()
        return pa.table({
            "lane": pa.array([group["lane"][0].as_py()], pa.int64()),
            "sources": one(names, pa.list_(pa.string())),
            "source_tokens": one(sums.tolist(), pa.list_(pa.int64())),
            "doc_ids": one(group["doc_id"].take(pa.array(order)).to_pylist(), pa.list_(pa.int64())),
            "doc_source": one(which.tolist(), pa.list_(pa.int32())),
            "doc_tokens": one(lengths, pa.list_(pa.int64())),
            "doc_rows": one(group["row"].take(pa.array(order)).to_pylist(), pa.list_(pa.int64())),
            "doc_parts": one(group["part"].take(pa.array(order)).to_pylist(), pa.list_(pa.int32())),
            "ids": one(b"".join(ids), pa.binary()),
        })

    lane_rows = saved(rows.withColumn("doc_id", F.col("doc_id").cast("long")).groupBy("lane").applyInArrow(tokenise, _LANE), "lanes")
    sums = lane_rows.select("lane", F.explode(F.arrays_zip("sources", "source_tokens")).alias("s")).select("lane", F.col("s.sources").alias("source"), F.col("s.source_tokens").alias("tokens"))
    everything = sums.agg(F.sum("tokens").alias("n")).first().n or 1
    shares = None if targets is None else {s: w / sum(targets.values()) for s, w in targets.items()}

    # What the lanes before have left: their tokens by the shares, minus what each source has had.
    blocks = sums.withColumn("block", F.floor(F.col("lane") / 1024))
    lane_total = Window.partitionBy("lane")
    due = blocks.select("lane", "block", "source", (F.lit(0.0) + F.sum("tokens").over(lane_total)).alias("all"), F.col("tokens").cast("double").alias("own"))
    by_block = due.groupBy("source", "block").agg(F.sum("own").alias("own"))
    before_block = by_block.withColumn("own_before", F.coalesce(F.sum("own").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("own").over(Window.partitionBy("source"))).drop("own")
    in_block = due.withColumn("own_here", F.coalesce(F.sum("own").over(Window.partitionBy("source", "block").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    mine = in_block.join(before_block, [in_block.source.eqNullSafe(before_block.source), in_block.block == before_block.block]).select("lane", in_block.source, (F.col("own_here") + F.col("own_before")).alias("before"), "total")
    lane_sums = due.groupBy("lane", "block").agg(F.first("all").alias("all"))
    block_sums = lane_sums.groupBy("block").agg(F.sum("all").alias("all"))
    # few rows: one for each 1,024 lanes (8 GB of text)
    block_before = block_sums.withColumn("all_before", F.coalesce(F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("all")
    lane_before = lane_sums.withColumn("all_here", F.coalesce(F.sum("all").over(Window.partitionBy("block").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).join(block_before, "block").select("lane", (F.col("all_here") + F.col("all_before")).alias("all_before"))
    carried = mine.join(lane_before, "lane").groupBy("lane").agg(F.sort_array(F.collect_list(F.struct("source", "before", "all_before", "total"))).alias("carried"))

    # Where the parts of large texts begin in their documents, and the documents' tokens.
    in_parts = lane_rows.select("lane", F.posexplode(F.arrays_zip("doc_rows", "doc_parts", "doc_tokens")).alias("at", "p")).where("p.doc_rows is not null").select("lane", "at", F.col("p.doc_rows").alias("row"), F.col("p.doc_parts").alias("part"), F.col("p.doc_tokens").alias("tokens"))
    of_row = Window.partitionBy("row")
    before_part = F.coalesce(F.sum("tokens").over(of_row.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = in_parts.select("lane", "at", before_part.alias("begin"), F.sum("tokens").over(of_row).alias("whole")).groupBy("lane").agg(F.collect_list(F.struct("at", "begin", "whole")).alias("parts"))

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lane in (batch.slice(i, 1) for i in range(batch.num_rows)):
                yield from served(lane)

    def served(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        r = {k: batch.column(k)[0] for k in ("lane", "sources", "carried", "parts", "doc_ids", "doc_source", "doc_tokens")}
        names, doc_ids = r["sources"].as_py(), r["doc_ids"].values
        lengths, which = r["doc_tokens"].values.to_numpy(), r["doc_source"].values.to_numpy()
        raw = batch.column("ids")[0].as_buffer()
        ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * lengths.sum() else "<u4").astype("<u4")
        begins = np.cumsum(lengths) - lengths
        carried = {x["source"]: x for x in r["carried"].as_py()}
        share = [carried[s]["total"] / everything if shares is None else shares.get(s, 0.0) for s in names]
        behind = [w * carried[s]["all_before"] - carried[s]["before"] for s, w in zip(names, share, strict=True)]
        starts, wholes = np.zeros(len(lengths), dtype=np.int64), lengths.copy()
        for x in r["parts"].as_py() or []:
            starts[x["at"]], wholes[x["at"]] = x["begin"], x["whole"]
        queues = [np.flatnonzero(which == k) for k in range(len(names))]
        plan = np.array(list(deficit_round_robin([lengths[q].tolist() for q in queues], share, behind, rooms_of(int(lengths.sum()), window), quantum)), dtype=np.int64)
        docs_at = np.concatenate(queues)
        first = np.cumsum([0] + [len(q) for q in queues])
        doc = docs_at[first[plan[:, 0]] + plan[:, 1]]
        cuts = begins[doc] + plan[:, 2]
        view = memoryview(ids).cast("B")
        for k in range(0, len(plan), 4096):
            s = slice(k, k + 4096)
            yield pa.record_batch({
                "doc_id": doc_ids.take(pa.array(doc[s])), "source": pa.array([names[q] for q in plan[s, 0]], pa.string()),
                "start": pa.array(starts[doc[s]] + plan[s, 2]), "length": pa.array(plan[s, 3]), "doc_tokens": pa.array(wholes[doc[s]]),
                "sequence_id": pa.array((r["lane"].as_py() << 24) + plan[s, 4]), "offset": pa.array(plan[s, 5]),
                "ids": pa.array([bytes(view[4 * a : 4 * (a + n)]) for a, n in zip(cuts[s].tolist(), plan[s, 3].tolist(), strict=True)], pa.binary()),
            })

    return lane_rows.join(carried, "lane").join(parts, "lane", "left").drop("source_tokens", "doc_rows", "doc_parts").mapInArrow(serve, _PIECE)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Every document of the table, in windows of 1,024 tokens: one row for each piece."""
    import public_tokenizers

    from texspark.llm.common import table

    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json"))))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
