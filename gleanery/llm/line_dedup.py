"""Line dedup: documents probe sharded minimal perfect hash arrays instead of joining lines.

1. Documents get the number of a chunk of about CHUNK text bytes and are stored so, once, in the shared folder; both later
   passes read that table, so any DataFrame may come in, in whatever order its rows arrive.
2. A chunk sends each shard of the hash space its distinct line hashes once, with the number of its documents that hold
   the line and their largest id. A line that millions of documents share is one entry for each chunk.
3. A shard adds these up, builds a minimal perfect hash over the distinct hashes of lines that are common enough
   (a line without an entry has too few documents, whatever its count), and fills arrays of fingerprints, counts and
   keepers in its order. Each chunk's hashes then probe the arrays, and hits go back to the chunk.
4. Each chunk's documents meet its hits and lose the lines.

A chunk can send to FANOUT places with messages of a useful size. If the input needs more shards, a place is a region of
shards: messages of many chunks meet there, are added up and go on to the shards, and replies come back the same way.

Lines are 128-bit hashes: 64 bits place a line, the other 64 are its fingerprint, so that a probe of a line without an
entry is not taken for a hit (32 bits would fail at trillions of lines). The minimal perfect hash is the level
construction of Limasset et al. (2017), over both halves: keys that collide on one level go to the next; a key's index is
its bit's rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch, input_bytes, missing, parts_for

SPACES = b" \t\n\x0b\x0c\r"
#: Text bytes in a chunk, stored bytes for a shard, places that a chunk sends to at most.
CHUNK, SHARD_BYTES, FANOUT = 4 << 20, 32 << 20, 1024
#: Lines in a message from a group of chunks to a shard at about, and bytes of a line at about.
MESSAGE, LINE_BYTES = 64, 400
NO_ID = np.iinfo(np.int64).min


def _mix(h: np.ndarray, mark: np.ndarray, level: int) -> np.ndarray:
    x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= (x >> np.uint64(31)) ^ mark
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys (place, mark): at() gives each key its own index below their number."""

    def __init__(self, place: np.ndarray, mark: np.ndarray, load: float = 2.0, levels: int = 48):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        used = 0
        while len(place) and len(self.levels) < levels:
            m = max(64, int(len(place) * load))
            at = (_mix(place, mark, len(self.levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words = np.packbits(np.pad(alone, (0, -m % 64)), bitorder="little").view(np.uint64)
            ranks = used + np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]
            self.levels.append((m, words, ranks))
            used = int(ranks[-1])
            again = ~alone[at]
            place, mark = place[again], mark[again]
        self.rest = {key: used + i for i, key in enumerate(zip(place.tolist(), mark.tolist(), strict=True))}  # empty but for adversarial keys
        self.n = used + len(place)

    def at(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Indexes, -1 for keys that certainly were not given; other strange keys get some index."""
        out = np.full(len(place), -1, np.int64)
        open_ = np.arange(len(place))
        for level, (m, words, ranks) in enumerate(self.levels):
            if not len(open_):
                return out
            at = _mix(place[open_], mark[open_], level) % np.uint64(m)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        if self.rest:
            for i in open_.tolist():
                out[i] = self.rest.get((int(place[i]), int(mark[i])), -1)
        return out


class LineArrays:
    """Arrays of one shard: fingerprint, number of documents (as many as 32 bits hold), and the largest id, at each line's index."""

    def __init__(self, place: np.ndarray, mark: np.ndarray, count: np.ndarray, keeper: np.ndarray):
        self.hash = PerfectHash(place, mark)
        at = self.hash.at(place, mark)
        self.mark, self.count, self.keeper = np.empty(len(place), np.uint64), np.empty(len(place), np.uint32), np.empty(len(place), np.int64)
        self.mark[at], self.count[at], self.keeper[at] = mark, np.minimum(count, 0xFFFFFFFF), keeper

    def probe(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Index of each line, -1 where it has no entry."""
        at = self.hash.at(place, mark)
        if not len(self.mark):
            return at
        return np.where((at >= 0) & (self.mark[np.maximum(at, 0)] == mark), at, -1)


@dataclass(frozen=True)
class _Plan:
    shards: int
    regions: int  # 0: chunks send to the shards themselves
    groups: int
    min_chars: int
    min_docs: int

    @property
    def places(self) -> int:
        """What a chunk sends to."""
        return self.regions or self.shards


def _hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh3_128_intdigest(key)


def _keys(text: bytes | None, least: int) -> list[int | None]:
    """For each line the hash of its key, None for keys under `least` code points."""
    out: list[int | None] = []
    for line in (text or b"").lower().split(b"\n"):
        key = line.strip(SPACES)
        long = len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)
        out.append(_hash(key) if long else None)
    return out


#: Messages of lines, from a sender (a chunk, or a group of chunks in a region) to a place; and what comes back.
_LINES = pa.schema([("to", pa.int64()), ("sender", pa.int64()), ("place", pa.binary()), ("mark", pa.binary()), ("count", pa.binary()), ("keeper", pa.binary())])
_HITS = pa.schema([("sender", pa.int64()), ("place", pa.binary()), ("mark", pa.binary()), ("keeper", pa.binary())])
_LINES_DDL = "to long, sender long, place binary, mark binary, count binary, keeper binary"
_HITS_DDL = "sender long, place binary, mark binary, keeper binary"
_KINDS = (("place", np.uint64), ("mark", np.uint64), ("count", np.int64), ("keeper", np.int64))
M64 = (1 << 64) - 1


def _number(size: int):
    """Rows with a chunk number; a chunk ends once its texts have reached `size` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64  # each row counts, so that empty ones fill a chunk too
            chunks, at = np.empty(batch.num_rows, np.int64), 0
            while at < batch.num_rows:
                upto = np.cumsum(sizes[at:]) + held
                n = min(int(np.searchsorted(upto, size)) + 1, batch.num_rows - at)
                chunks[at : at + n] = chunk
                held = int(upto[n - 1])
                if held >= size:
                    chunk, held = chunk + 1, 0
                at += n
            yield pa.record_batch([pa.array(chunks), *batch.columns], ["chunk", "doc_id", "text", "rest"])

    return run


def _messages(to: np.ndarray, sender: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each place that entries go to."""
    order = np.argsort(to, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []
    cols = [[c[p].tobytes() for p in parts] for c in columns]
    return pa.record_batch([pa.array([int(to[p[0]]) for p in parts], pa.int64()), pa.array([sender] * len(parts), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], schema=_LINES)


def _send(plan: _Plan):
    def flush(chunk: int, lines: dict[int, list[int]]) -> pa.RecordBatch:
        place = np.fromiter((k & M64 for k in lines), np.uint64, len(lines))
        mark = np.fromiter((k >> 64 for k in lines), np.uint64, len(lines))
        count = np.fromiter((v[0] for v in lines.values()), np.int64, len(lines))
        keeper = np.fromiter((v[1] for v in lines.values()), np.int64, len(lines))
        return _messages((place % np.uint64(plan.places)).astype(np.int64), chunk, [place, mark, count, keeper])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines = None, {}
        for batch in batches:
            for chunk, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                if chunk.as_py() != now:
                    if lines:
                        yield flush(now, lines)
                    now, lines = chunk.as_py(), {}
                me = NO_ID if doc_id.as_py() is None else doc_id.as_py()
                for key in {*_keys(text.as_py(), plan.min_chars)} - {None}:
                    if have := lines.get(key):
                        have[0] += 1
                        have[1] = max(have[1], me)
                    else:
                        lines[key] = [1, me]
        if lines:
            yield flush(now, lines)

    return run


def _read(table: pa.Table, names: tuple[str, ...]) -> list[list[np.ndarray]]:
    kinds = dict(_KINDS)
    return [[np.frombuffer(x.as_buffer(), kinds[name]) for x in table[name]] for name in names]


def _added(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Entries of distinct lines, their counts added and the largest keeper kept."""
    place, mark, count, keeper = columns
    order = np.lexsort((mark, place))
    p, m = place[order], mark[order]
    starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (m[1:] != m[:-1])]) if len(p) else np.empty(0, np.int64)
    if not len(starts):
        return columns
    return [p[starts], m[starts], np.add.reduceat(count[order], starts), np.maximum.reduceat(keeper[order], starts)]


def _gather(plan: _Plan):
    """One group of chunks in one region: their entries added up go on to the region's shards."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns = _added([np.concatenate(c) for c in _read(table, ("place", "mark", "count", "keeper"))])
        region, group = (k.as_py() for k in key)
        place = columns[0]
        each = plan.shards // plan.regions
        to = region * each + (place // np.uint64(plan.regions) % np.uint64(each)).astype(np.int64)
        return pa.Table.from_batches([_messages(to, group * plan.regions + region, columns)])

    return run


def _hits(sender: int, place: np.ndarray, mark: np.ndarray, at: np.ndarray, keeper: np.ndarray, out: list[list]) -> None:
    hit = at >= 0
    if hit.any():
        for col, x in zip(out, (sender, place[hit].tobytes(), mark[hit].tobytes(), keeper[at[hit]].tobytes()), strict=True):
            col.append(x)


def _serve(plan: _Plan):
    """One shard: add up, index what is common, answer each sender."""

    def run(table: pa.Table) -> pa.Table:
        cols = _read(table, ("place", "mark", "count", "keeper"))
        p, m, docs, largest = _added([np.concatenate(c) for c in cols])
        common = docs >= plan.min_docs
        arrays = LineArrays(p[common], m[common], docs[common], largest[common])
        out: list[list] = [[], [], [], []]
        for sender, a, b in zip(table["sender"].to_pylist(), cols[0], cols[1], strict=True):
            _hits(sender, a, b, arrays.probe(a, b), arrays.keeper, out)
        return pa.table([pa.array(c, t) for c, t in zip(out, _HITS.types, strict=True)], schema=_HITS)

    return run


def _return(lines: pa.Table, hits: pa.Table) -> pa.Table:
    """One group of chunks in one region: the shards' hits go back to the chunks that hold the lines."""
    out: list[list] = [[], [], [], []]
    if len(hits) and len(lines):
        p, m, k = (np.concatenate(c) for c in _read(hits, ("place", "mark", "keeper")))
        arrays = LineArrays(p, m, np.ones(len(p), np.int64), k)
        for sender, a, b in zip(lines["sender"].to_pylist(), *_read(lines, ("place", "mark")), strict=True):
            _hits(sender, a, b, arrays.probe(a, b), arrays.keeper, out)
    return pa.table([pa.array(c, t) for c, t in zip(out, _HITS.types, strict=True)], schema=_HITS)


def _strip(plan: _Plan):
    """One chunk: its documents without the lines whose keeper is another."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        keepers: dict[int, int] = {}
        for row in zip(*_read(hits, ("place", "mark", "keeper")), strict=True):
            a, b, k = (x.tolist() for x in row)
            keepers.update(zip(((y << 64) | x for x, y in zip(a, b, strict=True)), k, strict=True))
        texts, lines, dropped = [], [], []
        for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"], strict=True):
            raw, me = text.as_py(), NO_ID if doc_id is None else doc_id
            keys = _keys(raw, plan.min_chars)
            keep = [key is None or keepers.get(key, me) == me for key in keys]
            if raw is not None and not all(keep):
                raw = b"\n".join(x for x, k in zip(raw.split(b"\n"), keep, strict=True) if k)
            texts.append(raw)
            lines.append(len(keys))
            dropped.append(len(keys) - sum(keep))
        kept = pa.array(texts, pa.binary())
        return pa.table({"doc_id": docs["doc_id"], "text": kept, "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "rest": docs["rest"]})

    return run


def _exchange(sent: DataFrame, plan: _Plan) -> DataFrame:
    """(sender, place, mark, keeper): to each chunk the lines of it that are common."""
    if not plan.regions:
        return sent.groupBy("to").applyInArrow(_serve(plan), _HITS_DDL)
    sent = sent.withColumn("group", F.pmod(F.xxhash64("sender"), F.lit(plan.groups)))
    onward = sent.groupBy("to", "group").applyInArrow(_gather(plan), _LINES_DDL)
    back = onward.groupBy("to").applyInArrow(_serve(plan), _HITS_DDL)
    asked = sent.withColumn("at", F.col("group") * plan.regions + F.col("to"))
    return asked.groupBy("at").cogroup(back.groupBy("sender")).applyInArrow(_return, _HITS_DDL)


def _dedup(docs: DataFrame, rest: list[str], min_chars: int, min_docs: int, chunk: int = CHUNK, fanout: int = FANOUT) -> DataFrame:
    kept = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), kept.alias("rest"))
    of = rows.schema["rest"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(rows.mapInArrow(_number(chunk), f"chunk long, doc_id long, text binary, rest {of}"), "numbered")
    shards = parts_for(rows, SHARD_BYTES)
    regions = fanout if shards > fanout else 0
    shards = -(-shards // regions) * regions if regions else shards
    plan = _Plan(shards, regions, input_bytes(rows) // (shards * MESSAGE * LINE_BYTES) + 1, min_chars, min_docs)
    hits = _exchange(rows.select("chunk", "doc_id", "text").mapInArrow(_send(plan), _LINES_DDL), plan)
    out = rows.groupBy("chunk").cogroup(hits.groupBy("sender")).applyInArrow(_strip(plan), f"doc_id long, text binary, n_lines long, n_dropped long, rest {of}")
    return out.withColumn("text", F.col("text").cast("string"))


def line_counts(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, text (what stays, null if it was null), n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Keys of min_chars code points
    or more in min_docs documents or more lose their lines but for those in the largest doc_id that holds the key.
    Every row counts as a document; rows that repeat the largest id all keep the line; a null id is less than any
    other. A null or empty text is one empty line. No rows give no rows; other columns are ignored.
    """
    missing(docs, ("doc_id", "text"))
    return _dedup(docs, [], min_chars, min_docs).drop("rest")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs, all its columns, with the repeated lines taken out of text."""
    missing(docs, ("doc_id", "text"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = _dedup(docs, others, min_chars, min_docs)
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
