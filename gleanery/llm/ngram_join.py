"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its word shingles. Two sets of sizes a and b with Jaccard t or more share at least
ceil(t / (1 + t) * (a + b)) shingles, so with one global order each of them has a shared shingle among its first
n - ceil(t * n) + 1. The order is by exact document frequency, rarest first. Shingles that only one document has come
first and can match nothing, so most documents drop out before any join.

How it runs:

1. Documents are read once, in chunks. A chunk sorts its shingle hashes and sends each range of the hash space one
   packed message: each hash once, with the row that has it, or, if several rows do, with their number; which rows these
   are stays in a message of the chunk to itself. Copies inside a chunk send one set.
2. Each range counts in how many sets a hash occurs and sends back, per chunk, only the hashes of two or more.
3. Each chunk orders these by frequency: a document's prefix and its array for verification are known.
4. Equal sets form a class, and one document stands for it. Prefix entries are joined on the shingle.
5. A group of near copies would give all its pairs. To find components it needs far fewer: in each bucket two hubs of
   different components are compared with the rest, components are merged, and buckets within one component are done.
   What is left after the hub rounds is joined in full across components, so no link that joins two is missed. There the
   smaller set of a pair needs a shared shingle in its shorter, indexing prefix, and meets only classes of lengths that its
   position leaves open: templates that many documents share, but not enough for a link, meet nobody.
6. Each pair is verified once: length and positional filters on the prefix entry, a suffix filter that bounds
   the overlap by cell counts of the hash space, then the exact intersection.

Rows are numbered by chunk; an input that is more than a scan of stored files is therefore stored first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch, missing, parts_for, settled

#: Hashes have so many bits; they fit a signed long.
BITS = 56
CELLS = 64
PIECE, SPACE = 1 << 20, re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Shingles in a chunk at least and at most: about 50 bytes each while it is sorted.
CHUNK_LEAST, CHUNK_MOST = 750_000, 8_000_000
#: Input bytes for one range of the hash space.
RANGE_BYTES = 4 << 20


@cache
def factors(k: int) -> np.ndarray:
    """Odd factors, one for the length of a shingle and one for each of its k words."""
    return np.random.default_rng(20240607).integers(1, 1 << 63, k + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the lower-cased words in order; long texts are split in pieces that end between words."""
    import xxhash

    at, n, out = 0, len(text or b""), []
    while at < n:
        cut = SPACE.search(text, at + PIECE) if at + PIECE < n else None
        end = cut.start() if cut else n
        words = text[at:end].lower().split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer than k words make one shingle, no words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    m, by = min(k, len(w)), factors(k)
    h = np.full(len(w) - m + 1, m, np.uint64) * by[0]
    for i in range(m):
        h += w[i : i + len(h)] * by[i + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h >>= np.uint64(64 - BITS)
    h.sort()
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def _pack(*columns: np.ndarray) -> bytes:
    """Byte planes of unsigned columns of one length, without the planes that are all zero, compressed."""
    import zstandard

    head, planes = [len(columns[0])], []
    for c in columns:
        c = c.astype(np.uint64)
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        head.append(width)
        planes.append(c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return np.array(head, np.uint32).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, n_columns: int) -> list[np.ndarray]:
    import zstandard

    head = np.frombuffer(data, np.uint32, n_columns + 1)
    n, widths = int(head[0]), head[1:]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 * (n_columns + 1) :], max_output_size=max(1, n * int(widths.sum()))), np.uint8)
    out, at = [], 0
    for width in map(int, widths):
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(c.view(np.uint64).reshape(-1))
        at += n * width
    return out


def _own(rows: pa.RecordBatch, tokens: np.ndarray, local: np.ndarray) -> bytes:
    """A chunk's message to itself: its rows, and sorted hashes that several of them have, each with one of these."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_batch(rows)
    packed = _pack(np.diff(tokens, prepend=np.uint64(0)), local)
    return len(packed).to_bytes(8, "little") + packed + sink.getvalue().to_pybytes()


@dataclass(frozen=True)
class _Plan:
    k: int
    percent: int
    ranges: int
    chunk: int


_MESSAGE = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _send(plan: _Plan, task: Callable[[], int] = _task):
    """documents -> a message for each chunk and hash range, and one with the chunk's rows."""

    def flush(chunk: int, ids: list, sizes: list, digests: list, sets: list, owners: list) -> pa.RecordBatch:
        rows = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary())})
        parts, payloads = [-1 - chunk], []
        if sets:
            tokens = np.concatenate(sets)
            local = np.repeat(np.array(owners, np.uint32), [len(s) for s in sets])
            sets.clear()
            order = np.argsort(tokens)
            tokens, local = tokens[order], local[order]
            del order
            starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            count = np.diff(np.r_[starts, len(tokens)]).astype(np.uint32)
            several = np.repeat(count > 1, count)
            payloads.append(_own(rows, tokens[several], local[several]))
            del several
            # 0 stands for rows that the chunk keeps to itself
            tokens, local, count = tokens[starts], np.where(count > 1, 0, local[starts] + 1), count
            width = np.uint64((1 << BITS) // plan.ranges + 1)
            part = (tokens // width).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part)) + 1
            for t, who, k, p in zip(np.split(tokens, cuts), np.split(local, cuts), np.split(count, cuts), part[np.r_[0, cuts]], strict=True):
                parts.append(int(p))
                payloads.append(_pack(np.diff(t, prepend=np.uint64(int(p) * int(width))), who, k))
        else:
            payloads.append(_own(rows, np.empty(0, np.uint64), np.empty(0, np.uint32)))
        return pa.record_batch([pa.array(parts, pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array(payloads, pa.binary())], schema=_MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        first = task() << 16
        chunk, ids, sizes, digests, sets, owners, seen, held = 0, [], [], [], [], [], set(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_hashes(text.as_py(), plan.k)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                if len(h) and digest not in seen:
                    seen.add(digest)
                    sets.append(h)
                    owners.append(len(ids))
                    held += len(h)
                ids.append(doc_id)
                sizes.append(len(h))
                digests.append(digest)
                if held >= plan.chunk or len(ids) >= 1 << 20:
                    yield flush(first + chunk, ids, sizes, digests, sets, owners)
                    chunk, ids, sizes, digests, sets, owners, seen, held = chunk + 1, [], [], [], [], [], set(), 0
        if ids:
            yield flush(first + chunk, ids, sizes, digests, sets, owners)

    return run


_REPLY = pa.schema([("chunk", pa.int64()), ("rows", pa.bool_()), ("payload", pa.binary())])


def _count(plan: _Plan):
    """One hash range: the hashes that two or more sets have go back to their chunks with that number."""
    width = (1 << BITS) // plan.ranges + 1

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part < 0:
            return pa.table([table["chunk"], pa.array([True] * len(table)), table["payload"]], schema=_REPLY)
        tokens, local, counts, chunks = [], [], [], []
        for chunk, payload in zip(table["chunk"].to_pylist(), table["payload"], strict=True):
            d, who, k = _unpack(payload.as_py(), 3)
            tokens.append(np.cumsum(d, dtype=np.uint64) + np.uint64(part * width))
            local.append(who.astype(np.uint32))
            counts.append(k.astype(np.int64))
            chunks.append(np.full(len(d), chunk, np.int64))
        tokens, local, counts, chunks = (np.concatenate(x) for x in (tokens, local, counts, chunks))
        order = np.argsort(tokens)
        t = tokens[order]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        df = np.repeat(np.add.reduceat(counts[order], starts), np.diff(np.r_[starts, len(t)]))
        keep = df > 1
        t, df, order = t[keep], df[keep], order[keep]
        by = np.argsort(chunks[order], kind="stable")
        t, df, order = t[by], df[by], order[by]
        owner = chunks[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        out_chunk, out = [], []
        if len(t):
            for tt, dd, oo in zip(np.split(t, cuts), np.split(df, cuts), np.split(order, cuts), strict=True):
                out_chunk.append(int(chunks[oo[0]]))
                out.append(_pack(np.diff(tt, prepend=np.uint64(part * width)), local[oo], dd) + part.to_bytes(8, "little"))
        return pa.table([pa.array(out_chunk, pa.int64()), pa.array([False] * len(out), pa.bool_()), pa.array(out, pa.binary())], schema=_REPLY)

    return run


_RECORD = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("u", pa.int64()), ("toks", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32())), ("odd", pa.list_(pa.int64()))])


def _gather(plan: _Plan):
    """One chunk: for each row the shared hashes in rare-first order, if its prefix reaches any of them."""
    width = (1 << BITS) // plan.ranges + 1

    def run(table: pa.Table) -> pa.Table:
        chunk, rows = table["chunk"][0].as_py(), None
        tokens, local, dfs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for is_rows, payload in zip(table["rows"].to_pylist(), table["payload"], strict=True):
            data = payload.as_py()
            if is_rows:
                cut = 8 + int.from_bytes(data[:8], "little")
                rows = pa.ipc.open_stream(data[cut:]).read_all()
                own, own_rows = _unpack(data[8:cut], 2)
                own = np.cumsum(own, dtype=np.uint64)
                continue
            d, who, df = _unpack(data[:-8], 3)
            tokens.append(np.cumsum(d, dtype=np.uint64) + np.uint64(int.from_bytes(data[-8:], "little") * width))
            local.append(who.astype(np.int64))
            dfs.append(df.astype(np.int64))
        t, who, df = np.concatenate(tokens), np.concatenate(local), np.concatenate(dfs)
        several = who == 0
        first, upto = np.searchsorted(own, t[several]), np.searchsorted(own, t[several], "right")
        n_rows = upto - first
        spots = np.repeat(first - np.r_[0, np.cumsum(n_rows)[:-1]], n_rows) + np.arange(int(n_rows.sum())) if len(first) else np.empty(0, np.int64)
        t, df = np.r_[t[~several], np.repeat(t[several], n_rows)], np.r_[df[~several], np.repeat(df[several], n_rows)]
        who = np.r_[who[~several] - 1, own_rows[spots].astype(np.int64)]
        order = np.lexsort((t, df, who))
        t, who = t[order], who[order]
        n = rows["n"].to_numpy()
        at = np.searchsorted(who, np.arange(len(n) + 1))
        digest = np.frombuffer(b"".join(rows["digest"].to_pylist()), np.int64).reshape(-1, 2)
        alone = n - np.diff(at)
        prefix = n - (plan.percent * n + 99) // 100 + 1
        toks, cells, odd = [], [], []
        for i in range(len(n)):
            s = t[at[i] : at[i + 1]]
            if len(s) and alone[i] < prefix[i]:
                toks.append(s.astype(np.int64))
                count = np.bincount((s >> np.uint64(BITS - 8)).astype(np.int64), minlength=4 * CELLS)
                cells.append(count.reshape(CELLS, 4).sum(1).astype(np.int32))
                odd.append(np.packbits((count & 1).astype(np.uint8)).view(np.int64))
            else:
                toks.append(None)
                cells.append(None)
                odd.append(None)
        uid = (np.int64(chunk) << np.int64(20)) + np.arange(len(n), dtype=np.int64)
        return pa.table([pa.array(uid), rows["doc_id"], rows["n"], pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(alone), pa.array(toks, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int32())), pa.array(odd, pa.list_(pa.int64()))], schema=_RECORD)

    return run


def _least_overlap(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil((na + nb) * percent / F.lit(100 + percent))


class _Join:
    """The join on prefix entries between class representatives."""

    def __init__(self, scratch: Scratch, reps: DataFrame, percent: int):
        self.reps, self.percent = reps, percent
        prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
        shown = F.slice("toks", F.lit(1), (prefix - F.col("u")).cast("int"))
        bits = [F.get("odd", F.lit(i)).alias(f"o{i}") for i in range(4)]
        entries = reps.select("uid", "n", "u", *bits, F.posexplode(shown).alias("i", "token")).withColumn("pos", F.col("u") + F.col("i"))
        # the longest set that could still link, if this is the first shared shingle
        most = F.least(F.floor(((F.col("n") - F.col("pos")) * (100 + percent) - F.col("n") * percent) / percent), F.floor(F.col("n") * 100 / percent))
        entries = entries.withColumn("hi", most).select("token", "uid", "n", "u", self._size(F.col("n")).alias("size"), "pos", "hi", *(f"o{i}" for i in range(4)))
        self.entries = scratch.table(entries, "entries")

    def _size(self, n: Column) -> Column:
        """Class of lengths: those of one class are within the threshold of each other."""
        if self.percent == 100:
            return n.cast("int")
        return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / self.percent)) + 1e-9).cast("int")

    def _possible(self, n: Column, hi: Column, other_n: Column, other_hi: Column) -> Column:
        """Length and positional filters."""
        return (other_n <= hi) & (n <= other_hi)

    def _labelled(self, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return self.entries.withColumn("c", F.col("uid"))
        return self.entries.join(labels, "uid", "left").withColumn("c", F.coalesce("root", "uid")).drop("root")

    def hub_pairs(self, labels: DataFrame | None, tested: DataFrame | None) -> DataFrame:
        """For each set the hub of another component that it shares most prefix shingles with.

        A bucket has a hub for each class of lengths: the set that has the shingle earliest, which the positional filter
        lets meet the most others.
        """
        own = self._labelled(labels).select("token", "uid", "n", "pos", "hi", "size", "c")
        hubs = own.groupBy("token", "size").agg(F.min(F.struct("pos", "uid", "n", "hi", "c")).alias("h"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").drop("c0", "c1")
        met = own.join(hubs, ["token", "size"]).filter(F.col("c") != F.col("h.c"))
        met = met.filter(self._possible(F.col("n"), F.col("hi"), F.col("h.n"), F.col("h.hi")))
        pairs = met.select(F.least("uid", "h.uid").alias("a"), F.greatest("uid", "h.uid").alias("b"), "uid").groupBy("uid", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        best = pairs.groupBy("uid").agg(F.max(F.struct("shared", "a", "b")).alias("m"))
        return best.select("m.a", "m.b").distinct()

    def all_pairs(self, labels: DataFrame | None, tested: DataFrame | None) -> DataFrame:
        """Every candidate pair across components; in a bucket, rows of its largest component meet only others.

        Shingles that one side lacks are bounded from below by those that nobody shares and by parities in 256 cells.
        """
        own = self._labelled(labels)
        per = own.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
        top = per.groupBy("token").agg(F.max(F.struct("k", "c")).alias("m"), F.count(F.lit(1)).alias("cs")).filter("cs > 1").select("token", F.col("m.c").alias("main"))
        open_ = own.join(top, "token")
        names = ["uid", "n", "u", "hi", "c", *(f"o{i}" for i in range(4))]
        alone = (F.col("c") == F.col("main")).cast("int")
        # the smaller set of a pair: only its indexing prefix can hold the first shared shingle
        left = open_.filter("hi >= n").withColumn("at", F.explode(F.sequence("size", self._size(F.col("hi")))))
        left = left.select("token", "at", alone.alias("tag"), *(F.col(x).alias(f"x_{x}") for x in names))
        # rows of the main component meet those of the others: tag 1 has only these
        tags = F.when(F.col("c") == F.col("main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        right = open_.select(F.col("token").alias("t2"), F.col("size").alias("s2"), F.explode(tags).alias("tag2"), *names)
        same = (F.col("token") == F.col("t2")) & (F.col("at") == F.col("s2")) & (F.col("tag") == F.col("tag2"))
        fits = (F.col("c") != F.col("x_c")) & (F.struct("x_n", "x_uid") < F.struct("n", "uid"))
        differ = F.col("u") + F.col("x_u") + sum((F.bit_count(F.col(f"o{i}").bitwiseXOR(F.col(f"x_o{i}"))) for i in range(4)), F.lit(0))
        suffix = F.col("n") + F.col("x_n") - differ >= 2 * _least_overlap(F.col("n"), F.col("x_n"), self.percent)
        pairs = left.join(right, same & fits & self._possible(F.col("n"), F.col("hi"), F.col("x_n"), F.col("x_hi")) & suffix)
        pairs = pairs.select(F.least("uid", "x_uid").alias("a"), F.greatest("uid", "x_uid").alias("b")).distinct()
        return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, with their intersection: suffix filter, then the exact count."""
        a = self.reps.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"), F.col("cells").alias("ca"))
        b = self.reps.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"), F.col("cells").alias("cb"))
        both = pairs.join(a, "a").join(b, "b")
        most = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        least = _least_overlap(F.col("na"), F.col("nb"), self.percent)
        inter = F.when(most >= least, F.size(F.array_intersect("ta", "tb"))).otherwise(F.lit(0))
        return both.select("a", "b", "na", "nb", inter.cast("long").alias("inter")).filter(F.col("inter") * 100 >= (F.col("na") + F.col("nb") - F.col("inter")) * self.percent)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(uid, root): the smallest id of each edge's component, by alternating large-star and small-star steps."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())

    now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    was, step = state(now), 0
    while True:
        step += 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.table(small, f"{name}-{step}")
        is_now = state(nxt)
        scratch.drop(f"{name}-{step - 1}")
        if is_now == was:
            return nxt.select(F.col("u").alias("uid"), F.col("v").alias("root")).unionAll(nxt.select(F.col("v").alias("uid"), F.col("v").alias("root")).distinct())
        now, was = nxt, is_now


def _records(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    rows = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), scratch, "texts")
    ranges = 4 * parts_for(rows, 4 * RANGE_BYTES)
    chunk = min(CHUNK_MOST, max(CHUNK_LEAST, 64 * ranges))
    plan = _Plan(k, percent, min(ranges, chunk // 64), chunk)
    sent = rows.mapInArrow(_send(plan), "part long, chunk long, payload binary")
    back = sent.groupBy("part").applyInArrow(_count(plan), "chunk long, rows boolean, payload binary")
    out = back.groupBy("chunk").applyInArrow(_gather(plan), "uid long, doc_id long, n long, d0 long, d1 long, u long, toks array<long>, cells array<int>, odd array<long>")
    return scratch.table(out, "records")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, hub_rounds: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Two documents link if 100 * |A and B| >= percent * |A or B| over their distinct word shingles; component_id is the
    smallest doc_id that links reach. Words are lower-cased (A-Z) and end at ASCII white space. Null, empty and
    wordless texts have no shingles and are their own component; rows that repeat are documents of their own;
    null ids stay null and count only as ties between others; other columns are ignored; no rows give no rows.
    """
    missing(docs, ("doc_id", "text"))
    scratch = Scratch(docs.sparkSession)
    records = _records(docs, shingle, percent, scratch)
    classes = records.filter("n > 0").groupBy("d0", "d1").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"))
    classes = scratch.table(classes, "classes")
    join = _candidates(records, classes, percent, scratch)
    labels = tested = links = None
    if not join.entries.isEmpty():
        turn, last = 0, False
        while not last:
            last = turn >= hub_rounds
            pairs = scratch.table((join.all_pairs if last else join.hub_pairs)(labels, tested), f"pairs{turn}")
            new = scratch.table(join.verified(pairs).select("a", "b"), f"links{turn}")
            tested = pairs if tested is None else tested.unionAll(pairs)
            if new.isEmpty():
                turn = max(turn + 1, hub_rounds)  # hubs have nothing more to find: on to all pairs
                continue
            links = new if links is None else links.unionAll(new)
            labels = scratch.table(components(links, scratch, f"stars{turn}"), f"labels{turn}")
            turn += 1
    if labels is not None:
        named = classes.join(labels, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        least = named.groupBy("root").agg(F.min("least").alias("component"))
        named = named.join(least, "root").select("d0", "d1", "component")
    else:
        named = classes.select("d0", "d1", F.col("least").alias("component"))
    out = records.select("doc_id", "n", "d0", "d1").join(named, ["d0", "d1"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = scratch.table(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")), "result")
    scratch.keep("result")
    return out


def _candidates(records: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> _Join:
    reps = records.filter("toks is not null").join(classes.select("uid"), "uid", "left_semi").select("uid", "n", "u", "toks", "cells", "odd")
    return _Join(scratch, scratch.table(reps, "reps"), percent)


def similar_pairs(docs: DataFrame, shingle: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links between different sets of shingles: (a, b, similarity) between representatives, and (doc_id, representative).

    Rows of equal sets have one representative, the smallest doc_id among them; a set that only null ids have has null.
    Null, empty and wordless texts are in neither result; rows that repeat are members again; other columns are ignored;
    no rows give no rows. In a group of near copies all pairs are links: near_duplicates gives components without them.
    """
    missing(docs, ("doc_id", "text"))
    scratch = Scratch(docs.sparkSession)
    records = _records(docs, shingle, percent, scratch)
    classes = scratch.table(records.filter("n > 0").groupBy("d0", "d1").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least")), "classes")
    join = _candidates(records, classes, percent, scratch)
    found = join.verified(join.all_pairs(None, None))
    name = classes.select(F.col("uid"), F.col("least"))
    pairs = found.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("similarity"))
    members = records.filter("n > 0").join(classes, ["d0", "d1"]).select("doc_id", F.col("least").alias("representative"))
    return pairs, members


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id, and of these the smallest hash of id and text.

    Null ids come last. Texts without shingles are components of their own; rows that repeat id and text are one row.
    """
    missing(docs, ("doc_id", "text"))
    key = "_row"
    while key in docs.columns:
        key += "_"
    scratch = Scratch(docs.sparkSession)
    hashed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    keys = scratch.table(hashed.groupBy(F.col(key).alias("row")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("k")), "keys")
    found = near_duplicates(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), shingle, percent)
    named = keys.join(found.select(F.col("doc_id").alias("row"), "component_id").distinct(), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "k")).alias("m"))
    first = scratch.table(first.select(F.col("m.row").alias(key), F.col("m.k").alias("k")), "first")
    scratch.keep("first")
    once = hashed.join(first.filter("k = 1").select(key), key, "left_semi")
    again = hashed.join(first.filter("k > 1").select(key), key, "left_semi").dropDuplicates([key])
    return once.select(*docs.columns).unionAll(again.select(*docs.columns))
