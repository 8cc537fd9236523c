"""N-gram Jaccard join of documents through a token-group matrix.

The join runs in five steps, each a Spark job over all documents:

1. Every text becomes a set of shingles (64-bit hashes). Equal sets form a class; one document stands
   for each class from here on.
2. Shingles get one global order, rare before common, from counters of bounded size. A pair that
   reaches the threshold shares a shingle among the first |set| - ceil(t |set|) + 1 of both sets.
3. Sets are partitioned into groups of similar ones: a set joins the smallest set that it shares a
   leading shingle with. The token-group matrix names, for every leading shingle, the groups that have
   it, and holds each group's union of all its members' shingles as a bitmap.
4. Leading shingles of each set are looked up in the matrix, which names the groups that it may have
   a link in. The union then bounds the overlap of the set with any member; where that is too small
   the group stays closed to the set. In groups of moderate size, bitmaps of the members bound it again.
5. Qualifying groups are opened: their members, and the sets that ask, meet in one task and are
   compared exactly. Links within a group are found by breadth-first search, so a large group of near
   copies costs one link for each copy and not all pairs.

Connected components of the links follow by min-label propagation on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, checkpointed, table

SHINGLE = 4
#: 100 * intersection >= THRESHOLD * union
THRESHOLD = 85
#: Counters for the global order: 2**COUNTER_BITS of 4 bytes, whatever the input's size.
COUNTER_BITS = 20
_CHUNK = 1 << 14
#: Members of a group that meet in one task; larger groups are split. Sets that ask a group likewise.
GROUP_ROWS = 4096
#: Members of a group whose bitmaps are held against each other, after the union; in larger groups the
#: union alone decides which sets may ask.
PAIRED_MEMBERS = 2048
#: Key lists up to so many rows are broadcast (16 bytes each); longer ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_memo: dict[str, Memo] = {}


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of hashes of `size` words in a row, sorted; of fewer words, one hash of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    memo = _memo.setdefault("words", Memo(_word_hash, 100_000))
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    short = n < size
    width = n if short else size
    out = np.full(n - width + 1, 0x9E3779B97F4A7C15 + (n if short else 0), np.uint64)
    for k in range(width):
        out = (out ^ h[k : n - width + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def needed(n: np.ndarray | int, threshold: int = THRESHOLD):
    """Least intersection of a set of n with any set that it is linked to."""
    return -(-threshold * n // 100)


def linked(common, n, m, threshold: int = THRESHOLD):
    return 100 * common >= threshold * (n + m - common)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the set) and a 128-bit digest of the set as two longs."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1])], ["doc_id", "n", "d1", "d2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def _counters(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """How many sets hold a shingle of each counter, over all documents; 4 * 2**COUNTER_BITS bytes."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in source:
            found = [shingles(t, size) for t in batch.column(0).to_pylist()]
            if found:
                sums += np.bincount((np.concatenate(found) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(sums))
        if sums.any():
            parts = [sums[k : k + _CHUNK].astype(np.uint32).tobytes() for k in range(0, len(sums), _CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def add(key: tuple, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CHUNK, np.uint32)
        for batch in source:
            for x in batch.column(1).to_pylist():
                total += np.frombuffer(x, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    sums = np.zeros(1 << COUNTER_BITS, np.uint32)
    for r in parts:
        sums[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], np.uint32)
    return sums


def _leading(found: np.ndarray, counters: np.ndarray, threshold: int) -> np.ndarray:
    """The first shingles in the global order, as many as the threshold asks for."""
    take = len(found) - needed(len(found), threshold) + 1
    order = np.lexsort((found, counters[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))
    return found[order[:take]]


def _leading_rows(docs: DataFrame, standing: DataFrame, counters: np.ndarray, id_col: str, text_col: str, size: int, threshold: int) -> DataFrame:
    """(shingle, id, n) of the leading shingles of each class's document."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def lead(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            rows = [_leading(s, shared.value, threshold).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "leading"])

    def spread(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                counts = [len(x) for x in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.repeat(part.column(0).to_numpy(), counts)), pa.array(np.repeat(part.column(2).to_numpy(), counts))], ["shingle", "id", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    leading = rows.mapInArrow(lead, "id long, leading binary").filter("leading is not null")
    return leading.join(standing.select("id", "n"), "id").select("id", "leading", "n").mapInArrow(spread, "shingle long, id long, n long")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and its length."""
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(values)])


def _by_shingle(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of batches of rows sorted by shingle, cut so that no run is divided."""
    held: list[np.ndarray] | None = None
    for batch in source:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if last:
            yield tuple(x[:last] for x in now)
        held = [x[last:] for x in now]
    if held is not None and len(held[0]):
        yield tuple(held)


def _grouped(leading: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of leading shingles that several sets share, with the smallest of those sets as leader;
    and the group of each such set, its smallest leader."""

    def share(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, ids, n in _by_shingle(source):
            start, length = _runs(shingle)
            keep = np.repeat(length > 1, length)
            if keep.any():
                leader = np.repeat(np.minimum.reduceat(ids, start), length)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (shingle, ids, n, leader)], ["shingle", "id", "n", "leader"])

    rows = leading.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(share, "shingle long, id long, n long, leader long")
    rows = checkpointed(rows)
    return rows, rows.groupBy("id").agg(F.min("leader").alias("grp"), F.first("n").alias("n"))


def _asked(rows: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """(id, grp): sets and the other groups that they share a leading shingle with, where sizes allow a link."""

    def probe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, ids, n, group in _by_shingle(source):
            start, length = _runs(shingle)
            out = []
            for s, m in zip(start, length, strict=True):
                part = group[s : s + m]
                there = np.unique(part)
                if len(there) > 1:
                    # One direction is enough: a set asks the groups that come before its own.
                    for k, g in enumerate(there[:-1]):
                        later = s + np.flatnonzero(part > g)
                        out.append((ids[later], n[later], np.full(len(later), g)))
            for k in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out[k : k + 1000], strict=True)], ["id", "n", "grp"])

    mixed = rows.select("shingle", "id", "n").join(groups.select("id", "grp"), "id").select("shingle", "id", "n", "grp")
    probed = mixed.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(probe, "id long, n long, grp long")
    pairs = probed.groupBy("id", "grp").agg(F.first("n").alias("n"))
    sizes = groups.groupBy("grp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    able = (F.col("most") * 100 >= F.col("n") * threshold) & (F.col("least") * threshold <= F.col("n") * 100)
    return pairs.join(sizes, "grp").filter(able).select("id", "grp")


def _open(task: pa.Table, size: int, threshold: int) -> list[tuple[int, int]]:
    """Links of one group: among its members, and between the sets that ask and its members."""
    role = task.column("asks").to_numpy(zero_copy_only=False)
    ids = task.column("id").to_numpy()
    sets = [shingles(t, size) for t in task.column("text").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    members, askers = np.flatnonzero(~role), np.flatnonzero(role)
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    bounds = np.r_[0, np.cumsum(sizes)]
    own = [flat[bounds[k] : bounds[k + 1]] for k in range(len(sets))]
    # The matrix of this group: rows of members by token, so that one pass gives all overlaps.
    listed = np.concatenate([own[m] for m in members]) if len(members) else np.zeros(0, np.int64)
    holder = np.repeat(np.arange(len(members)), sizes[members])
    order = np.argsort(listed, kind="stable")
    listed, holder = listed[order], holder[order]
    first = np.searchsorted(listed, np.arange(len(tokens) + 1))
    count = first[1:] - first[:-1]

    def near(k: int, among: np.ndarray) -> np.ndarray:
        """Members (places) that set k is linked to."""
        mine = own[k]
        if count[mine].astype(bool).sum() < needed(int(sizes[k]), threshold):
            return np.zeros(0, np.int64)  # the union of the group bounds the overlap with any member
        at = np.concatenate([holder[first[t] : first[t + 1]] for t in mine]) if len(mine) else np.zeros(0, np.int64)
        common = np.bincount(at, minlength=len(members))
        return np.flatnonzero(among & (common > 0) & linked(common, sizes[k], sizes[members], threshold))

    links: list[tuple[int, int]] = []
    component = np.full(len(members), -1)
    left = np.ones(len(members), bool)
    for seed in range(len(members)):
        if not left[seed]:
            continue
        left[seed], component[seed] = False, seed
        queue = [seed]
        while queue and left.any():
            k = queue.pop()
            for m in near(members[k], left):
                links.append((int(ids[members[k]]), int(ids[members[m]])))
                left[m], component[m] = False, seed
                queue.append(m)
        for k in queue:
            component[k] = seed
    every = np.ones(len(members), bool)
    for k in askers:
        found = near(k, every)
        if len(found):  # one link to each component says all
            found = found[np.unique(component[found], return_index=True)[1]]
        links += [(int(ids[k]), int(ids[members[m]])) for m in found]
    return links


def _bits(found: np.ndarray) -> bytes:
    """A bitmap of a set: four bits and more for each shingle, a power of two of them."""
    size = 1 << max(6, int(4 * len(found) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[(found & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


class _Row:
    """One row of the token-group matrix, of a set: its bitmap as an integer."""

    __slots__ = ("bits", "id", "n", "size")

    def __init__(self, id_: int, n: int, bits: bytes):
        self.id, self.n, self.size, self.bits = id_, n, 8 * len(bits), int.from_bytes(bits, "little")

    def folded(self, size: int) -> int:
        return self.fold(self.bits, self.size, size)

    @staticmethod
    def fold(bits: int, now: int, size: int) -> int:
        while now > size:
            now //= 2
            bits = (bits | (bits >> now)) & ((1 << now) - 1)
        return bits

    def may_link(self, other: _Row, threshold: int) -> bool:
        """Whether the bitmaps leave room for the overlap that a link needs: a bit that only one has
        stands for one shingle at least that the other lacks."""
        least = -(-threshold * (self.n + other.n) // (100 + threshold))
        if min(self.n, other.n) < least:
            return False
        size = min(self.size, other.size)
        a, b = self.folded(size), other.folded(size)
        return self.n - (a & ~b).bit_count() >= least and other.n - (b & ~a).bit_count() >= least


class _Union:
    """The union of a group's members: bitmaps of each size that they have (sizes of sets that may link
    differ by little, so there are few)."""

    def __init__(self):
        self.of: dict[int, int] = {}

    def add(self, row: _Row) -> None:
        self.of[row.size] = self.of.get(row.size, 0) | row.bits

    def parts(self) -> list[bytes]:
        return [bits.to_bytes(size // 8, "little") for size, bits in self.of.items()]

    def may_link(self, row: _Row, threshold: int) -> bool:
        """Whether the overlap of the set with the union can reach what any link of it needs."""
        for size, bits in self.of.items():
            both = min(size, row.size)
            union = bits if size == both else _Row.fold(bits, size, both)
            if row.n - (row.folded(both) & ~union).bit_count() >= needed(row.n, threshold):
                return True
        return False


def _unite(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, bits) in order of grp as one row for each group and size of bitmap."""
    group, union, out = None, _Union(), []

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["grp", "bits"])
        out.clear()
        return batch

    for batch in source:
        for g, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group:
                out.extend((group, x) for x in union.parts())
                group, union = g, _Union()
            union.add(_Row(0, 0, b))
        if len(out) > 1000:
            yield rows()
    out.extend((group, x) for x in union.parts())
    if out:
        yield rows()


def _qualified(docs: DataFrame, groups: DataFrame, asked: DataFrame, id_col: str, text_col: str, size: int, threshold: int) -> DataFrame:
    """(grp, id, asks): the members and asking sets of groups that must be opened.

    The sets that ask a group are dealt into shares. In groups of up to PAIRED_MEMBERS all members are in
    each share: a set that asks stays if the union of the members leaves room for a link and some member
    does; members stay if some other set of a share may link with them. Members of larger groups all
    stay; their union, found in parts and then from the parts, stands for them in each share."""

    def bits(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_bits(x) for x in sets], pa.binary())], ["id", "n", "bits"])

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, kept, out, union = None, [], set(), [], _Union()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["grp", "id", "asks"])
            out.clear()
            return batch

        def close() -> None:
            out.extend((group[0], m.id, False) for m in members if m.id in kept)

        for batch in source:
            for g, share, asks, id_, n, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, share) != group:
                    close()
                    group, members, kept, union = (g, share), [], set(), _Union()
                row = _Row(id_, n, b)
                if asks and not union.may_link(row, threshold):
                    continue
                if not asks:
                    union.add(row)
                if id_ is None:  # a union, which stands for its members
                    continue
                near = None
                for m in members:
                    # Once a partner is known, only members that have none yet are worth a look.
                    if (near is None or m.id not in kept) and row.may_link(m, threshold):
                        near = m
                        kept.add(m.id)
                if asks:
                    if near is not None or not members:
                        out.append((g, id_, True))
                else:
                    members.append(row)
                    if near is not None:
                        kept.add(id_)
            if len(out) > 10_000:
                yield rows()
        close()
        if out:
            yield rows()

    calls = asked.groupBy("grp").agg(F.count("*").alias("calls"))
    plan = groups.groupBy("grp").agg(F.count("*").alias("members")).join(calls, "grp", "left").filter("members > 1 or calls > 0")
    split = lambda n: F.ceil(F.col(n) / GROUP_ROWS).cast("int")
    plan = checkpointed(plan.select("grp", (F.col("members") > PAIRED_MEMBERS).alias("large"), split("members").alias("parts"), F.greatest(split("calls"), F.lit(1)).alias("shares")))
    member = groups.select("id", "grp").join(plan, "grp").select("grp", "id", "parts", "shares", "large", F.lit(False).alias("asks"))
    caller = asked.select("id", "grp").join(plan, "grp").select("grp", "id", "parts", "shares", "large", F.lit(True).alias("asks"))
    seats = checkpointed(member.unionByName(caller))
    wanted = seats.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    if (few := _bounded(wanted)) is not wanted:
        texts = texts.join(few, "id", "left_semi")
    mapped = texts.mapInArrow(bits, "id long, n long, bits binary").dropDuplicates(["id"])
    placed = seats.join(mapped, "id")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = F.sequence(F.lit(0), F.col("shares") - 1)
    stay, large = None, not plan.filter("large").isEmpty()
    placed = checkpointed(placed) if large else placed
    met = placed.filter("asks or not large").select("grp", F.explode(F.when(F.col("asks"), F.array(deal("shares"))).otherwise(every)).alias("share"), "asks", "id", "n", "bits")
    if large:
        hot = placed.filter("large and not asks").select("grp", "bits", deal("parts").alias("part"))
        some = hot.repartition("grp", "part").sortWithinPartitions("grp").select("grp", "bits").mapInArrow(_unite, "grp long, bits binary")
        union = some.repartition("grp").sortWithinPartitions("grp").mapInArrow(_unite, "grp long, bits binary")
        union = union.join(plan.select("grp", "shares"), "grp").select("grp", F.explode(every).alias("share"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), "bits")
        met = met.unionByName(union)
        stay = seats.filter("large and not asks").select("grp", "id", "asks")
    judged = met.repartition("grp", "share").sortWithinPartitions("grp", "share", "asks", "id").mapInArrow(judge, "grp long, id long, asks boolean").distinct()
    return judged if stay is None else judged.unionByName(stay)


def _placed(seats: DataFrame) -> DataFrame:
    """(grp, id, part, share, asks): who meets in which task, about GROUP_ROWS members and GROUP_ROWS
    asking sets at most in each."""
    plan = seats.groupBy("grp").agg(F.sum((~F.col("asks")).cast("long")).alias("members"), F.sum(F.col("asks").cast("long")).alias("calls"))
    plan = plan.filter("members > 1 or calls > 0").select("grp", F.ceil(F.col("members") / GROUP_ROWS).cast("int").alias("parts"), F.ceil(F.col("calls") / GROUP_ROWS).cast("int").alias("shares"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    split = seats.filter("not asks").join(plan, "grp").withColumn("part", deal(F.col("parts")))
    # Members meet among themselves in each share of the sets that ask. In a group that was split,
    # each member also asks the parts before its own; each later part is a share of its own there.
    own = F.greatest(F.col("shares"), F.lit(1))
    inner = split.filter("part > 0").select("grp", "id", F.col("part").alias("mine"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("part"))
    inner = inner.select("grp", "id", "part", (F.col("own") + F.col("mine") - F.col("part") - 1).alias("share"), F.lit(True).alias("asks"))
    member = split.select("grp", "id", "part", F.explode(F.sequence(F.lit(0), own + F.greatest(F.col("parts") - 2 - F.col("part"), F.lit(-1)))).alias("share"), F.lit(False).alias("asks"))
    outer = seats.filter("asks").join(plan, "grp").select("grp", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), deal(F.col("shares")).alias("share"), F.lit(True).alias("asks"))
    return member.unionByName(inner).unionByName(outer)


def _links(docs: DataFrame, seats: DataFrame, id_col: str, text_col: str, size: int, threshold: int) -> DataFrame:
    """(a, b): links between different sets, enough to connect all that are linked."""
    placed = checkpointed(_placed(seats))
    wanted = placed.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    if (few := _bounded(wanted)) is not wanted:
        texts = texts.join(few, "id", "left_semi")
    met = texts.dropDuplicates(["id"]).join(placed, "id").select("grp", "part", "share", "asks", "id", "text")

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        links = _open(group, size, threshold)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return met.groupBy("grp", "part", "share").applyInArrow(meet, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach, for each id in a link.

    Alternates large-star and small-star steps until no edge changes; each step is two shuffles of
    the edges, written to a checkpoint.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        edges = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        small = edges.join(low, "a")
        edges = checkpointed(small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        state = now


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Link documents whose sets of word shingles have 100 * |A and B| >= threshold * |A or B|.

    Returns one row per input row: doc_id, n_shingles, class_id (smallest doc_id with the same set)
    and component_id (smallest doc_id that links reach, itself included). Words are lower-cased (A to
    Z) and cut at ASCII white space; a text with fewer than `size` words is one shingle. Null, empty
    and wordless texts have no shingles, are linked with nothing and stand alone. A null key is
    classed by its set and keeps null ids if no key of its class is known. Rows that repeat a key are
    documents of their own: with equal sets they are one class, with others each has its own links.
    Other columns are ignored; an empty table gives no rows.
    """
    sets = checkpointed(shingle_sets(docs, id_col, text_col, size))
    clash = sets.filter("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("d1", "d2", "n").alias("sets")).filter("sets > 1").select("doc_id")
    if clash.isEmpty():
        return _components_of(docs, sets, id_col, text_col, size, threshold)
    # Keys with several texts: such rows go by a key made of both, and their results back by key.
    clash = checkpointed(clash.select(F.col("doc_id").alias("__clash")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(_bounded(clash), F.col("doc_id") == F.col("__clash"), "left")
    own = F.when(F.col("__clash").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    keyed = checkpointed(marked.select(own.alias("own"), "doc_id", "text"))
    found = checkpointed(_components_of(keyed, checkpointed(shingle_sets(keyed, "own", "text", size)), "own", "text", size, threshold))
    named = keyed.filter("own is not null").groupBy("own").agg(F.min("doc_id").alias("key"))
    linked_keys = found.filter("doc_id is not null").select("doc_id", "class_id", "component_id").distinct().join(named, F.col("doc_id") == F.col("own"))
    of_class = linked_keys.groupBy("class_id").agg(F.min("key").alias("class_key"))
    of_component = linked_keys.groupBy("component_id").agg(F.min("key").alias("component_key"))
    out = found.join(named, F.col("doc_id") == F.col("own"), "left").join(of_class, "class_id", "left").join(of_component, "component_id", "left")
    return out.select(F.col("key").alias("doc_id"), "n_shingles", F.col("class_key").alias("class_id"), F.col("component_key").alias("component_id"))


def _components_of(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, size: int, threshold: int) -> DataFrame:
    """jaccard_components for keys that have one set each."""
    standing = checkpointed(sets.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id")).filter("id is not null"))
    leading = _leading_rows(docs, standing, _counters(docs, text_col, size), id_col, text_col, size, threshold)
    rows, groups = _grouped(leading)
    groups = checkpointed(groups)
    asked = checkpointed(_asked(rows, groups, threshold))
    seats = checkpointed(_qualified(docs, groups, asked, id_col, text_col, size, threshold))
    found = components(_links(docs, seats, id_col, text_col, size, threshold))
    classes = standing.join(found, "id", "left").select("d1", "d2", "n", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    return (
        sets.join(classes, ["d1", "d2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row, with all its columns, of each group of linked documents: that of the smallest key.

    Rows that stand alone stay, and so do rows without words or without a key. Of rows that repeat a
    key one stays."""
    found = checkpointed(jaccard_components(docs, id_col, text_col, size, threshold))
    spare = checkpointed(found.groupBy("doc_id").agg(F.max("component_id").alias("top")).filter("top < doc_id").select(F.col("doc_id").alias("__key")))
    key = F.col(id_col).cast("long")
    kept = docs.join(_bounded(spare), key == F.col("__key"), "left_anti")
    twice = checkpointed(found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("__key")).agg(F.count("*").alias("rows")).filter("__key is not null and rows > 1").select("__key"))
    if twice.isEmpty():
        return kept
    again = kept.join(_bounded(twice), key == F.col("__key"), "left_semi").dropDuplicates([id_col])
    return kept.join(_bounded(twice), key == F.col("__key"), "left_anti").unionByName(again)


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
