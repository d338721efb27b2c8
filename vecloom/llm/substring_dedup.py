"""Substring dedup: words inside passages that a document with a smaller id has too, by FM-indexes of shards.

A window is WINDOW consecutive words. Streaming every document past the index of every shard would take
work in proportion to their product, so documents go only where a match can be. A window's key is the
smallest hash of its runs of RUN words: equal windows have equal keys. Of each key that documents with
different ids have, the smallest id is the key's first. Shards are of first documents: of these, a shard
indexes the words whose windows' keys they are first of. All other documents with such a key stream their
words of that key past the shard's index (fm_index: a wavelet tree over the BWT, matching statistics by
backward search), and intervals of windows whose statistic reaches WINDOW are reported. As the indexed
document has the smallest id of all with the key, every such match is with a smaller id.

Windows that the index does not have share a run with the first document and no more. They go on to another
round, in which the key is of the whole window; those whose key no other document has end there. So the
rounds end, and hashes only say where to look: what counts are words that the index compares.

A shard whose first document very many others share streams in several tasks, each with its own copy of
the shard's small index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard, with_row_key
from .fm_index import FMIndex
from .near_dedup import hits, marks, only, place_of

#: Words of a window, and of the runs whose smallest hash is a window's key in the first round.
WINDOW, RUN = 50, 20
#: Keys that go to one shard, or that one task streams: at most and at least; between them a share of all.
MOST_KEYS, LEAST_KEYS = 1 << 14, 1 << 11
#: Bytes of text, windows of a lane, lanes, and whole texts handled at a time.
BLOCK, LANE, LANES, TEXTS = 1 << 18, 206, 2048, 512
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS = np.power(np.uint64(0x9E3779B97F4A7C15), np.arange(4096, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (constants of the public splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and a hash of it."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.concatenate(([False], ~_SPACE[raw]))
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    place = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(raw)]))))
    return starts, mix(np.add.reduceat(np.where(_SPACE[raw], np.uint64(0), (raw + np.uint64(1)) * _POWERS[place & 4095]), starts))


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, by doubling."""
    out, have = None, 0
    part, length, factor = words, 1, np.uint64(0xD6E8FEB86659FD93)  # hashes of runs of ``length`` words, and a power for each length
    while True:
        if width & length:
            out = part if out is None else out[: len(part) - have] * factor + part[have:] if len(part) > have else out[:0]
            have += length
        if 2 * length > width:
            return mix(out[: max(0, len(words) - width + 1)])
        part = part[:-length] * factor + part[length:] if len(part) > length else part[:0]
        factor, length = np.uint64(int(factor) ** 2 % 2**64), 2 * length


def window_keys(words: np.ndarray, run: int) -> np.ndarray:
    """The key of each window: the smallest hash of its runs, signed."""
    if len(words) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    low, have, many = run_hashes(words, run), 1, WINDOW - run + 1
    while 2 * have <= many:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    if have < many:
        low = np.minimum(low[: len(low) - (many - have)], low[many - have :])
    return low.view(np.int64)


def blocks(part: pa.RecordBatch, column: int, run: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(at, texts, rows, starts, keys) of texts together about BLOCK bytes long: the batch row of the first; each window's batch row, first word and key."""
    texts = part.column(column).cast(pa.binary())
    sizes, at = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0
    while at < len(texts):
        end, size = at + 1, sizes[at]
        while end < len(texts) and size < BLOCK:
            size += sizes[end]
            end += 1
        some = [t or b"" for t in texts.slice(at, end - at).to_pylist()]
        places, words = word_hashes(b"\n".join(some))
        first = np.searchsorted(places, np.cumsum([0, *[len(t) + 1 for t in some]]))
        keys = window_keys(words, run)
        owner = np.repeat(np.arange(len(some)), np.diff(first))[: len(keys)]
        window = np.arange(len(keys))
        whole = window + WINDOW <= first[1:][owner]
        yield at, some, owner[whole] + at, window[whole] - first[owner[whole]], keys[whole]
        at = end


def key_entries(texts: DataFrame, run: int) -> DataFrame:
    """key, row, at, id: the keys of each text (row, at, id, words), a repeat only where another key lies between."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, _, rows, _, keys in blocks(part, 3, run):
                fresh = np.ones(len(keys), dtype=bool)
                fresh[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                take = pa.array(rows[fresh])
                yield pa.RecordBatch.from_arrays([pa.array(keys[fresh]), *[part.column(i).take(take) for i in range(3)]], ["key", "row", "at", "id"])

    kind = {c: texts.schema[c].dataType.simpleString() for c in ("row", "id")}
    return texts.mapInArrow(batches, f"key bigint, row {kind['row']}, at bigint, id {kind['id']}")


def shards_of(entries: DataFrame) -> DataFrame:
    """key, first, shard, tasks: where each key goes that documents with different ids have.

    first is the smallest id (a null comes after all others), tasks how many tasks stream its shard.
    """
    spark = entries.sparkSession
    held = entries.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("lone"), F.count("*").alias("n"))
    shared = cut(held.filter((F.col("first") < F.col("last")) | (F.col("first").isNotNull() & F.col("lone"))).select("key", "first", "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    most = min(MOST_KEYS, max(LEAST_KEYS, total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    shards = max(1, total // most)
    loads = shared.groupBy("first").agg(F.sum("n").alias("load"))
    place = F.pmod(F.xxhash64("first"), F.when(F.col("load") > most, F.lit(1 << 40)).otherwise(F.lit(shards)))
    shard = F.when(F.col("load") > most, place + shards).otherwise(place)
    return shared.select("key", "first").join(loads.select("first", shard.alias("shard"), F.ceil(F.col("load") / most).cast("int").alias("tasks")), "first")


def stretches(texts: DataFrame, lists: DataFrame, run: int) -> DataFrame:
    """shard, task, own, row, at, id, words: runs of windows that go to one shard; own ones are indexed, others stream."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(4)
            for base, some, rows, starts, keys in blocks(part, 3, run):
                out = {c: [] for c in ("shard", "tasks", "own", "take", "at", "words")}
                for row in np.unique(rows).tolist():
                    mine = slice(*np.searchsorted(rows, (row, row + 1)))
                    known = lists[row].values
                    order = np.argsort(listed := known.field("key").to_numpy())
                    listed = listed[order]
                    place = np.minimum(np.searchsorted(listed, keys[mine]), len(listed) - 1)
                    hit = listed[place] == keys[mine]
                    place = order[place]
                    shard, tasks, own = (known.field(c).to_numpy(zero_copy_only=False)[place] for c in ("shard", "tasks", "own"))
                    start = starts[mine]
                    fresh = np.ones(len(start) + 1, dtype=bool)
                    fresh[1:-1] = (hit[1:] != hit[:-1]) | (shard[1:] != shard[:-1]) | (own[1:] != own[:-1])
                    ends = np.flatnonzero(fresh)
                    words = some[row - base].split()
                    first = part.column(1)[row].as_py()
                    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                        if hit[a]:
                            out["shard"].append(int(shard[a]))
                            out["tasks"].append(int(tasks[a]))
                            out["own"].append(bool(own[a]))
                            out["take"].append(row)
                            out["at"].append(first + int(start[a]))
                            out["words"].append(b" ".join(words[int(start[a]) : int(start[b - 1]) + WINDOW]))
                take = pa.array(out["take"], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(out["shard"], pa.int64()), pa.array(out["tasks"], pa.int32()), pa.array(out["own"], pa.bool_()), part.column(0).take(take),
                    pa.array(out["at"], pa.int64()), part.column(2).take(take), pa.array(out["words"], pa.binary())], ["shard", "tasks", "own", "row", "at", "id", "words"])

    kind = {c: texts.schema[c].dataType.simpleString() for c in ("row", "id")}
    found = texts.join(lists, ["row", "at"]).select("row", "at", "id", "words", "keys")
    found = found.mapInArrow(batches, f"shard bigint, tasks int, own boolean, row {kind['row']}, at bigint, id {kind['id']}, words binary")
    tasks = F.when(F.col("own"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row", "at"), F.col("tasks")).cast("int")))
    return found.select("shard", F.explode(tasks).alias("task"), "own", "row", "at", "id", "words")


class Shard:
    """The index of one shard's own stretches, and the lanes that wait to be searched."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.own: dict[bytes, np.ndarray] = {}
        self.index = None
        self.lanes: list[tuple[int, int, np.ndarray]] = []
        self.held: list[tuple] = []

    def add(self, words: bytes) -> None:
        number = self.numbers
        if words not in self.own:  # rows with one id can have it often
            self.own[words] = np.array([number.setdefault(w, len(number) + 1) for w in words.split()], dtype=np.int64)

    def stream(self, row: object, at: int, id_: object, words: bytes) -> bool:
        """Queue a text; True once there are enough lanes."""
        get, split = self.numbers.get, words.split()
        numbers = np.array([get(w, -1) for w in split], dtype=np.int64)
        for lane in range(0, len(numbers) - WINDOW + 1, LANE):
            self.lanes.append((len(self.held), lane, numbers[lane : lane + LANE + WINDOW - 1]))
        self.held.append((row, at, id_, split))
        return len(self.lanes) >= LANES

    def search(self) -> Iterator[tuple]:
        """(row, at, id, n, words) of runs of windows of the queued texts: words is null where the index has them."""
        if not self.held:
            return
        if self.index is None:
            self.index = FMIndex(list(self.own.values()), len(self.numbers) + 1, WINDOW)
            self.own = {}
        hit = [np.zeros(len(h[3]) - WINDOW + 1, dtype=bool) for h in self.held]
        lanes = sorted(self.lanes, key=lambda x: len(x[2]))
        for at in range(0, len(lanes), LANES):
            some = lanes[at : at + LANES]
            texts = np.full((len(some[-1][2]), len(some)), -1, dtype=np.int64)
            for j, (_, _, numbers) in enumerate(some):
                texts[: len(numbers), j] = numbers
            found = self.index.statistics(texts) >= WINDOW
            for j, (text, lane, numbers) in enumerate(some):
                hit[text][lane : lane + len(numbers) - WINDOW + 1] = found[: len(numbers) - WINDOW + 1, j]
        for (row, at, id_, split), flags in zip(self.held, hit):
            ends = np.flatnonzero(np.concatenate(([True], flags[1:] != flags[:-1], [True]))).tolist()
            for a, b in zip(ends[:-1], ends[1:]):
                yield row, at + a, id_, b - a, None if flags[a] else b" ".join(split[a : b + WINDOW - 1])
        self.lanes, self.held = [], []
        pa.default_memory_pool().release_unused()


def search(found: DataFrame) -> DataFrame:
    """row, at, id, n, words: runs of n streamed windows from word ``at`` on; words is null where a smaller id has them."""
    from pyspark.sql.pandas.types import to_arrow_type

    row_type, id_type = found.schema["row"].dataType, found.schema["id"].dataType
    arrow = pa.schema([("row", to_arrow_type(row_type)), ("at", pa.int64()), ("id", to_arrow_type(id_type)), ("n", pa.int64()), ("words", pa.binary())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, shard = None, None
            for part in parts:
                for which, task, own, row, at, id_, words in zip(*(c.to_pylist() for c in part.columns)):
                    if (which, task) != now:
                        if shard is not None:
                            yield from shard.search()
                        now, shard = (which, task), Shard()
                    if own:
                        shard.add(words)
                    elif shard.stream(row, at, id_, words):
                        yield from shard.search()
            if shard is not None:
                yield from shard.search()

        held, size = [], 0
        for one in rows():
            held.append(one)
            size += len(one[4] or b"")
            if len(held) == 8192 or size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    ordered = found.repartition("shard", "task").sortWithinPartitions("shard", "task", F.desc("own"), "row", "at")
    return ordered.mapInArrow(batches, f"row {row_type.simpleString()}, at bigint, id {id_type.simpleString()}, n bigint, words binary")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """row, at, n: runs of n windows of rows (row, id, text) from word ``at`` on that a row with a smaller id has too."""
    texts = rows.select("row", F.lit(0).cast("bigint").alias("at"), "id", F.col("text").cast("binary").alias("words"))
    out, run = None, RUN
    while True:
        entries = cut(key_entries(texts, run))
        placed = cut(shards_of(entries))
        bits = marks(placed, "key")
        own = F.col("id").eqNullSafe(F.col("first"))
        hits = only(entries, bits, "key").join(placed, "key").groupBy("row", "at").agg(F.collect_list(F.struct("key", "shard", "tasks", own.alias("own"))).alias("keys"))  # bounded by the text
        lists = cut(hits)
        discard(entries)
        bits.unpersist()
        found = cut(search(stretches(texts, lists, run)))
        discard(placed, lists)
        some = found.filter("words is null").select("row", "at", "n")
        out = some if out is None else out.unionByName(some)
        texts = found.filter("words is not null").select("row", "at", "id", "words")
        if not texts.take(1):
            return out
        run = WINDOW


def removal(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """row, id, n_words, n_removed, kept: what is left of the words of rows (row, id, text), one space between."""
    spans = cut(repeats.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans")))
    bits = marks(spans, "row")  # texts that lose nothing are not moved

    def left(text: bytes | None, found: pa.Scalar | None) -> tuple[int, int, bytes]:
        words = (text or b"").split()
        count = len(words)
        if found is not None and found.is_valid:
            edge = np.zeros(count + 1, dtype=np.int64)
            at, n = (found.values.field(c).to_numpy() for c in ("at", "n"))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n + WINDOW - 1, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        return count, count - len(words), b" ".join(words)

    def cleaned(part: pa.RecordBatch, found: pa.Array | None) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.num_rows, TEXTS):
            some = part.slice(at, TEXTS)
            texts = some.column(2).cast(pa.binary())
            count, gone, kept = zip(*(left(t.as_py(), None if found is None else found[at + i]) for i, t in enumerate(texts)))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "id", "n_words", "n_removed", "kept"])

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from cleaned(part.filter(pa.array(~hits(bits, part.column(3)))), None)

    def some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from cleaned(part, part.column(3))

    schema = f"row {rows.schema['row'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string"
    moved = only(rows, bits, "row").join(spans, "row", "left").select("row", "id", "text", "spans")
    return rows.select("row", "id", "text", place_of("row").alias("place")).mapInArrow(whole, schema).unionByName(moved.mapInArrow(some, schema))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (its key), id, n_words, n_removed, kept for each row of df: its words without those in repeated windows.

    Words are runs of anything but U+0020 and U+0009 to U+000D; a word goes if a window of WINDOW words
    around it begins in a row with a smaller id as well, as the texts were before anything went. kept has
    one space between words. Rows with equal ids, repeated ones too, are not smaller than one another, and
    a null id comes after all others. Null and short texts lose nothing. Ids may be of any type that sorts;
    an empty table gives an empty result, and other columns are not read.
    """
    base, key = with_row_key(df)
    rows = base.select(F.col(key).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return removal(rows, repeated_windows(rows))
