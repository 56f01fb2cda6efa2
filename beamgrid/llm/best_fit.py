"""Best-fit packing into sequences by swap-based local search.

Texts are encoded and packed in the same task, a block at a time: a document's last `length` ids and those before them are
full sequences of their own, what is left at its front, or a whole shorter document, is a piece to be placed. Pieces go,
longest first, to the fullest sequence (bin) they fit into; then a local search exchanges pieces between underfull bins as long as the sum of the squared fills grows, from the emptiest bin on: a piece moves, two pieces change
places, or two pieces change with one. Of all exchanges that an offer allows, that which leaves the receiving bin
fullest is taken, so the emptiest bins run empty and vanish.

The least full bins of a block, at most `carried`, go on into the next block of the task, and those at its end into further
rounds, in which `fan_in` tasks' bins are packed together until one group is left. So a group is of bounded size at
every scale, only open bins are shuffled, and a sequence is left part empty for want of a partner at most once.

Defined cases: a null or empty text has the end id alone; rows that repeat a doc_id are documents of their own; a null
doc_id stays null; an empty table gives no piece. Columns beside key and text are not read. sequence_id is unique, not
gapless, and depends on how the table is cut into tasks; the number of sequences hardly does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .tokens import default_tokenizer, encoder

#: Bins of one block, distinct lengths of a bin of which pairs are offered, and exchanges looked at for an offer. They bound
#: the work of the search, not what is packed.
BLOCK_BINS, PAIRED, TRIED = 4096, 10, 128


class Search:
    """Bins of pieces; gaps and lengths are whole numbers up to `cap`."""

    def __init__(self, lengths: list[int], cap: int):
        self.cap, self.lengths = cap, lengths
        self.held: list[dict[int, list[int]]] = []
        self.fill: list[int] = []
        self.best = max(1, -(-sum(lengths) // cap)) if lengths else 0
        self._place()

    def _place(self) -> None:
        """Best fit, longest pieces first: a bit for each gap that some bin has."""
        bins: list[list[int]] = [[] for _ in range(self.cap + 1)]
        gaps = 0
        for piece in sorted(range(len(self.lengths)), key=lambda p: -self.lengths[p]):
            n = self.lengths[piece]
            fits = gaps >> n
            if fits:
                gap = n + (fits & -fits).bit_length() - 1
                b = bins[gap].pop()
                if not bins[gap]:
                    gaps ^= 1 << gap
            else:
                gap, b = self.cap, len(self.fill)
                self.fill.append(0)
                self.held.append({})
            self.fill[b] += n
            self.held[b].setdefault(n, []).append(piece)
            bins[gap - n].append(b)
            gaps |= 1 << (gap - n)

    def improve(self, passes: int = 32) -> None:
        """Exchange pieces until no exchange raises the sum of squared fills, or no bin can be saved."""
        self.version = [0] * len(self.fill)
        self.open: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(self.cap + 1)]
        self.reaches = 0
        self.left = sum(1 for f in self.fill if f)
        for b, f in enumerate(self.fill):
            if f < self.cap:
                self._offer(b)
        for _ in range(passes):
            changed = False
            for b in sorted((b for b, f in enumerate(self.fill) if 0 < f < self.cap), key=lambda b: self.fill[b]):
                while self.left > self.best and 0 < self.fill[b] < self.cap and self._give(b):
                    changed = True
            if not changed or self.left <= self.best:
                break

    def _pairs(self, b: int) -> Iterator[tuple[int, int]]:
        own = sorted(self.held[b])[:PAIRED]
        for i, x in enumerate(own):
            if len(self.held[b][x]) > 1:
                yield x, x
            for y in own[i + 1 :]:
                yield x, y

    def _offer(self, b: int) -> None:
        """List what bin b would give for a piece, by the longest piece it could take in exchange."""
        gap = self.cap - self.fill[b]
        if not gap or not self.fill[b]:
            return
        for out in ((), *((n,) for n in self.held[b]), *self._pairs(b)):
            reach = min(self.cap, gap + sum(out))
            self.open[reach].append((b, self.version[b], out))
            self.reaches |= 1 << reach

    def _find(self, a: int, given: tuple[int, ...]) -> tuple[int, tuple[int, ...]] | None:
        """(bin, what it gives) for the exchange that fills that bin most, if it then is fuller than a is now."""
        total, room = sum(given), self.cap - self.fill[a]
        fits, tried = self.reaches >> total, 0
        while fits:
            reach = total + (fits & -fits).bit_length() - 1
            if reach - total >= room or tried >= TRIED:
                return None
            listed = self.open[reach]
            k = len(listed)
            while k and tried < TRIED:
                k -= 1
                b, version, out = listed[k]
                if version != self.version[b]:
                    listed[k] = listed[-1]
                    listed.pop()
                    continue
                tried += 1
                if b != a and len(given) + len(out) <= 3 and sum(out) < total:
                    return b, out
            if not listed:
                self.reaches ^= 1 << reach
            fits &= fits - 1
        return None

    def _give(self, a: int) -> bool:
        """One exchange in which bin a loses; whether there was one."""
        own = sorted(self.held[a], reverse=True)
        for given in (*((n,) for n in own), *self._pairs(a)):
            found = self._find(a, given)
            if found:
                b, out = found
                for x, y, lengths in ((a, b, given), (b, a, out)):
                    for n in lengths:
                        piece = self.held[x][n].pop()
                        if not self.held[x][n]:
                            del self.held[x][n]
                        self.held[y].setdefault(n, []).append(piece)
                        self.fill[x] -= n
                        self.fill[y] += n
                self.left -= not self.fill[a]
                for x in (a, b):
                    self.version[x] += 1
                    self._offer(x)
                return True
        return False

    def bins(self) -> np.ndarray:
        """The bin of each piece, numbered from 0 without gaps, fullest first."""
        out = np.zeros(len(self.lengths), np.int64)
        kept = sorted((b for b, f in enumerate(self.fill) if f), key=lambda b: -self.fill[b])
        for number, b in enumerate(kept):
            for pieces in self.held[b].values():
                out[pieces] = number
        return out


def pack_lengths(lengths: np.ndarray, cap: int) -> np.ndarray:
    """The bin of each piece (numbers from 0, fullest first)."""
    search = Search(lengths.tolist(), cap)
    search.improve()
    return search.bins()


_NAMES = ["doc_id", "piece", "start", "ids", "sequence_id", "offset", "part"]


def _settle(table: pa.Table, length: int, base: int, part: int, carried: int) -> tuple[pa.Table, pa.Table, int]:
    """(rows that have their place, rows of at most `carried` open bins, number of bins given out) of the pieces of a block."""
    sizes = pc.binary_length(table["ids"]).to_numpy().astype(np.int64) // 4
    bins = pack_lengths(sizes, length)
    count = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, sizes, count).astype(np.int64)
    last = max(count - carried, int((fill == length).sum()))
    order = np.lexsort((np.arange(len(bins)), bins))
    ends = np.cumsum(sizes[order])
    starts = np.searchsorted(bins[order], np.arange(count))
    offset = np.empty(len(bins), np.int64)
    offset[order] = ends - sizes[order] - (ends - sizes[order])[starts][bins[order]] if count else 0
    for name, values in (("sequence_id", base + bins), ("offset", offset), ("part", np.full(len(bins), part))):
        table = table.set_column(_NAMES.index(name), name, pa.array(values, pa.int64()))
    mask = pa.array(bins < last)
    return table.filter(mask), table.filter(pc.invert(mask)), last


def _pieces(keys: pa.Array, ids: np.ndarray, bounds: np.ndarray, length: int) -> tuple[pa.Table, np.ndarray]:
    """All pieces of a block of texts, and which of them are full."""
    n = np.diff(bounds)
    front = n % length
    count = n // length + (front > 0)
    doc = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.where(number == 0, 0, (number - (front > 0)[doc]) * length + front[doc])
    size = np.where((number == 0) & (front > 0)[doc], front[doc], length)
    # pieces tile the ids, so the payload is cut where they begin
    cuts = np.append(bounds[:-1][doc] + start, bounds[-1]) * 4
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    payload = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cuts.astype(np.int64)), data]).cast(pa.binary())
    zero = pa.array(np.zeros(len(doc), np.int64))
    return pa.table([keys.take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), payload, zero, zero, zero], names=_NAMES), size == length


def _again(turn: int, length: int, carried: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Packs the open bins of some tasks together, in a round numbered from 1."""

    def settle(group: tuple, table: pa.Table) -> pa.Table:
        number = group[0].as_py()
        table = table.drop_columns(["open"]).sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        done, rows, _ = _settle(table, length, (turn << 56) + (number << 32), number, carried)
        return pa.concat_tables([t.append_column("open", pa.array([o] * len(t), pa.bool_())) for t, o in ((done, False), (rows, True))])

    return settle


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 2048, tokenizer: str | None = None, end_id: int = 0, carried: int = 256, fan_in: int = 16) -> DataFrame:
    """Pieces: doc_id, piece, start, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        call = encoder(tokenizer)
        base, waiting, held, rows = part << 32, 0, [], None

        def out(table: pa.Table, is_open: bool) -> Iterator[pa.RecordBatch]:
            yield from table.append_column("open", pa.array([is_open] * len(table), pa.bool_())).to_batches(10_000)

        for batch in batches:
            for first, ids, bounds in call.blocks(batch.column(1), end_id):
                table, full = _pieces(batch.column(0).slice(first, len(bounds) - 1), ids, bounds, length)
                whole = table.filter(pa.array(full))
                whole = whole.set_column(4, "sequence_id", pa.array(base + np.arange(len(whole)), pa.int64()))
                base += len(whole)
                yield from out(whole, False)
                rest = table.filter(pa.array(~full))
                held.append(rest)
                waiting += pc.sum(pc.binary_length(rest["ids"])).as_py() or 0
                if waiting >= BLOCK_BINS * length * 4:
                    done, rows, count = _settle(pa.concat_tables(held), length, base, part, carried)
                    base += count
                    yield from out(done, False)
                    held, waiting = [rows], rows["ids"].nbytes
        if held:
            done, rows, _ = _settle(pa.concat_tables(held), length, base, part, carried)
            yield from out(done, False)
            yield from out(rows, True)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, ids binary, sequence_id long, offset long, part long, open boolean"
    placed = materialize(rows.mapInArrow(encode, schema), "packed")
    done = [placed.filter("not open")]
    turn = 0
    while True:
        turn += 1
        # whether one more round has anything to put together: two numbers
        most = placed.filter("open").agg(F.max("part"), F.count(F.lit(1))).first()
        if not most[1]:
            break
        groups = int(most[0]) // fan_in + 1

        grouped = placed.filter("open").groupBy(F.floor(F.col("part") / fan_in).cast("long").alias("of"))
        placed = materialize(grouped.applyInArrow(_again(turn, length, carried if groups > 1 else 0), schema), "packed")
        done.append(placed.filter("not open"))
        if groups == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(*_NAMES[:-1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents packed to 2048; a digest of each piece's ids."""
    out = pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
