"""Operator 1: suffix-array dedup through a tree of common-prefix intervals.

Every byte that a LENGTH-byte string covers which also starts earlier (smaller
doc_id, or same document and earlier start) is removed; strings are judged on
the input and never cross documents.

1. Each LENGTH-byte window has an anchor, its least-hashed GRAM-byte string, so
   equal windows have equal anchors at equal places. A run of windows with one
   anchor is a segment of LENGTH to LENGTH + REACH bytes, known by its anchor, a
   digest of 128 bits and its length.
2. Segments are shuffled and sorted by anchor and digest and streamed. All but
   the first of equal segments are copies, each kept with the place of the one
   it repeats; runs of copies with one source are one row. Tasks collapse equal
   segments of a chunk before the shuffle. Anchors with two or more different
   segments ask for the bytes of the first of each.
3. These bytes are shuffled and sorted by anchor and streamed in blocks of whole
   anchors. A block's enhanced suffix array (suffixes sorted by prefix doubling,
   common-prefix lengths) is scanned with a stack that holds the open intervals
   of the common-prefix tree; an interval whose suffixes have different left
   neighbours, or stand at a segment's start, is a maximal repeat. The tree is
   put out, a row an interval and a row a place; a place goes up the tree to the
   longest repeat of which it is not the first occurrence. `occurrences` lists
   them all, those in copies through the copies' sources.
4. Copies and repeats are joined to their documents and cut out.

No key is hot: a passage that many documents share has one segment a chunk
where its segments are equal, and where it borders on different text its
anchors have so many contexts that a first pass finds them (`hot_anchors`); the
windows of such segments are segments of their own, each with an anchor of its
own, in every chunk. An anchor that is not hot has a bounded share of all
segments. The texts are written once, bucketed by doc_id, so steps 3 and 4 move
only positions and asked segments.

Defined cases: null text is empty; a null doc_id comes after all others; rows
equal in doc_id and text are one document, each of them reported; rows equal in
doc_id only are ordered by the text's CRC-32; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common, units

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
CHUNK_BYTES, BLOCK = 8 << 20, 1 << 18
NO_ID = (1 << 63) - 1
#: An anchor is a candidate in chunks where it has so many contexts, and hot if it has more of them than one in MOST_HOT of all segments.
HOT_CONTEXTS, MOST_HOT = 16, 1 << 17
#: Bytes of segments that share a suffix array, anchors kept whole.
TREE_BYTES = 1 << 18

_rng = np.random.default_rng(1973)
#: Two independent hashes: a random number for each byte, and the factor of a step.
TABLES = tuple(_rng.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in range(2))
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if (which, n) not in _powers:
        make = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))])
        _powers[which, n] = make(np.uint64(BASES[which])), make(np.uint64(pow(BASES[which], -1, 1 << 64)))
    return _powers[which, n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def segments(data: np.ndarray, valid: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(anchor hash, digest's two halves, start, length) of the segments of a buffer.

    `valid` marks the places at which a window starts, none of which crosses a
    document's end. Segments of the anchors `hot` (sorted) come window by window.
    """
    found = []
    tables = [_power_tables(k, BLOCK + LENGTH) for k in range(2)]
    low = np.uint64((1 << 20) - 1)
    for at in range(0, len(data), BLOCK):
        piece = data[at : at + BLOCK + LENGTH - 1]
        n = len(piece) - LENGTH + 1
        if n <= 0:
            break
        starts = np.flatnonzero(valid[at : at + n])
        if not len(starts):
            continue
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(t[piece] * inverse[: len(piece)])]) for t, (_, inverse) in zip(TABLES, tables, strict=True)]
        grams = _mix((sums[0][GRAM:] - sums[0][:-GRAM]) * tables[0][0][: len(sums[0]) - GRAM])
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width * 2 <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        anchor = (least[starts] & low).astype(np.int64)
        new = np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1])])
        s = starts[new]
        e = starts[np.concatenate([new[1:], [True]])] + LENGTH
        name = grams[anchor[new]]
        split = np.zeros(len(name), bool) if hot is None or not len(hot) else hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name
        if split.any():
            windows = units.ranges(s[split], e[split] - s[split] - LENGTH + 1)
            s, e = np.concatenate([s[~split], windows]), np.concatenate([e[~split], windows + LENGTH])
        digest = [_mix((x[e] - x[s]) * power[s]) for x, (power, _) in zip(sums, tables, strict=True)]
        if split.any():
            name = np.concatenate([name[~split], digest[0][len(s) - len(windows) :]])
        found.append((name, *digest, s + at, e - s))
    if not found:
        return (*(np.zeros(0, np.uint64) for _ in range(3)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def merged(doc: np.ndarray, start: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of overlapping or touching intervals of each document."""
    if not len(doc):
        return doc, start, finish
    order = np.lexsort((start, doc))
    doc, start, finish = doc[order], start[order].astype(np.int64), finish[order].astype(np.int64)
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    lift = number * (int(finish.max()) + 2)  # later documents lie beyond all ends of earlier ones
    reach = np.maximum.accumulate(finish + lift)
    new = np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]])
    last = np.concatenate([new[1:], [True]])
    return doc[new], start[new], (reach - lift)[last]


def _chunk(table: pa.Table):
    """The distinct documents of a chunk, ordered: oid, tie, concatenated bytes, begin, valid window starts."""
    oid, tie = table.column("oid").to_numpy(), table.column("tie").to_numpy()
    order = np.lexsort((tie, oid))
    keep = np.concatenate([[True], (oid[order][1:] != oid[order][:-1]) | (tie[order][1:] != tie[order][:-1])])
    order = order[keep]
    texts = table.column("text").combine_chunks().cast(pa.large_binary()).take(pa.array(order))
    data, begin, sizes = units.layout_of(texts)
    data, begin = data[begin[0] : begin[-1] + sizes[-1]], begin - begin[0]
    # A window starts where LENGTH bytes are left.
    steps = np.zeros(len(data) + 1, np.int8)
    ends = begin + sizes
    enough = sizes >= LENGTH
    np.add.at(steps, begin[enough], 1)
    np.add.at(steps, ends[enough] - LENGTH + 1, -1)
    return oid[order], tie[order], data, begin, np.cumsum(steps[:-1], dtype=np.int8) > 0


def _hot_scanner(contexts: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, contexts) of a chunk's anchors with many contexts; the row of null has the segments of the chunk."""
        for table in units.chunks(batches, CHUNK_BYTES):
            _, _, data, _, valid = _chunk(table)
            anchor, half, *_ = segments(data, valid)
            order = np.lexsort((half, anchor))
            anchor, half = anchor[order], half[order]
            distinct = np.ones(len(anchor), bool)
            distinct[1:] = (anchor[1:] != anchor[:-1]) | (half[1:] != half[:-1])
            names, counts = np.unique(anchor[distinct], return_counts=True)
            many = counts >= contexts
            yield pa.RecordBatch.from_arrays([pa.array([None, *names[many].view(np.int64).tolist()], pa.int64()), pa.array([len(anchor), *counts[many].tolist()], pa.int64())], names=["anchor", "n"])

    return scan


def hot_anchors(texts: DataFrame, contexts: int = HOT_CONTEXTS) -> np.ndarray:
    """The sorted anchors with a great share of all segments, MOST_HOT at most."""
    counted = texts.select("oid", "tie", "text").mapInArrow(_hot_scanner(contexts), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counted = common.materialize(counted, "anchors")
    total = counted.filter("anchor IS NULL").first()
    least = max(4 * contexts, -(-total["n"] // MOST_HOT)) if total else 0
    return np.sort(np.array([r["anchor"] for r in counted.filter((F.col("anchor").isNotNull()) & (F.col("n") >= least)).select("anchor").collect()], np.int64).view(np.uint64))


#: A segment; of a copy, anchor, half and other half are the start, oid and tie of what it repeats.
SEGMENT = "copy boolean, anchor long, half long, other long, size long, oid long, tie long, start long"
_SEGMENT = pa.schema([("copy", pa.bool_()), *((c.split()[0], pa.int64()) for c in SEGMENT.split(", ")[1:])])


def _scanner(hot):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in units.chunks(batches, CHUNK_BYTES):
            oid, tie, data, begin, valid = _chunk(table)
            anchor, half, other, at, size = segments(data, valid, hot.value)
            doc = np.searchsorted(begin, at, "right") - 1
            # Empty documents begin where the next one does; the last of them holds the bytes.
            start = at - begin[doc]
            order = np.lexsort((at, size, other, half, anchor))
            anchor, half, other, doc, start, size = (x[order] for x in (anchor, half, other, doc, start, size))
            first = np.ones(len(anchor), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (half[1:] != half[:-1]) | (other[1:] != other[:-1]) | (size[1:] != size[:-1])
            of = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
            # Copies of one source at one distance are one run.
            c = np.flatnonzero(~first)
            runs = np.stack([doc[c], doc[of[c]], start[c] - start[of[c]]], axis=1)
            kinds, kind = np.unique(runs, axis=0, return_inverse=True) if len(c) else (runs, c)
            kind, s, e = merged(kind.ravel(), start[c], start[c] + size[c])
            d, source, shift = kinds[kind].T
            columns = [(np.zeros(int(first.sum()), bool), np.ones(len(s), bool)), (anchor[first].view(np.int64), s - shift), (half[first].view(np.int64), oid[source]), (other[first].view(np.int64), tie[source]), (size[first], e - s), (oid[doc[first]], oid[d]), (tie[doc[first]], tie[d]), (start[first], s)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], schema=_SEGMENT)

    return scan


#: copy: these bytes repeat those at s_oid, s_tie, s_start; else: the bytes are asked for.
FOUND = "copy boolean, anchor long, oid long, tie long, start long, finish long, s_oid long, s_tie long, s_start long"
_FOUND = pa.schema([("copy", pa.bool_()), *((c.split()[0], pa.int64()) for c in FOUND.split(", ")[1:])])


def _found(copy: bool, anchor, oid, tie, start, size, source=None) -> pa.RecordBatch:
    arrays = [pa.array(x) for x in (anchor, oid, tie, start, start + size)]
    sources = [pa.array(x) for x in source] if source else [pa.nulls(len(oid), pa.int64())] * 3
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(oid), copy)), *arrays, *sources], schema=_FOUND)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams segments sorted by anchor, digest, size and place: all but the first of equal ones are copies,
    and anchors with different ones ask for the first of each. Between batches only the last of these is held.
    """
    lead, asked = None, False
    for batch in batches:
        copy = batch.column(0).to_numpy(zero_copy_only=False)
        columns = [c.to_numpy() for c in batch.columns[1:]]
        if copy.any():
            s_start, s_oid, s_tie, size, oid, tie, start = (c[copy] for c in columns)
            yield _found(True, np.zeros(len(oid), np.int64), oid, tie, start, size, (s_oid, s_tie, s_start))
        columns = [c[~copy] for c in columns]
        if not len(columns[0]):
            continue
        if lead is not None:
            columns = [np.concatenate([[x], c]) for x, c in zip(lead, columns, strict=True)]
        anchor, half, other, size, oid, tie, start = columns
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (half[1:] != half[:-1]) | (other[1:] != other[:-1]) | (size[1:] != size[:-1])
        heads = np.flatnonzero(first)
        of = heads[np.cumsum(first) - 1]
        later = np.flatnonzero(~first & ((oid != oid[of]) | (tie != tie[of]) | (start != start[of])))
        by = of[later]
        yield _found(True, anchor[later], oid[later], tie[later], start[later], size[later], (oid[by], tie[by], start[by]))
        group = np.cumsum(np.concatenate([[0], anchor[heads[1:]] != anchor[heads[:-1]]]))
        ask = np.bincount(group) > 1
        old = lead is not None and asked
        ask[0] |= old
        rows = heads[ask[group]]
        rows = rows[1:] if old else rows
        yield _found(False, anchor[rows], oid[rows], tie[rows], start[rows], size[rows])
        lead, asked = [c[heads[-1]] for c in columns], bool(ask[-1])


PIECE = "anchor long, oid long, tie long, start long, data binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        for i in range(batch.num_rows):
            text, wanted = batch.column(2)[i].as_buffer(), batch.column(3)[i].values
            data = np.frombuffer(text, np.uint8)
            start, finish = wanted.field("start").to_numpy(), wanted.field("finish").to_numpy()
            pieces = units.strings_from(data[units.ranges(start, finish - start)], finish - start)
            out = [wanted.field("anchor"), pa.repeat(batch.column(0)[i], len(start)), pa.repeat(batch.column(1)[i], len(start)), pa.array(start), pieces.view(pa.large_binary()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(out, kinds, strict=True)], names=["anchor", "oid", "tie", "start", "data"])


class SuffixArray:
    """Enhanced suffix array over pieces of text: the suffixes of `least` bytes or more, which end with their piece."""

    def __init__(self, pieces: list[bytes], least: int):
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(self.data)
        self.piece = np.repeat(np.arange(len(pieces)), sizes)
        self.begin = np.cumsum(sizes) - sizes
        self.room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # bytes up to the piece's end
        # Eight bytes a word, each plus one so that a piece's end is less; nine bits fit seven bytes a word.
        word = np.zeros(n, np.int64)
        for k in range(7):
            inside = self.room > k
            word[inside] += (self.data[np.flatnonzero(inside) + k].astype(np.int64) + 1) << (9 * (6 - k))
        self.word = word
        ranks = [np.unique(word, return_inverse=True)[1].astype(np.int64) + 1]
        widths = [7]
        longest = int(sizes.max(initial=0))
        while widths[-1] < longest:
            r, w = ranks[-1], widths[-1]
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(self.room > w)
            after[inside] = r[inside + w]
            ranks.append(np.unique(r * (int(r.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1)
            widths.append(2 * w)
        places = np.flatnonzero(self.room >= least)
        self.suffix = places[np.argsort(ranks[-1][places], kind="stable")]
        self.lcp = self._common(self.suffix[:-1], self.suffix[1:], ranks, widths)

    def _common(self, a, b, ranks, widths):
        """Bytes in common of the suffixes at a and at b, up to the shorter one's end."""
        most = np.minimum(self.room[a], self.room[b]) if len(a) else np.zeros(0, np.int64)
        out = np.zeros(len(a), np.int64)
        for r, w in zip(reversed(ranks), reversed(widths), strict=True):
            live = np.flatnonzero(out < most)
            same = r[a[live] + out[live]] == r[b[live] + out[live]]
            out[live[same]] += w
        live = np.flatnonzero(out < most)
        differ = self.word[a[live] + out[live]] ^ self.word[b[live] + out[live]]
        extra = np.zeros(len(live), np.int64)
        for k in range(1, 7):
            extra += (differ >> (9 * (7 - k))) == 0
        out[live] += extra
        return np.minimum(out, most)

    def left(self) -> np.ndarray:
        """The byte before each suffix; -1 at a piece's start, where it is unknown."""
        at_start = self.suffix == self.begin[self.piece[self.suffix]]
        return np.where(at_start, -1, self.data[np.maximum(self.suffix - 1, 0)].astype(np.int64))

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, low, high) of each maximal repeat of `least` bytes or more: suffix[low : high] are all its occurrences.

        A stack holds the open intervals [length, low, left byte, diverse]. An
        interval closes where the common prefix gets shorter; it is a maximal
        repeat if its left bytes differ or one of them is unknown.
        """
        left = self.left()
        high_enough = np.flatnonzero(self.lcp >= least)
        if not len(high_enough):
            return
        cut = np.flatnonzero(np.diff(high_enough) > 1) + 1
        for run in np.split(high_enough, cut):
            stack: list[list] = []
            lo = int(run[0])
            lengths = [*self.lcp[run].tolist(), 0]
            bytes_before = left[lo : lo + len(run) + 1].tolist()
            for i, length in enumerate(lengths):
                before = bytes_before[i]
                low, diverse = lo + i, before < 0
                while stack and stack[-1][0] > length:
                    size, low, b, d = stack.pop()
                    d = d or diverse or b != before
                    if d:
                        yield size, low, lo + i + 1
                    before, diverse = b, d
                if length >= least:
                    if stack and stack[-1][0] == length:
                        top = stack[-1]
                        top[3] = top[3] or diverse or top[2] != before
                    else:
                        stack.append([length, low, before, diverse])


#: An interval: grp, size, its places low to high, exclusive. A place: the deepest interval that holds it as grp, its number as low,
#: its document and start, and the finish of its longest bytes that also start earlier, null if there are none.
REPEATS = "grp long, size long, low long, high long, oid long, tie long, start long, finish long"
_REPEATS = pa.schema([(c.split()[0], pa.int64()) for c in REPEATS.split(", ")])


def nesting(low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(outer ones before inner ones, the interval around each, the deepest one at each of n places) of nested intervals; -1: none."""
    order = np.lexsort((-high, low))
    up = np.full(len(low), -1)
    ends, stack, cuts, deepest = high.tolist(), [], [0], [-1]
    for i, begin in zip([*order.tolist(), -1], [*low[order].tolist(), n], strict=True):
        while stack and ends[stack[-1]] <= begin:
            cuts.append(ends[stack.pop()])
            deepest.append(stack[-1] if stack else -1)
        if i >= 0:
            up[i] = stack[-1] if stack else -1
            stack.append(i)
            cuts.append(begin)
            deepest.append(i)
    return order, up, np.repeat(np.array(deepest, np.int64), np.diff([*cuts, n]))


def _block_repeats(table: pa.Table, base: int) -> tuple[pa.RecordBatch, int]:
    """The maximal repeats of a block of segments as a tree, numbered from `base`: a row an interval and a row a place, never a row a pair of them."""
    pieces = table.column("data").to_pylist()
    tree = SuffixArray(pieces, LENGTH)
    oid, tie, start = (table.column(c).to_numpy() for c in ("oid", "tie", "start"))
    owner = tree.piece[tree.suffix]
    o, t, s = oid[owner], tie[owner], start[owner] + tree.suffix - tree.begin[owner]
    n = len(o)
    # Pieces of a document may overlap; one occurrence can stand in the array twice and has one rank.
    by = np.lexsort((s, t, o))
    new = np.ones(n, bool)
    new[1:] = (o[by][1:] != o[by][:-1]) | (t[by][1:] != t[by][:-1]) | (s[by][1:] != s[by][:-1])
    rank = np.empty(n, np.int64)
    rank[by] = np.cumsum(new)
    groups = list(tree.maximal_repeats(LENGTH))
    size, low, high = (np.array(c, np.int64) for c in (zip(*groups, strict=True) if groups else [[]] * 3))
    order, up, deepest = nesting(low, high, n)
    at = np.flatnonzero(deepest >= 0)
    least = np.full(len(low), n + 1)
    np.minimum.at(least, deepest[at], rank[at])
    for i in order[::-1].tolist():
        if up[i] >= 0:
            least[up[i]] = min(least[up[i]], least[i])
    # A place goes up from its deepest interval while it is the first there: once for each interval that it is first in.
    finish = np.zeros(n, np.int64)
    live, here = at, deepest[at]
    while len(live):
        later = least[here] < rank[live]
        finish[live[later]] = s[live[later]] + size[here[later]]
        live, here = live[~later], up[here[~later]]
        live, here = live[here >= 0], here[here >= 0]
    none = lambda k: pa.nulls(k, pa.int64())
    k, m = len(low), len(at)
    intervals = [pa.array(base + np.arange(k)), pa.array(size), pa.array(base + low), pa.array(base + high), *[none(k)] * 4]
    places = [pa.array(base + deepest[at]), none(m), pa.array(base + at), none(m), pa.array(o[at]), pa.array(t[at]), pa.array(s[at]), pa.array(finish[at], mask=finish[at] == 0)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(intervals, places, strict=True)], schema=_REPEATS), n


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams pieces sorted by anchor in blocks of TREE_BYTES or more, cut where the anchor changes."""
    base, held, size = TaskContext.get().partitionId() << 40, [], 0
    for batch in batches:
        anchor = batch.column(0).to_numpy()
        ends = np.cumsum(pc.binary_length(batch.column(4)).to_numpy())
        at = 0
        last = held[-1].column(0)[-1].as_py() if held else None
        for cut in [c for c in np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])).tolist() if c or (last is not None and anchor[0] != last)]:
            before = size + int(ends[cut - 1] - (ends[at - 1] if at else 0)) if cut else size
            if before >= TREE_BYTES:
                block = [*held, batch.slice(at, cut - at)] if cut > at else held
                out, n = _block_repeats(pa.Table.from_batches(block), base)
                yield out
                base, held, size, at = base + n, [], 0, cut
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += int(ends[-1] - (ends[at - 1] if at else 0))
    if held:
        yield _block_repeats(pa.Table.from_batches(held), base)[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text, spans = row["text"] or b"", row["spans"] or []
            removed = runs = 0
            digest, at = hashlib.sha256(), 0
            if spans:
                s, e = (np.array([x[k] for x in spans], np.int64) for k in ("start", "finish"))
                for lo, hi in zip(*(x.tolist() for x in merged(np.zeros(len(s), np.int64), s, e)[1:]), strict=True):
                    digest.update(text[at:lo])
                    removed, runs, at = removed + hi - lo, runs + 1, hi
            digest.update(text[at:])
            rows.append((row["doc_id"], len(text), removed, runs, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def written_texts(docs: DataFrame) -> DataFrame:
    """doc_id, oid, tie, text: the texts as bytes, written once in buckets of oid."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("oid"), F.crc32("text").alias("tie"), "text")
    return common.materialize_bucketed(keyed, "texts", "oid")


def repeats(texts: DataFrame, contexts: int = HOT_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(copies: oid, tie, start, finish and the place s_oid, s_tie, s_start that they repeat; the maximal repeats of what is left: their tree, see REPEATS)."""
    spark = texts.sparkSession
    n = common.partitions(spark)
    hot = spark.sparkContext.broadcast(hot_anchors(texts, contexts))
    scanned = texts.select("oid", "tie", "text").mapInArrow(_scanner(hot), SEGMENT)
    key = F.when(F.col("copy"), F.xxhash64("oid", "tie", "start")).otherwise(F.col("anchor"))
    dealt = scanned.repartition(n, key).sortWithinPartitions("anchor", "half", "other", "size", "oid", "tie", "start")
    found = common.materialize(dealt.mapInArrow(_settle, FOUND), "segments")
    wanted = found.filter("not copy").groupBy("oid", "tie").agg(F.collect_list(F.struct("start", "finish", "anchor")).alias("wanted"))
    asked = texts.select("oid", "tie", "text").join(wanted.withColumnRenamed("tie", "w_tie"), "oid").filter("tie = w_tie").dropDuplicates(["oid", "tie"])
    pieces = asked.select("oid", "tie", "text", "wanted").mapInArrow(_fetch, PIECE)
    ordered = pieces.repartition(n, "anchor").sortWithinPartitions("anchor", "oid", "tie", "start")
    groups = common.materialize(ordered.mapInArrow(_repeats, REPEATS), "repeats")
    return found.filter("copy").select("oid", "tie", "start", "finish", "s_oid", "s_tie", "s_start"), groups


def occurrences(copies: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, size, oid, tie, start of every occurrence of the maximal repeats, those in copies included: the tree's places, listed by interval.

    An occurrence is carried along the copies that hold it whole, source by
    source; a source is always earlier than its copy, so this ends.
    """
    places = groups.filter("size IS NULL").select(F.col("low").alias("at"), "oid", "tie", "start")
    listed = groups.filter("size IS NOT NULL").select("grp", "size", F.explode(F.sequence("low", F.col("high") - 1)).alias("at"))
    here = listed.join(places, "at").select("grp", "size", "oid", "tie", "start").distinct()
    out = here = common.materialize(here, "occurrences")
    links = copies.select(F.col("oid").alias("to_oid"), F.col("tie").alias("to_tie"), F.col("start").alias("to_start"), (F.col("finish") - F.col("start")).alias("width"), F.col("s_oid").alias("oid"), F.col("s_tie").alias("tie"), "s_start")
    inside = (F.col("start") >= F.col("s_start")) & (F.col("start") + F.col("size") <= F.col("s_start") + F.col("width"))
    while True:
        step = here.join(links, ["oid", "tie"]).filter(inside).select("grp", "size", F.col("to_oid").alias("oid"), F.col("to_tie").alias("tie"), (F.col("to_start") + F.col("start") - F.col("s_start")).alias("start")).distinct()
        here = common.materialize(step.join(out, ["grp", "size", "oid", "tie", "start"], "left_anti"), "occurrences")
        if here.isEmpty():
            return out
        out = common.materialize(out.unionByName(here), "occurrences")


def dedup(docs: DataFrame, contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of `docs`."""
    texts = written_texts(docs)
    copies, groups = repeats(texts, contexts)
    later = groups.filter("finish IS NOT NULL").select("oid", "tie", "start", "finish")
    spans = copies.select("oid", "tie", "start", "finish").unionByName(later).groupBy("oid", "tie").agg(F.collect_list(F.struct("start", "finish")).alias("spans"))
    joined = texts.join(spans.select(F.col("oid").alias("s_oid"), F.col("tie").alias("s_tie"), "spans"), (F.col("oid") == F.col("s_oid")) & (F.col("tie") == F.col("s_tie")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark, sf_dir) -> DataFrame:
    return dedup(common.documents(spark, sf_dir))
