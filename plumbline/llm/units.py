"""Cuts texts into units that a byte-level BPE tokenizer encodes independently.

The tokenizers' pattern always ends a match before a single space or line feed
that stands between two characters that are no white space, and what it matches
from there on never depends on what came before. So a text may be cut at each
such place; the ids of the pieces, concatenated, are the ids of the text. Line
feeds are cut at only in texts in which every one of them stands so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Python's \s is a superset of the tokenizers' white space, so no cut is made too many.
CUT = re.compile(r"(?<=\S)(?= \S)")
_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts in which some space touches other white space, or an end of the text.
IRREGULAR = rf"(?s)\A | \z|[{_WS}] | [{_WS}]"
#: The same for line feeds.
IRREGULAR_LINES = rf"(?s)\A\n|\n\z|[{_WS}]\n|\n[{_WS}]"


def chunks(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Regroups batches into tables of about `limit` bytes of text, a row at least."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths):
            size += int(n) + 16
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def unitize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """(codes, units a text, vocabulary): the text of row i is the join of vocabulary[c] for its codes c.

    Null is an empty text. The vocabulary holds every distinct unit once.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~odd))
    lines = pc.and_(pc.match_substring(plain, "\n"), pc.invert(pc.match_substring_regex(plain, IRREGULAR_LINES)))
    parts = pc.split_pattern(pc.if_else(lines, pc.replace_substring(plain, "\n", " \n"), plain), " ")
    values = [parts.flatten()]
    counts = np.zeros(len(texts), np.int64)
    counts[~odd] = pc.list_value_length(parts).to_numpy(zero_copy_only=False) if len(plain) else 0
    order = [np.flatnonzero(~odd)]
    if odd.any():
        pieces = [CUT.split(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        counts[odd] = [len(p) for p in pieces]
        values.append(pa.array([x[1:] if i else x for p in pieces for i, x in enumerate(p)], pa.large_string()))
        order.append(np.flatnonzero(odd))
    rows = np.concatenate(order)
    encoded = pa.concat_arrays([v.cast(pa.large_string()) for v in values]).dictionary_encode()
    raw = encoded.indices.to_numpy(zero_copy_only=False)
    by_row = counts[rows]
    first = np.zeros(len(raw), bool)
    starts = np.concatenate([[0], np.cumsum(by_row)[:-1]]) if len(rows) else np.zeros(0, np.int64)
    first[starts[by_row > 0]] = True
    words = encoded.dictionary
    # A part keeps the space before it, but for a text's first one and those that begin with a cut line feed.
    bare = first | pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)[raw]
    wide = raw * 2 + ~bare
    seen = np.zeros(2 * len(words), bool)
    seen[wide] = True
    used, codes = np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - np.int32(1))[wide]
    prefix = pa.array(["", " "], pa.large_string()).take(pa.array(used & 1))
    vocabulary = pc.binary_join_element_wise(prefix, words.take(pa.array(used >> 1)), pa.scalar("", pa.large_string()))
    if odd.any():  # a text may begin with a space of its own; and back to the order of the rows
        unique = vocabulary.dictionary_encode()
        codes, vocabulary = unique.indices.to_numpy(zero_copy_only=False)[codes], unique.dictionary
        at = np.empty(len(texts), np.int64)
        at[rows] = starts
        codes = codes[ranges(at, counts)]
    return codes, counts, vocabulary


def strings_of(values: pa.LargeStringArray) -> list[str]:
    """`values.to_pylist()` for an array without nulls, cut from its buffers."""
    _, offsets, data = values.buffers()
    if not len(values):
        return []
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)]


class Memory:
    """Remembers what has been made of strings: numbers of any count a string."""

    def __init__(self) -> None:
        self.seen, self.flat, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def lookup(self, strings: pa.LargeStringArray, make) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all distinct `strings`, one after another; numbers a string); `make` gives both for those not remembered.

        Afterwards the memory holds these strings and no others.
        """
        at = pc.index_in(strings, value_set=self.seen)
        old = pc.is_valid(at).to_numpy(zero_copy_only=False)
        fresh = strings.filter(pa.array(~old))
        flat, sizes = make(fresh)
        place = np.empty(len(strings), np.int64)
        place[old], place[~old] = at.drop_null().to_numpy(zero_copy_only=False), len(self.sizes) + np.arange(len(fresh))
        flat, sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        out = gather(flat, starts_of(sizes), sizes, place), sizes[place]
        self.seen, self.flat, self.sizes = strings, *out
        return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def layout_of(values: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, length) of the strings of an array without nulls."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def strings_from(flat: np.ndarray, lengths: np.ndarray) -> pa.LargeStringArray:
    """The strings whose UTF-8 bytes follow each other in `flat`."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat)))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each code's items begin when the items of all codes follow one another."""
    return np.cumsum(lengths) - lengths


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The items of `codes`, in order; `flat` holds the items of each code at its start."""
    return flat[ranges(starts[codes], lengths[codes])]
