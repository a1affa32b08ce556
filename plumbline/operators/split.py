"""Documents of any length, split into their components while they are read.

A document comes as pieces of text in order, of which one is held at a time. Its
components lists, at the top or within wrappers, are handed over element by
element; the rest, its shell, is handed over as one short text in which the
number of each list stands for its elements. Spark's parser reads the shell and
every element, so what is valid is decided by the same rules as for a whole text.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator

#: Wrappers that are looked into, as many as `shred.parse` peels.
WRAPPERS = 8
#: Characters that are read on at least where a value does not end in the pieces held.
AHEAD = 1 << 16

_SPACE = re.compile(r"[ \t\n\r]*")


def finite(text: str) -> float:
    x = float(text)
    return x if math.isfinite(x) else 0.5  # beyond the range of a double; no fraction is read anywhere


_DECODER = json.JSONDecoder(parse_float=finite)


def _cut_off(error: Exception, size: int) -> bool:
    """Whether a value of a text of this size may go on beyond it."""
    return isinstance(error, json.JSONDecodeError) and (error.msg.startswith("Unterminated string") or error.pos >= size - 16)


class Split:
    """Splits one document: iterate `elements()`, then ask for `shell`. A ValueError tells that the text is no JSON."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces = iter(pieces)
        self.text, self.at, self.done = "", 0, False
        self.out: list[str] = []
        self.lists = 0

    def _more(self) -> bool:
        """Reads on, by as much again as is held, so that a long value is not begun too often."""
        want = max(AHEAD, len(self.text) - self.at)
        held, size = [self.text[self.at :]], 0
        while size < want:
            piece = next(self.pieces, None)
            if piece is None:
                self.done = True
                break
            held.append(piece)
            size += len(piece)
        self.text, self.at = "".join(held), 0
        return size > 0

    def _peek(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if self.done or not self._more():
                return ""

    def _value(self):
        """The value here and its text, wholly read."""
        self._peek()
        while True:
            try:
                value, end = _DECODER.raw_decode(self.text, self.at)
                # A number at the end of what is held may go on.
                if end < len(self.text) or self.done:
                    text, self.at = self.text[self.at : end], end
                    return value, text
            except (ValueError, RecursionError) as e:
                if self.done or not _cut_off(e, len(self.text)):
                    raise ValueError("no JSON") from None
            self._more()

    def _take(self, *expected: str) -> str:
        c = self._peek()
        if c not in expected or not c:
            raise ValueError("no JSON")
        self.at += 1
        return c

    def _list(self, number: int) -> Iterator[tuple[int, object, str]]:
        """(list, value, text) of the elements of a components list."""
        self._take("[")
        self.out.append(f"[{number}]")
        if self._peek() == "]":
            self.at += 1
            return
        while True:
            yield number, *self._value()
            if self._take(",", "]") == "]":
                return

    def _any(self, depth: int) -> Iterator[tuple[int, object, str]]:
        """The value here, which may be the document or a wrapper of it."""
        c = self._peek()
        if depth > WRAPPERS or c not in ("{", "["):
            self.out.append(self._value()[1])
            return
        self.at += 1
        self.out.append(c)
        close, first = "}" if c == "{" else "]", True
        if self._peek() == close:
            self.at += 1
            self.out.append(close)
            return
        while True:
            if c == "{":
                if self._peek() != '"':
                    raise ValueError("no JSON")
                key, text = self._value()
                self._take(":")
                self.out.append(text + ":")
                if key == "components" and self._peek() == "[":
                    self.lists += 1
                    yield from self._list(self.lists - 1)
                elif key == "bom":
                    yield from self._any(depth + 1)
                else:
                    self.out.append(self._value()[1])
            elif first:
                yield from self._any(depth + 1)
            else:
                self.out.append(self._value()[1])
            first = False
            end = self._take(",", close)
            self.out.append(end)
            if end == close:
                return

    def elements(self) -> Iterator[tuple[int, object, str]]:
        """(number of the list, value, text) of every element of the components lists. As Spark's parser does, it ignores what follows the document."""
        yield from self._any(0)

    @property
    def shell(self) -> str:
        return "".join(self.out)
