"""A prefix tree of templates: matching as templates learned one by one allow it.

Unlike `match.Catalog`, templates with a common beginning share the wildcards in
it, and with them the classes that those take: a wildcard takes what any of them
was seen with. Inside an edge a wildcard ends where the rest of the edge fits
first and nowhere else, so a line can miss a template that its regular expression
would take; at the beginning of an edge all ends are tried. What a line matches
thus depends on the other templates too. Work for a line is bounded by its length
times the symbols of the trie, for each place is tried once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from logloom.functions.align import WILD, chars
from logloom.operators.match import MAX_COMPILED, Entry, fits, stops


@dataclass
class Edge:
    """Symbols, which are characters and wildcards, and what follows the last of them."""

    label: list[str] = field(default_factory=list)
    classes: list[set[str]] = field(default_factory=list)
    after: dict[str, Edge] = field(default_factory=dict)
    tid: int | None = None

    def shared(self, symbols: list[str]) -> int:
        """How many symbols of the label begin the others."""
        pairs = zip(self.label, symbols, strict=False)
        return next((k for k, (a, b) in enumerate(pairs) if a != b), min(len(self.label), len(symbols)))

    def cut(self, at: int) -> None:
        """Leave `at` symbols here and move the others to an edge of their own."""
        wild = self.label[:at].count(WILD)
        lower = Edge(self.label[at:], self.classes[wild:], self.after, self.tid)
        self.label, self.classes, self.after, self.tid = self.label[:at], self.classes[:wild], {lower.label[0]: lower}, None

    def end(self, text: str, at: int, k: int, known: dict) -> int | None:
        """Where the label from its symbol k on ends in the text from `at` on, if it fits."""
        for j in range(k, len(self.label)):
            if at >= len(text):
                return None  # a wildcard, too, takes a character or meets what ends it
            if self.label[j] == WILD:
                place = (id(self), j, at)
                if place not in known:
                    first = (self.end(text, stop, j + 1, known) for stop in self.stops(text, at, j))
                    known[place] = next((e for e in first if e is not None), None)
                return known[place]
            if self.label[j] != text[at]:
                return None
            at += 1
        return at

    def stops(self, text: str, at: int, k: int) -> list[int]:
        """Where the wildcard that is symbol k may end."""
        follows = set(self.label[k + 1 : k + 2]) or self.after.keys()
        return stops(text, at, self.classes[self.label[:k].count(WILD)], follows)

    def ends(self, text: str, at: int, known: dict) -> Iterator[int]:
        """Ends of the whole label in the order in which they are tried."""
        if self.label[0] != WILD:
            found = [self.end(text, at, 0, known)]
        elif len(self.label) > 1:
            found = (self.end(text, stop, 1, known) for stop in self.stops(text, at, 0))
        else:
            whole = self.tid is not None and fits(text[at:], self.classes[0])
            found = [len(text)] if whole else self.stops(text, at, 0)
        return (e for e in found if e is not None)


class Trie:
    """Templates in the order in which they were learned; of equal ones the last counts.

    A wildcard without classes takes nothing. The trie is sent to executors as its
    entries, which are bounded as a compiled catalog's are.
    """

    def __init__(self, entries: Iterable[Entry] = ()) -> None:
        self.root, self.entries = Edge(), []
        for e in entries:
            self.learn(e)

    def __reduce__(self) -> tuple:
        return Trie, (self.entries,)

    def learn(self, entry: Entry, message: str | None = None) -> None:
        """Add a template. One without literal text is learned as its message, or not at all."""
        if len(self.entries) == MAX_COMPILED:
            raise ValueError(f"a trie holds {MAX_COMPILED} templates at most, use match_join")
        if not entry.template.strip("<>* "):
            if message is None:
                return
            entry = Entry(entry.tid, message, [])
        self.entries.append(entry)
        symbols, classes = chars(entry.template), [set(c) for c in entry.classes]
        classes += [set() for _ in range(symbols.count(WILD) - len(classes))]
        edge = self.root
        while symbols:
            if symbols[0] not in edge.after:
                edge.after[symbols[0]] = Edge(symbols, [set() for c in symbols if c == WILD])
            edge = edge.after[symbols[0]]
            same = edge.shared(symbols)
            if same < len(edge.label):
                edge.cut(same)
            for known, seen in zip(edge.classes, classes, strict=False):
                known |= seen
            symbols, classes = symbols[same:], classes[len(edge.classes) :]
        edge.tid = entry.tid

    def match(self, message: str) -> int:
        """The id of the first template found, characters before wildcards, or -1."""
        known: dict = {}
        tried: set[tuple[int, int]] = set()

        def on(edge: Edge, at: int) -> Iterator[tuple[Edge, int]]:
            lower = [edge.after[s] for s in (message[at], WILD) if s in edge.after]
            return ((e, end) for e in lower for end in e.ends(message, at, known))

        ways = [iter([(self.root, 0)])]
        while ways:
            edge, at = next(ways[-1], (None, 0))
            if edge is None:
                ways.pop()
            elif at == len(message) and edge.tid is not None:
                return edge.tid
            elif at < len(message) and (id(edge), at) not in tried:
                tried.add((id(edge), at))
                ways.append(on(edge, at))
        return -1
