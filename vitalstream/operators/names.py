"""Names of known people in texts, replaced by labels in one pass.

A name is a run of words: `First Last` or `Last, First`. A text is a chain of words; every run of as many words as some name
has is looked up, so the work follows the text and its matches, not the number of people. What is found is replaced in label
order; a label's own words join the chain, so they can be part of a later name, and only the runs that they touch are looked
up anew.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from functools import lru_cache

WORD = re.compile(r"\w+")
#: What may stand between the two parts of a name, by form.
BETWEEN = (re.compile(r"\s+").fullmatch, re.compile(r"\s*,\s*").fullmatch)
Person = tuple[int, str, str, str]


def words_of(text: str) -> tuple[str, ...]:
    return tuple(w.casefold() for w in WORD.findall(text))


def forms(first: str, last: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The words of `First Last` and of `Last, First`."""
    return words_of(f"{first} {last}"), words_of(f"{last}, {first}")


@lru_cache(100_000)
def _pattern(first: str, last: str, form: int) -> re.Pattern:
    a, b = re.escape(first), re.escape(last)
    return re.compile((rf"\b{a}\s+{b}\b", rf"\b{b}\s*,\s*{a}\b")[form], re.I)


class Names:
    """Known people by the words of their names. people: (number, first, last, label); of several people whose names are
    equal but for case the one with the smallest number counts. lengths: the numbers of words to look up, where these people
    are only a part of those known; made then has the runs that labels have made, and that were looked up."""

    def __init__(self, people: Iterable[Person], lengths: list[int] | None = None):
        self.index: dict[tuple[str, ...], list[tuple[int, int, str, str, str]]] = {}
        seen: set[tuple[str, str]] = set()
        for no, first, last, label in sorted(people):
            if (name := (first.lower(), last.lower())) in seen:
                continue
            seen.add(name)
            for form, words in enumerate(forms(first, last)):
                if words:
                    self.index.setdefault(words, []).append((no, form, first, last, label))
        self.lengths = lengths or sorted({len(words) for words in self.index})
        self.begin = {words[0] for words in self.index}
        self.made: set[tuple[str, ...]] = set()

    def redact(self, text: str) -> str:
        """text with all names replaced, the smallest number first; of one person first all `First Last`, from the left."""
        return text if self.begin.isdisjoint(words_of(text)) else _Chain(text, self).redacted()

    def runs(self, text: str) -> set[tuple[str, ...]]:
        """All runs of words of text that a name could be."""
        words = words_of(text)
        return {words[i : i + n] for n in self.lengths for i in range(len(words) - n + 1)}


class _Chain:
    """The words of a text with what stands before each of them, linked, so that a replacement costs its own length only."""

    def __init__(self, text: str, names: Names):
        self.names = names
        self.word: list[str] = [""]  # node 0 stands for both ends
        self.folded: list[str] = [""]
        self.gap: list[str] = [""]
        self.place: list[tuple[int, ...]] = [()]
        self.after: list[int] = [0]
        self.before: list[int] = [0]
        self.waiting: list[tuple] = []
        self.insert(0, 0, text, ())
        self.look_up(self.after[0], 0, (-1, 0))

    def insert(self, left: int, right: int, text: str, place: tuple[int, ...]) -> int:
        """Put the words of text between two nodes; what is left over of it goes before the right one."""
        at, no = 0, 0
        for m in WORD.finditer(text):
            self.word.append(m[0])
            self.folded.append(m[0].casefold())
            self.gap.append(text[at : m.start()])
            self.place.append((*place, no))
            self.before.append(left)
            self.after.append(right)
            self.after[left] = new = len(self.word) - 1
            left, at, no = new, m.end(), no + 1
        self.before[right] = left
        self.gap[right] = text[at:] if not right else text[at:] + self.gap[right]
        return left

    def look_up(self, start: int, stop: int, done: tuple[int, int]) -> None:
        """Note the names that begin at the nodes from start up to stop, of later turns than done (number, form)."""
        node, index, longest = start, self.names.index, self.names.lengths[-1]
        while node != stop:
            if done[0] < 0 and self.folded[node] not in self.names.begin:
                node = self.after[node]
                continue
            run, at = [], node
            while at and len(run) < longest:
                run.append(self.folded[at])
                at = self.after[at]
            for n in self.names.lengths:
                if n > len(run):
                    break
                if done[0] >= 0:
                    self.names.made.add(tuple(run[:n]))
                for person in index.get(tuple(run[:n]), ()):
                    if person[:2] > done:
                        heapq.heappush(self.waiting, (*person[:2], self.place[node], node, n, person))
            node = self.after[node]

    def nodes(self, node: int, n: int) -> list[int]:
        out = []
        while node and len(out) < n:
            out.append(node)
            node = self.after[node]
        return out

    def redacted(self) -> str:
        while self.waiting:
            no, form, _, node, n, (_, _, first, last, label) = heapq.heappop(self.waiting)
            run = self.nodes(node, n)
            # A node that has been replaced, or whose neighbours have, no longer spells the name from here.
            if self.after[self.before[node]] != node or len(run) < n or self.word[node] == "":
                continue
            left, right = self.before[node], self.after[run[-1]]
            if n == 2 and first.isascii() and last.isascii() and len(first) + len(last) == len(self.word[node]) + len(self.word[run[1]]):
                # Two plain words, the usual case: only what stands between them is left to see.
                if BETWEEN[form](self.gap[run[1]]):
                    self.replace(run, left, right, self.gap[node], label, self.gap[right], (no, form))
                continue
            lead = self.word[left][-1:] + self.gap[node]
            tail = self.gap[right] + (self.word[right][:1] if right else "")
            local = lead + self.word[node] + "".join(self.gap[x] + self.word[x] for x in run[1:]) + tail
            found = next((m for m in _pattern(first, last, form).finditer(local) if m.start() <= len(lead) and m.end() >= len(local) - len(tail)), None)
            if not found:
                continue
            self.replace(run, left, right, lead[: found.start()][len(self.word[left][-1:]) :], label, local[found.end() :][: max(0, len(self.gap[right]) - (found.end() - len(local) + len(tail)))], (no, form))
        out, node = [], self.after[0]
        while node:
            out += [self.gap[node], self.word[node]]
            node = self.after[node]
        return "".join([*out, self.gap[0]])

    def replace(self, run: list[int], left: int, right: int, lead: str, label: str, tail: str, done: tuple[int, int]) -> None:
        place = self.place[run[0]]
        for x in run:
            self.word[x] = ""
        text = lead + label + tail
        self.gap[right] = ""
        # Where the label touches a word they are one word from now on.
        if left and text[:1] and WORD.match(text):
            text, gone = self.word[left] + text, left
            text, left, place = self.gap[gone] + text, self.before[gone], self.place[gone]
            self.word[gone] = ""
        if right and text and WORD.match(text[-1]):
            text, gone = text + self.word[right], right
            right = self.after[gone]
            text, self.word[gone] = text + self.gap[right], ""
            self.gap[right] = ""
        self.after[left] = right
        self.before[right] = left
        self.insert(left, right, text, place)
        # Runs that reach into what has changed.
        start = left
        for _ in range(self.names.lengths[-1]):
            if start:
                start = self.before[start]
        self.look_up(self.after[start], self.after[right] if right else 0, done)

