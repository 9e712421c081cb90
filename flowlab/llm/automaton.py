"""Deterministic automaton over bytes for a set of regular expressions.

``Automaton`` parses each rule, joins them in one non-deterministic automaton
that may start anywhere, determinises it (subset construction over byte
classes) and minimises it (partition refinement).  The result is a table
``next[state, class]`` with the rules accepted in each state.

``Automaton.scan`` reads every byte once.  Many stretches of the text advance
in step: a stretch may begin wherever the last three byte classes lead every
state to the same one, so its first state is known without the text before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

EVERY = frozenset(range(256))


@dataclass(frozen=True)
class Rule:
    """``check`` runs on a found span (full match needed); None accepts it."""
    name: str
    pattern: str
    ignore_case: bool = False
    min_length: int = 0
    group: int = 0           # the group that min_length measures

    def holds(self, span: bytes) -> bool:
        m = re.fullmatch(self.pattern.encode(), span, re.IGNORECASE if self.ignore_case else 0)
        return m is not None and len(m.group(self.group)) >= self.min_length


# ---------------------------------------------------------------- patterns

class Pattern:
    """A pattern as nested tuples: ("set", bytes), ("cat", parts), ("or",
    branches), ("repeat", part, least, most or None).  Literals, escapes, ``.``,
    classes, groups, alternatives and greedy repeats are known; anything else
    raises ValueError."""

    def __init__(self, pattern: str, ignore_case: bool = False):
        self.text, self.at, self.fold = pattern, 0, ignore_case
        self.tree = self._branches()
        if self.at < len(pattern):
            raise ValueError(f"unmatched ) in {pattern!r}")

    def _peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def _take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def _branches(self):
        out = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            out.append(self._sequence())
        return out[0] if len(out) == 1 else ("or", out)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeats(self._atom()))
        return ("cat", parts)

    def _atom(self):
        ch = self._take()
        if ch == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            elif self._peek() == "?":
                raise ValueError(f"unsupported group in {self.text!r}")
            inner = self._branches()
            if self._take() != ")":
                raise ValueError(f"missing ) in {self.text!r}")
            return inner
        if ch == "[":
            return ("set", self._class())
        if ch == ".":
            return ("set", EVERY - {10})
        if ch in "*+?{^$":
            raise ValueError(f"unsupported {ch} in {self.text!r}")
        return ("set", self._folded({self._escape() if ch == "\\" else ord(ch)}))

    def _escape(self) -> int:
        ch = self._take()
        if ch == "x":
            return int(self._take() + self._take(), 16)
        if ch in "tnrfv":
            return {"t": 9, "n": 10, "r": 13, "f": 12, "v": 11}[ch]
        if ch.isalnum():
            raise ValueError(f"unsupported escape {ch} in {self.text!r}")
        return ord(ch)

    def _class(self) -> frozenset[int]:
        negate = self._peek() == "^"
        self.at += negate
        out, first = set(), True
        while first or self._peek() != "]":
            first, low = False, self._member()
            if self._peek() == "-" and self.text[self.at + 1:self.at + 2] != "]":
                self.at += 1
                out.update(range(low, self._member() + 1))
            else:
                out.add(low)
        self.at += 1
        out = self._folded(out)
        return EVERY - out if negate else out

    def _member(self) -> int:
        ch = self._take()
        return self._escape() if ch == "\\" else ord(ch)

    def _folded(self, members: set[int]) -> frozenset[int]:
        if max(members) > 127:
            raise ValueError(f"a rule's characters are ASCII: {self.text!r}")
        if self.fold:
            members = members | {ord(chr(b).swapcase()) for b in members if chr(b).isalpha()}
        return frozenset(members)

    def _repeats(self, part):
        while self._peek() and self._peek() in "*+?{":
            ch = self._take()
            if ch == "{":
                stop = self.text.index("}", self.at)
                low, comma, high = self.text[self.at:stop].partition(",")
                self.at = stop + 1
                least, most = int(low), int(low) if not comma else int(high) if high else None
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[ch]
            if self._peek() and self._peek() in "?+":
                raise ValueError(f"unsupported kind of repeat in {self.text!r}")
            part = ("repeat", part, least, most)
        return part


# ---------------------------------------------------------------- automata

class _Nfa:
    """Thompson construction; ``backwards`` reads the pattern from its end."""

    def __init__(self, backwards: bool = False):
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.backwards = backwards

    def state(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def add(self, tree, at: int) -> int:
        """Append a pattern after state ``at``; the state after it."""
        if tree[0] == "set":
            to = self.state()
            self.moves[at].append((tree[1], to))
            return to
        if tree[0] == "cat":
            for part in reversed(tree[1]) if self.backwards else tree[1]:
                at = self.add(part, at)
            return at
        if tree[0] == "or":
            end = self.state()
            for branch in tree[1]:
                begin = self.state()
                self.eps[at].append(begin)
                self.eps[self.add(branch, begin)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            at = self.add(part, at)
        if most is None:
            begin = self.state()
            self.eps[at].append(begin)
            self.eps[self.add(part, begin)].append(begin)
            return begin
        end = self.state()
        for _ in range(most - least):
            self.eps[at].append(end)
            at = self.add(part, at)
        self.eps[at].append(end)
        return end

    def closures(self) -> list[int]:
        """Bits of the states that each state reaches without a byte."""
        out = []
        for s in range(len(self.eps)):
            seen, todo = 1 << s, [s]
            while todo:
                for t in self.eps[todo.pop()]:
                    if not seen >> t & 1:
                        seen |= 1 << t
                        todo.append(t)
            out.append(seen)
        return out

    def classes(self) -> np.ndarray:
        """Byte -> class; bytes that no transition tells apart share one."""
        sets = sorted({s for m in self.moves for s, _ in m}, key=sorted)
        keys: dict[tuple[bool, ...], int] = {}
        return np.array([keys.setdefault(tuple(b in s for s in sets), len(keys)) for b in range(256)], np.uint8)

    def determinise(self, start: int, accept: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class of byte, next[state, class], accepted rule bits); state 0 is
        the start.  A set of states is the bits of one number."""
        cls, reach = self.classes(), self.closures()
        sample = [int(np.flatnonzero(cls == c)[0]) for c in range(int(cls.max()) + 1)]
        # by state: what it reaches on each class, and on all classes alike
        always, some = [0] * len(reach), [[] for _ in reach]
        for s, moves in enumerate(self.moves):
            for on, t in moves:
                if len(on) == 256:
                    always[s] |= reach[t]
                else:
                    some[s] += [(c, reach[t]) for c, byte in enumerate(sample) if byte in on]
        number, todo, rows, bits = {reach[start]: 0}, [reach[start]], [], []
        for now in todo:                    # grows while it is read
            row, mask, rest, accepted = [0] * len(sample), 0, now, 0
            while rest:
                s = (rest & -rest).bit_length() - 1
                rest &= rest - 1
                mask |= always[s]
                accepted |= 1 << accept[s] if s in accept else 0
                for c, to in some[s]:
                    row[c] |= to
            row = [r | mask for r in row]
            for to in row:
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
            rows.append([number[to] for to in row])
            bits.append(accepted)
        return cls, np.array(rows, np.int32), np.array(bits, np.int64)


def minimise(table: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart (partition refinement); the start
    stays state 0.  Rows are told apart by a random sum each, and by themselves
    once the sums find nothing more."""
    _, block = np.unique(bits, return_inverse=True)
    weights = np.random.default_rng(1).integers(1, 2 ** 63, table.shape[1] + 1, dtype=np.uint64)
    while True:
        rows = np.column_stack([block, block[table]]).astype(np.uint64)
        new = np.unique(rows @ weights, return_inverse=True)[1].reshape(-1)
        if new.max() == block.max():
            new = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == block.max():
                break
        block = new
    rank = np.full(block.max() + 1, -1)
    for b in block:                       # number the blocks by first appearance
        if rank[b] < 0:
            rank[b] = rank.max() + 1
    block = rank[block]
    n = block.max() + 1
    first = np.array([np.flatnonzero(block == b)[0] for b in range(n)])
    return block[table[first]].astype(np.int32), bits[first]


class Automaton:
    STRETCH = 6                 # a stretch begins in every 2**6 bytes where one can
    SLICE = 4 << 20             # bytes whose classes are held at once
    FEW = 16                    # stretches left that are walked one by one

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        nfa = _Nfa()
        start = nfa.state()
        nfa.moves[start].append((EVERY, start))
        accept = {}
        for k, rule in enumerate(rules):
            begin = nfa.state()
            nfa.eps[start].append(begin)
            accept[nfa.add(Pattern(rule.pattern, rule.ignore_case).tree, begin)] = k
        self.cls, table, bits = nfa.determinise(start, accept)
        table, bits = minimise(table, bits)
        self.table, self.bits, self.n_classes = table, bits, table.shape[1]
        self.flat = np.ascontiguousarray(table.reshape(-1))
        self.known = self._known()
        self.back = [self._single(r, True) for r in rules]
        self.ahead = [self._single(r, False) for r in rules]

    def _known(self) -> np.ndarray:
        """State after three byte classes where it is the same from any state, else -1."""
        c, t = self.n_classes, self.table
        out = np.full((c, c, c), -1, np.int16)
        for x in range(c):
            one = np.unique(t[:, x])
            for y in range(c):
                two = np.unique(t[one, y])
                three = t[two]
                same = (three == three[0]).all(axis=0)
                out[x, y, same] = three[0, same]
        return out.reshape(-1)

    @staticmethod
    def _single(rule: Rule, backwards: bool):
        """One rule alone: from the end of a string backwards, or forwards from
        any start; (classes, table, accepts, dead states)."""
        nfa = _Nfa(backwards)
        start = nfa.state()
        if not backwards:
            nfa.moves[start].append((EVERY, start))
        end = nfa.add(Pattern(rule.pattern, rule.ignore_case).tree, start)
        cls, table, bits = nfa.determinise(start, {end: 0})
        dead = np.array([(table[s] == s).all() and not bits[s] for s in range(len(table))])
        return cls.tolist(), table.tolist(), bits.tolist(), dead.tolist()

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the last byte of every accepted string, and the rules
        accepted there (bits); ``bounds`` are the borders of the documents."""
        found, masks = [], []
        bounds = np.unique(bounds)
        at, end, state = int(bounds[0]), int(bounds[-1]), 0
        while at < end:
            to = min(end, at + self.SLICE)
            inner = bounds[(bounds > at) & (bounds < to)]
            pos, mask, state = self._slice(data[at:to], inner - at, state)
            found.append(pos + at)
            masks.append(mask)
            if np.searchsorted(bounds, to) < len(bounds) and bounds[np.searchsorted(bounds, to)] == to:
                state = 0
            at = to
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(masks)

    def _slice(self, data, borders, state):
        cls, n, c = self.cls[data], len(data), self.n_classes
        starts, states = np.concatenate([[0], borders]).astype(np.int64), np.zeros(len(borders) + 1, np.int32)
        states[0] = state
        if n > 3:
            code = cls[:-2].astype(np.int32)
            code *= c
            code += cls[1:-1]
            code *= c
            code += cls[2:]
            known = self.known[code]
            first = np.flatnonzero(known >= 0)
            block = (first + 3) >> self.STRETCH
            first = first[np.concatenate([[True], block[1:] != block[:-1]])] if len(first) else first
            first = first[first + 3 < n]
            same = np.searchsorted(starts, first, "right") == np.searchsorted(starts, first + 3, "right")
            first = first[same]
            both = np.concatenate([starts, first + 3])
            states = np.concatenate([states, known[first].astype(np.int32)])
            starts, pick = np.unique(both, return_index=True)
            states = states[pick]
        lengths = np.diff(np.append(starts, n))
        order = np.argsort(-lengths, kind="stable")
        starts, states, lengths = starts[order], states[order], lengths[order]
        last = int(np.argmax(starts))
        alive = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right")
        found, masks = [], []
        for step, k in enumerate(alive):
            if k <= self.FEW:                           # the rest of a few long stretches, one by one
                for j in range(k):
                    at = int(starts[j]) + step
                    states[j], pos, bits = self._walk(cls[at:int(starts[j] + lengths[j])], int(states[j]))
                    found.append(np.array(pos, np.int64) + at)
                    masks.append(np.array(bits, np.int64))
                break
            pos = starts[:k] + step
            now = self.flat[states[:k] * c + cls[pos]]
            states[:k] = now
            bits = self.bits[now]
            hit = np.flatnonzero(bits)
            if len(hit):
                found.append(pos[hit])
                masks.append(bits[hit])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), int(states[last])
        pos, mask = np.concatenate(found), np.concatenate(masks)
        order = np.argsort(pos, kind="stable")
        return pos[order], mask[order], int(states[last])

    @cached_property
    def _lists(self) -> tuple[list[list[int]], list[int]]:
        return self.table.tolist(), self.bits.tolist()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lists"}       # a worker makes its own

    def _walk(self, cls: np.ndarray, state: int) -> tuple[int, list[int], list[int]]:
        """State after the bytes, and where (and what) they accept."""
        table, accepts = self._lists
        pos, bits = [], []
        for i, c in enumerate(cls.tolist()):
            state = table[state][c]
            if accepts[state]:
                pos.append(i)
                bits.append(accepts[state])
        return state, pos, bits

    def begin(self, k: int, text: bytes, last: int, least: int) -> int | None:
        """Smallest start >= ``least`` of a string of rule k that ends with byte ``last``."""
        cls, table, bits, dead = self.back[k]
        state, best = 0, None
        for i in range(last, least - 1, -1):
            state = table[state][cls[text[i]]]
            if bits[state]:
                best = i
            elif dead[state]:
                break
        return best

    def spans(self, text: bytes, ends: np.ndarray, masks: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) of the leftmost non-overlapping matches of every
        rule, from the accepted ends of one document.  Rules end in a repeated
        class or a fixed string, so a match goes on to the end of its run.

        A run whose first end belongs to a string that began in the match
        before is read once more, forwards from that match, by the rule alone;
        such a pass goes on where the last one stopped, so a text is read at
        most twice a rule."""
        out = []
        for k, rule in enumerate(self.rules):
            mine = ends[(masks >> k) & 1 == 1]
            if not len(mine):
                continue
            cls, table, bits, _ = self.ahead[k]
            taken, at, state = 0, 0, 0
            for run in np.split(mine, np.flatnonzero(np.diff(mine) != 1) + 1):
                first, stop = int(run[0]), int(run[-1]) + 1
                start = self.begin(k, text, first, taken)
                if start is None:
                    at, state = max((at, state), (taken, 0), key=lambda p: p[0])
                    while at < stop and (at <= first or not bits[state]):
                        state = table[state][cls[text[at]]]
                        at += 1
                    if at <= first or not bits[state]:
                        continue
                    start = self.begin(k, text, at - 1, taken)
                if start is not None:
                    taken, at, state = stop, stop, 0
                    if rule.holds(text[start:stop]):
                        out.append((start, k, stop))
        return sorted(out)


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Automaton:
    """The automaton of a rule set, built once a session."""
    return Automaton(list(rules))
