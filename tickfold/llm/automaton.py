"""A combined deterministic automaton over bytes: parse, Thompson construction, subset construction, minimisation, transition arrays.

The expressions cover what secret rules need: literals, escapes, character
classes, groups, alternation, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``, and
``(?i:...)`` for ASCII letters in either case.
"""

from __future__ import annotations

import numpy as np


class Parser:
    """Expression to a tree: ('set', frozenset), ('cat', [..]), ('alt', [..]), ('rep', tree, least, most)."""

    def __init__(self, text: str):
        self.text, self.at, self.fold = text, 0, False

    def parse(self):
        tree = self.alternation()
        if self.at != len(self.text):
            raise ValueError(f"unbalanced at {self.at}: {self.text}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternation(self):
        arms = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            arms.append(self.sequence())
        return arms[0] if len(arms) == 1 else ("alt", arms)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                body = self.text[self.at : self.text.index("}", self.at)]
                self.at += len(body) + 1
                low, comma, high = body.partition(",")
                tree = ("rep", tree, int(low), int(high) if high else None if comma else int(low))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def atom(self):
        c = self.take()
        if c == "(":
            before = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.alternation()
            if self.take() != ")":
                raise ValueError(f"a group does not end: {self.text}")
            self.fold = before
            return tree
        if c == "[":
            return ("set", self.folded(self.char_class()))
        if c == "\\":
            return ("set", self.folded({self.escape()}))
        return ("set", self.folded({ord(c)}))

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {ord(f(chr(c))) for c in chars if chr(c).isascii() and chr(c).isalpha() for f in (str.lower, str.upper)}
        return frozenset(chars)

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class(self) -> set[int]:
        negated = self.peek() == "^"
        self.at += negated
        chars: set[int] = set()
        while True:
            c = self.take()
            if c == "]":
                break
            low = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                c = self.take()
                high = self.escape() if c == "\\" else ord(c)
                chars |= set(range(low, high + 1))
            else:
                chars.add(low)
        return set(range(256)) - chars if negated else chars


class Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.chains: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """Build tree from start on; returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for arm in tree[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(arm, begin)].append(end)
            return end
        _, part, least, most = tree
        chain = []
        for _ in range(least):
            start = self.add(part, start)
            chain.append(start)
        if most is None:
            if part[0] == "set":
                self.chains.append(chain)
            loop, end = self.state(), self.state()
            self.free[start] += [loop, end]
            self.free[self.add(part, loop)] += [loop, end]
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end

    def leading(self, states: frozenset[int], last: set[int]) -> frozenset[int]:
        """Without the states of a final counted run that a state further along the same run makes superfluous: both live on the same bytes and the further one accepts first."""
        drop: set[int] = set()
        for chain in self.chains:
            if chain and chain[-1] in last:
                there = [s for s in chain if s in states]
                drop.update(there[:-1])
        return states - drop if drop else states

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Minimal automaton for several rules at once.

    ``step[s * width + kind[b]]`` is the next state's row offset ``t * width``;
    ``accepts[s]`` has a bit for each rule that ends in s. With ``anywhere``
    a match may begin at any byte; else only at the first, and state ``dead``
    is the one nothing leads out of.
    """

    def __init__(self, rules: list[str], anywhere: bool):
        nfa = Nfa()
        root, ends, last = nfa.state(), {}, set()
        used: set[int] = set()
        for k, rule in enumerate(rules):
            begin = nfa.state()
            nfa.free[root].append(begin)
            ends[nfa.add(Parser(rule).parse(), begin)] = 1 << k
            last.update(c[-1] for c in nfa.chains[-1:] if c and rule.endswith(("}", "+")))
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        kinds: dict[tuple[bool, ...], int] = {}
        self.kind = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], "u1")
        used.update(*sets)
        self.resets = np.array([b not in used for b in range(256)])
        sample = [int(np.flatnonzero(self.kind == k)[0]) for k in range(len(kinds))]
        first = nfa.closure([root])
        number, todo, table = {first: 0}, [first], []
        for now in todo:
            row = []
            for b in sample:
                to = {t for s in now for chars, t in nfa.moves[s] if b in chars}
                after = nfa.leading(nfa.closure(to | ({root} if anywhere else set())), last)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after])
            table.append(row)
        accepts = [sum(v for s, v in ends.items() if s in now) for now in todo]
        self._minimise(table, accepts, number.get(frozenset()))

    def _minimise(self, table, accepts, dead) -> None:
        """Moore's refinement; states are then ordered with the accepting ones last."""
        array = np.array(table)
        block = np.unique(np.array(accepts), return_inverse=True)[1].reshape(-1)
        while True:
            rows = np.column_stack([block, block[array]])
            finer = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        block = block.tolist()
        one = {b: s for s, b in reversed(list(enumerate(block)))}
        order = sorted(one, key=lambda b: (accepts[one[b]] != 0, b))
        place = {b: i for i, b in enumerate(order)}
        self.width = len(table[0])
        self.step = np.array([[place[block[t]] * self.width for t in table[one[b]]] for b in order], "i4").ravel()
        self.accepts = [accepts[one[b]] for b in order]
        self.start = place[block[0]] * self.width
        self.dead = None if dead is None else place[block[dead]] * self.width
        self.ahead = self._ahead()
        self.hit_from = next((i for i, a in enumerate(self.accepts) if a), len(order)) * self.width

    def _ahead(self) -> list[int]:
        """For each state the rules that it or some state after it accepts."""
        to = self.step.reshape(-1, self.width) // self.width
        bits = np.array(self.accepts, "i8")
        while True:
            more = bits | np.bitwise_or.reduce(bits[to], axis=1)
            if (more == bits).all():
                return bits.tolist()
            bits = more

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match from at on, or -1."""
        s, end, step, kind = self.start, -1, self._step_list, self._kind_list
        for i in range(at, len(data)):
            s = step[s + kind[data[i]]]
            if s == self.dead:
                break
            if s >= self.hit_from:
                end = i + 1
        return end

    def prepare(self) -> Dfa:
        """Plain lists for the byte-wise walks; small arrays index faster as lists."""
        self._step_list, self._kind_list = self.step.tolist(), self.kind.tolist()
        return self

    def hits(self, data: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Numbers of the chunks of data in which some rule ends: one pass over the bytes, all chunks in lockstep.

        Each chunk is first taken to begin in the start state. Where the chunk
        before it really ends elsewhere, it is walked again from there, until no
        chunk's entry changes; so the result is that of one walk from left to right.
        """
        n = -(-len(data) // chunk)
        kinds = np.zeros(n * chunk, "u1")
        kinds[: len(data)] = self.kind[data]
        kinds = np.ascontiguousarray(kinds.reshape(n, chunk).T)
        entry = np.full(n, self.start, "i4")
        leave, top = np.empty(n, "i4"), np.empty(n, "i4")
        todo = np.arange(n)
        while len(todo):
            now = entry[todo]
            best = np.zeros(len(todo), "i4")
            whole = len(todo) == n
            for row in kinds:
                now = self.step[now + (row if whole else row[todo])]
                np.maximum(best, now, out=best)
            leave[todo], top[todo] = now, best
            after = todo[todo < n - 1] + 1
            todo = after[leave[after - 1] != entry[after]]
            entry[todo] = leave[todo - 1]
        return np.flatnonzero(top >= self.hit_from)
