"""Generalised LR parsing of role sequences with weighted repairs.

A grammar becomes a table of SLR actions; a place may hold several, and all are followed. Stacks share their
lower parts: a node is a state and the node below it, and equal nodes are one. Reading a row, every top is
continued by each edit that the row allows, inserted roles are added until nothing gets cheaper, and paths
that reach the same top are merged to the least (cost, audit, roles). Of two paths that read the same rows at
the same cost, neither audit begins with the other one, so the merge keeps the least audit of the whole.

A row is one character: the initial of its role, ``?`` for any other role, in upper case if keeping the row
costs one more, or ``-`` for a row that must go.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

END = "$"
OTHER, MUST_GO, SPOILED_OTHER = "?", "-", "!"
Path = tuple[int, str, str]
Tops = dict[int, Path]


@dataclass(frozen=True)
class Grammar:
    """Rules as (name, symbols); the first name is the start. Symbols that are no name are role initials."""

    rules: tuple[tuple[str, tuple[str, ...]], ...]
    inserted: str = "ua"
    delete_cost: int = 3
    insert_cost: int = 2
    rerole_cost: int = 2
    spoiled_cost: int = 1

    @property
    def names(self) -> set[str]:
        return {name for name, _ in self.rules}

    @property
    def roles(self) -> set[str]:
        return {s for _, body in self.rules for s in body} - self.names


# Either nothing, or an optional system turn before pairs of a user's and an assistant's turn.
CHAT = Grammar((
    ("chat", ()), ("chat", ("talk",)), ("talk", ("s", "pairs")), ("talk", ("pairs",)),
    ("pairs", ("u", "a")), ("pairs", ("pairs", "u", "a")),
))


def _first_and_follow(grammar: Grammar) -> tuple[dict[str, set], dict[str, set]]:
    """Roles that can begin a symbol ('' if it can be empty), and roles that can come after a name."""
    first = {role: {role} for role in grammar.roles} | {name: set() for name in grammar.names}
    follow: dict[str, set] = {name: set() for name in grammar.names}
    follow[grammar.rules[0][0]].add(END)

    def first_of(symbols) -> set:
        found: set = set()
        for symbol in symbols:
            found |= first[symbol] - {""}
            if "" not in first[symbol]:
                return found
        return found | {""}

    size = -1
    while size != (size := sum(map(len, [*first.values(), *follow.values()]))):
        for name, body in grammar.rules:
            first[name] |= first_of(body)
            for at, symbol in enumerate(body):
                if symbol in follow:
                    rest = first_of(body[at + 1 :])
                    follow[symbol] |= rest - {""} | (follow[name] if "" in rest else set())
    return first, follow


@dataclass
class Parser:
    """The action table of a grammar, and the shared stack nodes met so far."""

    grammar: Grammar
    shifts: dict[tuple[int, str], int] = field(default_factory=dict)
    reduces: dict[tuple[int, str], list[tuple[str, int]]] = field(default_factory=dict)
    accepting: set[int] = field(default_factory=set)
    nodes: list[tuple[int, int]] = field(default_factory=list)
    place: dict[tuple[int, int], int] = field(default_factory=dict)
    moves: dict[tuple[int, str], list[int]] = field(default_factory=dict)
    start: int = 0
    tops: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        rules = [("", (self.grammar.rules[0][0],)), *self.grammar.rules]
        _, follow = _first_and_follow(self.grammar)

        def closed(items: frozenset) -> frozenset:
            found, queue = set(items), list(items)
            while queue:
                rule, dot = queue.pop()
                if dot < len(rules[rule][1]):
                    name = rules[rule][1][dot]
                    new = {(k, 0) for k, (left, _) in enumerate(rules) if left == name} - found
                    found |= new
                    queue += new
            return frozenset(found)

        states = [closed(frozenset({(0, 0)}))]
        for number, items in enumerate(states):
            after: dict[str, set] = {}
            for rule, dot in sorted(items):
                name, body = rules[rule]
                if dot < len(body):
                    after.setdefault(body[dot], set()).add((rule, dot + 1))
                elif not rule:
                    self.accepting.add(number)
                else:
                    for role in follow[name]:
                        self.reduces.setdefault((number, role), []).append((name, len(body)))
            for symbol, kernel in sorted(after.items()):
                target = closed(frozenset(kernel))
                if target not in states:
                    states.append(target)
                self.shifts[number, symbol] = states.index(target)
        self.start = self._node(0, -1)
        self.tops = self._all_tops()

    def _node(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self.place:
            self.place[key] = len(self.nodes)
            self.nodes.append(key)
        return self.place[key]

    def _reduced(self, top: int, role: str) -> set[int]:
        """The top and all tops that reductions lead to when ``role`` comes next."""
        found, queue = {top}, [top]
        while queue:
            node = queue.pop()
            for name, size in self.reduces.get((self.nodes[node][0], role), ()):
                below = node
                for _ in range(size):
                    below = self.nodes[below][1]
                reached = self._node(self.shifts[self.nodes[below][0], name], below)
                if reached not in found:
                    found.add(reached)
                    queue.append(reached)
        return found

    def after(self, top: int, role: str) -> list[int]:
        """Tops after reading a role; none if it cannot come here."""
        key = (top, role)
        if key not in self.moves:
            shifted = [(self.shifts.get((self.nodes[n][0], role)), n) for n in sorted(self._reduced(top, role))]
            self.moves[key] = [self._node(state, n) for state, n in shifted if state is not None]
        return self.moves[key]

    def accepts(self, top: int) -> bool:
        return any(self.nodes[n][0] in self.accepting for n in self._reduced(top, END))

    def _all_tops(self, most: int = 1000) -> list[int]:
        """Every top that any roles lead to; left-recursive grammars have few, others are refused."""
        found, queue = {self.start}, [self.start]
        while queue:
            top = queue.pop()
            for role in sorted(self.grammar.roles):
                for reached in self.after(top, role):
                    if reached not in found:
                        found.add(reached)
                        queue.append(reached)
            if len(found) > most:
                raise ValueError("the stacks of this grammar grow with the conversation; use left recursion")
        return sorted(found)

    def with_inserts(self, tops: Tops) -> Tops:
        """Adds what inserted roles lead to, as long as any top gets a lesser path."""
        queue = list(tops)
        while queue:
            top = queue.pop()
            cost, audit, roles = tops[top]
            for role in self.grammar.inserted:
                path = (cost + self.grammar.insert_cost, audit + "I", roles + role)
                for reached in self.after(top, role):
                    if reached not in tops or path < tops[reached]:
                        tops[reached] = path
                        queue.append(reached)
        return tops

    def read(self, tops: Tops, row: str) -> Tops:
        """All tops after one row, each by its least path."""
        grammar, found = self.grammar, {}

        def reach(top: int, path: Path) -> None:
            if top not in found or path < found[top]:
                found[top] = path

        spoiled = grammar.spoiled_cost if row.isupper() or row == SPOILED_OTHER else 0
        for top, (cost, audit, roles) in tops.items():
            reach(top, (cost + grammar.delete_cost, audit + "D", roles + MUST_GO))
            if row == MUST_GO:
                continue
            for reached in self.after(top, row.lower()):
                reach(reached, (cost + spoiled, audit + "K", roles + row.lower()))
            for role in grammar.inserted:
                for reached in self.after(top, role):
                    reach(reached, (cost + spoiled + grammar.rerole_cost, audit + "R", roles + role))
        return self.with_inserts(found)


SEGMENT = 256
Table = dict[int, Tops]


@lru_cache
def parser_of(grammar: Grammar) -> Parser:
    return Parser(grammar)


@lru_cache(1 << 14)
def _table(grammar: Grammar, rows: str) -> Table:
    """For every top before the rows, the tops after them."""
    parser, table = parser_of(grammar), {}
    for entry in parser.tops:
        tops: Tops = {entry: (0, "", "")}
        for row in rows:
            tops = parser.read(tops, row)
        table[entry] = tops
    return table


def _joined(tops: Tops, table: Table) -> Tops:
    found: Tops = {}
    for top, (cost, audit, roles) in tops.items():
        for reached, (more, letters, further) in table[top].items():
            path = (cost + more, audit + letters, roles + further)
            if reached not in found or path < found[reached]:
                found[reached] = path
    return found


@lru_cache(1 << 16)
def _short(grammar: Grammar, rows: str) -> Path:
    return _repair(grammar, rows)


def _repair(grammar: Grammar, rows: str) -> Path:
    parser = parser_of(grammar)
    tops = parser.with_inserts({parser.start: (0, "", "")})
    if len(rows) <= SEGMENT:
        for row in rows:
            tops = parser.read(tops, row)
    else:
        # Long conversations are joined from tables of segments, in pairs, so no path is copied row by row.
        tables = [_table(grammar, rows[at : at + SEGMENT]) for at in range(0, len(rows), SEGMENT)]
        while len(tables) > 1:
            pairs = zip(tables[::2], tables[1::2])
            odd = tables[-1:] if len(tables) % 2 else []
            tables = [{entry: _joined(tops, right) for entry, tops in left.items()} for left, right in pairs] + odd
        tops = _joined(tops, tables[0])
    return min(path for top, path in tops.items() if parser.accepts(top))


def repair(rows: str, grammar: Grammar = CHAT) -> Path:
    """Least (cost, audit, roles) that makes the rows a sentence: a letter and a role for every edit in order.

    Letters are K(eep), R(erole), D(elete) and I(nsert); the role of a deleted row is ``-``.
    """
    return _short(grammar, rows) if len(rows) <= SEGMENT else _repair(grammar, rows)
