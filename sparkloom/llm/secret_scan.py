"""Secrets in texts by one deterministic automaton for all rules.

The rules' regular expressions are compiled together: the places of their symbols make a non-deterministic automaton,
subset construction a deterministic one, which is then minimised and kept as a transition array over classes of bytes.
All texts of a slice are scanned in one pass of numpy: they are cut into pieces, every piece takes one byte a step, and
pieces whose guessed first state was wrong are run again until they fall in with what was found. Where the automaton
says that a shortest match of a rule ends, the automaton of the rule read backwards finds where matches begin, and the rule's own
automaton how far each reaches: leftmost, longest, without overlaps within a rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, slices

#: Bytes of a piece, and states that an automaton may have; more means that rules with counters should be split.
PIECE = 256
MOST_STATES = 60_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` matches leftmost and longest, and a match is kept if what follows ``head`` has ``least`` bytes.

    Patterns know bytes, ``\\xHH``, escaped signs, ``.``, classes, groups, ``|``, ``?``, ``*``, ``+`` and ``{m,n}``; with ``fold``
    letters A to Z match in either case. Matches that fail are dropped, and the search goes on behind them.
    """

    kind: str
    pattern: str
    head: str = ""
    least: int = 0
    fold: bool = False


ASSIGN_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: A run of hexadecimal digits is matched whole or, if it is shorter than 32, not at all; so the bound can stand in the pattern.
BASE = (
    Rule("assign", ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", ASSIGN_HEAD, 8, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Keys whose issuers mark them by how they begin, keys in armour, and passwords in addresses.
ADDED = (
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]+", r"gh[oprsu]_", 20),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-", 10),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", r"AIza", 35),
    Rule("pay", r"[rs]k_(live|test)_[A-Za-z0-9]+", r"[rs]k_(live|test)_", 16),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("armour", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("address", r"[a-z]+://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*-]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + ADDED


class Places:
    """The symbols of a pattern by their places: which may begin a match, end it, and follow which; sets are bits of integers."""

    def __init__(self, pattern: str, fold: bool, first_place: int = 0) -> None:
        self.text, self.at, self.fold, self.base = pattern, 0, fold, first_place
        self.symbols: list[frozenset[int]] = []
        self.follow: list[int] = []
        self.empty, self.first, self.last = self._either()
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")
        if self.empty:
            raise ValueError(f"{pattern!r} matches nothing at all")

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self) -> tuple[bool, int, int]:
        empty, first, last = self._sequence()
        while self._peek() == "|":
            self.at += 1
            e, f, l = self._sequence()
            empty, first, last = empty or e, first | f, last | l
        return empty, first, last

    def _join(self, a: tuple[bool, int, int], b: tuple[bool, int, int]) -> tuple[bool, int, int]:
        self._link(a[2], b[1])
        return a[0] and b[0], a[1] | (b[1] if a[0] else 0), b[2] | (a[2] if b[0] else 0)

    def _link(self, ends: int, begins: int) -> None:
        for place in bits(ends >> self.base):
            self.follow[place] |= begins

    def _sequence(self) -> tuple[bool, int, int]:
        made = (True, 0, 0)
        while self._peek() not in ("", "|", ")"):
            made = self._join(made, self._repeated())
        return made

    def _repeated(self) -> tuple[bool, int, int]:
        begin = self.at
        part = self._single()
        end, sign = self.at, self._peek()
        if sign in ("?", "*", "+") and sign:
            self.at += 1
            if sign != "?":
                self._link(part[2], part[1])
            return part if sign == "+" else (True, *part[1:])
        if sign != "{":
            return part
        close = self.text.index("}", self.at)
        low, comma, high = self.text[self.at + 1 : close].partition(",")
        least, most = int(low or 0), (int(high) if high else None) if comma else int(low)
        made = (True, 0, 0)
        for i in range(max(1, least) if most is None else most):
            if i:  # the same part once more, with places of its own
                self.at = begin
                part = self._single()
                assert self.at == end
            made = self._join(made, part if i < least else (True, *part[1:]))
        if most is None:
            self._link(part[2], part[1])
        self.at = close + 1
        return made if least or most is not None else (True, *made[1:])

    def _single(self) -> tuple[bool, int, int]:
        sign = self._peek()
        self.at += 1
        if sign == "(":
            made = self._either()
            if self._peek() != ")":
                raise ValueError(f"a group of {self.text!r} is not closed")
            self.at += 1
            return made
        if sign == "[":
            return self._symbol(self._class())
        if sign in "?*+{":
            raise ValueError(f"nothing to repeat in {self.text!r}")
        return self._symbol(set(range(256)) - {10} if sign == "." else {self._byte(sign)})

    def _next(self) -> int:
        self.at += 1
        return self._byte(self.text[self.at - 1 : self.at])

    def _byte(self, sign: str) -> int:
        if sign == "\\":
            sign = self._peek()
            self.at += 1
            if sign == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if not sign or ord(sign) > 127:
            raise ValueError(f"only ASCII signs are known in {self.text!r}")
        return ord(sign)

    def _class(self) -> set[int]:
        negated = self._peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._next()
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                high = self._next()
            found.update(range(low, high + 1))
        self.at += 1
        return set(range(256)) - found if negated else found

    def _symbol(self, values: set[int]) -> tuple[bool, int, int]:
        if self.fold:
            values = values | {b ^ 32 for b in values if chr(b).isascii() and chr(b).isalpha()}
        place = 1 << (self.base + len(self.symbols))
        self.symbols.append(frozenset(values))
        self.follow.append(0)
        return False, place, place


def bits(mask: int) -> Iterator[int]:
    """The places of the bits that are set."""
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Automaton:
    """A minimal deterministic automaton: ``table[state, class of a byte]``, state 0 first, ``accepts[state]`` a bit for each rule.

    ``search`` lets matches begin anywhere; else they begin at the first byte and the state ``dead`` is never left.
    ``backwards`` reads the patterns from their ends. ``shortest`` accepts, for each beginning, the first end alone.
    """

    def __init__(self, patterns: list[tuple[str, bool]], search: bool, backwards: bool = False, shortest: bool = False) -> None:
        symbols: list[frozenset[int]] = []
        follow: list[int] = []
        first = 0
        lasts: list[int] = []
        for pattern, fold in patterns:
            p = Places(pattern, fold, len(symbols))
            f, l, then = p.first, p.last, p.follow
            if backwards:
                before = [0] * len(then)
                for place, mask in enumerate(then):
                    for after in bits(mask >> p.base):
                        before[after] |= 1 << (p.base + place)
                f, l, then = l, f, before
            symbols += p.symbols
            follow += [0 if shortest and l >> (p.base + i) & 1 else mask for i, mask in enumerate(then)]
            first |= f
            lasts.append(l)
        signatures: dict[int, int] = {}
        self.classes = np.zeros(256, np.uint8)
        for byte in range(256):
            signature = sum(1 << i for i, s in enumerate(symbols) if byte in s)
            self.classes[byte] = signatures.setdefault(signature, len(signatures))
        members = list(signatures)
        number: dict[tuple[int, bool], int] = {(0, True): 0}
        queue, rows = [(0, True)], []
        for state, begun in queue:  # grows while it is read
            reach = first if search or begun else 0
            for place in bits(state):
                reach |= follow[place]
            row = []
            for member in members:
                # an anchored automaton tells its first state from the dead one; for a search both are the same
                after = (reach & member, search and not reach & member)
                if after not in number:
                    number[after] = len(queue)
                    queue.append(after)
                    if len(queue) > MOST_STATES:
                        raise ValueError("the rules together need too many states")
                row.append(number[after])
            rows.append(row)
        accepts = np.array([sum(1 << r for r, last in enumerate(lasts) if state & last) for state, _ in queue], np.int64)
        self.subsets = len(queue)
        self.table, self.accepts = minimised(np.array(rows, np.int64), accepts)
        idle = np.flatnonzero((self.table == np.arange(len(self.table))[:, None]).all(1) & (self.accepts == 0))
        self.dead = int(idle[0]) if len(idle) and not search else -1


def minimised(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States that no input tells apart made one, by refining the partition by what states accept; the first stays 0."""
    _, block = np.unique(accepts, return_inverse=True)
    parts = 0
    while block.max() + 1 > parts:
        parts = int(block.max()) + 1
        _, block = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        block = block.ravel()
    _, shown = np.unique(block, return_index=True)
    order = np.argsort(shown, kind="stable")  # in the order of their first states, so that state 0 stays 0
    name = np.empty(parts, np.int64)
    name[order] = np.arange(parts)
    return name[block[table[shown[order]]]], accepts[shown[order]]


class Scanner:
    """All automata of a set of rules; their sizes depend on the rules alone."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.all = Automaton([(r.pattern, r.fold) for r in rules], search=True, shortest=True)
        self.back = [Automaton([(r.pattern, r.fold)], search=True, backwards=True) for r in rules]
        self.ahead = [Automaton([(r.pattern, r.fold)], search=False) for r in rules]
        self.heads = [Automaton([(r.head, r.fold)], search=False) if r.head else None for r in rules]
        # one more class stands for "no byte" and leaves every state as it is; states are kept as rows' first places
        states, classes = self.all.table.shape
        self.width = classes + 1
        self.steps = np.column_stack([self.all.table, np.arange(states)]).ravel() * self.width
        self.accepts = np.repeat(self.all.accepts, self.width)

    def hits(self, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``data`` where a shortest match of some rule ends, and the rules' bits; ``begin`` and ``sizes`` cut it into texts."""
        pieces = -(-sizes // PIECE)
        if not pieces.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[text] + nth * PIECE
        size = np.minimum(PIECE, sizes[text] - nth * PIECE)
        column = np.arange(PIECE)
        symbol = self.all.classes[data[np.minimum(start[:, None] + column, len(data) - 1)]].astype(np.int64)
        symbol[column >= size[:, None]] = self.width - 1
        symbol = np.ascontiguousarray(symbol.T)
        seen = np.empty(symbol.shape, np.int64)
        state = np.zeros(len(text), np.int64)
        for step in range(PIECE):
            state = self.steps[state + symbol[step]]
            seen[step] = state
        guessed = np.zeros(len(text), np.int64)
        while True:
            before = np.where(nth > 0, np.r_[0, seen[-1, :-1]], 0)
            lanes = np.flatnonzero(before != guessed)
            if not len(lanes):
                break
            guessed[lanes] = state = before[lanes]
            for step in range(PIECE):
                state = self.steps[state + symbol[step, lanes]]
                other = state != seen[step, lanes]
                lanes, state = lanes[other], state[other]
                if not len(lanes):
                    break
                seen[step, lanes] = state
        found = self.accepts[seen]
        step, lane = np.nonzero(found)
        real = step < size[lane]
        place, which = start[lane[real]] + step[real], found[step[real], lane[real]]
        order = np.argsort(place)
        return place[order], which[order]

    def spans(self, text: bytes, ends: list[int], rule: int) -> list[tuple[int, int]]:
        """Matches of a rule that are kept, as byte ranges; ``ends`` are the places of the last bytes of shortest matches, ascending."""
        back, ahead, head, least = self.back[rule], self.ahead[rule], self.heads[rule], self.rules[rule].least
        table, classes, accepts = back.table.tolist(), back.classes.tolist(), back.accepts.tolist()
        starts, left, at, state = [], list(ends), -1, 0
        while left or state:
            if not state:
                while left and at >= 0 and left[-1] > at:
                    left.pop()
                if not left:
                    break
                at = left.pop()
            if at < 0:
                break
            state = table[state][classes[text[at]]]
            if accepts[state]:
                starts.append(at)
            at -= 1
        found, free = [], 0
        for s in reversed(starts):
            if s >= free:
                free = reach(ahead, text, s)
                if free - (reach(head, text, s) if head else s) >= least:
                    found.append((s, free))
        return found

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """``(begin, rule, end)`` in code points for each text of an Arrow column, ordered; null has none."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, values = column.buffers()
        offset = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(1, np.uint8)
        place, which = self.hits(data, offset[:-1], np.diff(offset))
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        owner = np.searchsorted(offset, place, side="right") - 1
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for place_, which_, owner_ in zip(np.split(place, cuts), np.split(which, cuts), np.split(owner, cuts)):
            if not len(place_):
                continue
            text = int(owner_[0])
            own = data[offset[text] : offset[text + 1]]
            coded = own.tobytes()
            point = np.r_[0, np.cumsum((own & 0xC0) != 0x80)]
            for rule in range(len(self.rules)):
                ends = place_[(which_ >> rule) & 1 == 1] - offset[text]
                if len(ends):
                    out[text] += [(int(point[a]), rule, int(point[b])) for a, b in self.spans(coded, ends.tolist(), rule)]
            out[text].sort()
        return out


def reach(automaton: Automaton, text: bytes, start: int) -> int:
    """The end of the longest match that begins at ``start``; ``start`` itself if there is none."""
    table, classes, accepts, dead = automaton.table, automaton.classes, automaton.accepts, automaton.dead
    state, end = 0, start
    for at in range(start, len(text)):
        state = table[state, classes[text[at]]]
        if accepts[state]:
            end = at + 1
        elif state == dead:
            break
    return end


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, found``: the secrets of every whole text as an array of ``kind, begin, end`` (code points, end exclusive).

    They are ordered by where they begin, then by the order of the rules; those of one rule do not overlap. The automata
    are compiled once in each worker; nothing grows with the corpus. Null and empty texts have none. Very long texts are
    scanned whole, in pieces. Repeated rows give repeated rows, an empty table gives an empty one, a null id stays null;
    other columns are ignored, whatever their names.
    """
    own = docs.select(id_col).schema[0]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([own, T.StructField("found", T.ArrayType(span))])
    kinds = [r.kind for r in rules]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = scanner(rules)
        for batch in batches:
            for part in slices(batch, 1):
                got = [[{"kind": kinds[r], "begin": a, "end": b} for a, r, b in one] for one in work.scan(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, arrow)], names=[id_col, "found"])
            release()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def listed(found: Column) -> Column:
    """Spans as ``kind:begin:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(found: Column, kinds: list[str]) -> Column:
    """The spans of these kinds alone."""
    return F.filter(found, lambda s: s["kind"].isin(kinds))
