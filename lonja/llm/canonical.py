"""Free-entered names onto a reference list: a trie searched with a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence, Set
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lonja.functions.text import normalised
from lonja.operators.skew import join_counted
from lonja.session import written

#: Digits that recognition puts for letters.
DIGITS = str.maketrans({"0": "o", "1": "l", "4": "a", "8": "b", "3": "e", "5": "s"})

#: The rows of the keyboard.
ROWS = ("qwertyuiop", "asdfghjklñ", "zxcvbnm")
#: The keys beside each key.
BESIDE = {c: "".join(r[max(0, i - 1) : i + 2] for r in ROWS[max(0, n - 1) : n + 2]) for n, row in enumerate(ROWS) for i, c in enumerate(row)}


def plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


#: In a path: the next letter begins a word. In a query: a word of the list, or else of the aliases, ends
#: here of which the query has the beginning only.
BREAK, LISTED, ALIAS = "|", "\x01", "\x02"


class Trie:
    """Paths of letters; a node keeps the labels of the paths that end there.

    The edge to the first letter of a further word is told from that to the same letter within a word.
    `ends` holds for each node whether a word of the list (1) or of the aliases (2) ends there.
    """

    def __init__(self, paths: Iterable[tuple[str, int]] = (), words: Set[str] = frozenset(), others: Set[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.labels: list[set[int]] = [set()]
        self.ends = [0]
        self.words, self.others = words, others
        for path, label in paths:
            self.add(path, label)

    def add(self, path: str, label: int) -> None:
        at = 0
        for i, word in enumerate(path.split(BREAK)):
            for j, c in enumerate(word):
                c = BREAK + c if i and not j else c
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.labels.append(set())
                    self.ends.append(0)
                at = nxt
            self.ends[at] |= (word in self.words) | (word in self.others) << 1
        self.labels[at].add(label)


class Masks:
    """Of a query, as bits i: where each letter stands, and what may happen at i.

    soft: letter i may be wrong or superfluous; open: a letter may be missing before i; jumps: a word is
    completed at i, by the list or by the aliases. The letters of a beginning must stand as they are.
    """

    def __init__(self, query: str):
        self.length = len(query)
        self.full = (1 << (len(query) + 1)) - 1
        self.letters: dict[str, int] = {}
        self.jumps = [0, 0]
        self.soft, self.open = self.full >> 1, self.full
        for i, c in enumerate(query):
            if c in (LISTED, ALIAS):
                self.jumps[c == ALIAS] |= 1 << i
                self.soft &= ~(1 << i)
                self.open &= ~(1 << i)
            else:
                self.letters[c] = self.letters.get(c, 0) | 1 << i

    def hold(self, start: int, end: int) -> None:
        """No errors in letters start to end."""
        self.soft &= ~((1 << end) - (1 << start))
        self.open &= ~((1 << end) - (1 << start + 1))


def masks_of(query: str) -> Masks:
    """Masks of a query in which a LISTED or ALIAS stands after the letters that it completes, and a BREAK before them.

    A word of more than three letters without a BREAK before it may hold a slip.
    """
    letters, held = [], []
    for piece in re.split(f"(\\{BREAK}[^{LISTED}{ALIAS}]*)", query):
        if piece.startswith(BREAK):
            held.append((len(letters), len(letters) + len(piece) - 1))
        letters += piece.removeprefix(BREAK)
    m = Masks("".join(letters))
    for start, end in held:
        m.hold(start, end)
    return m


class Automaton:
    """Levenshtein automaton (with swaps of neighbours) of one query, as bit masks.

    A state is a pair for each number of errors: bit i is set if i characters of the query
    can have been read; the state before it and the last character serve the swaps. At a place where
    a word is completed, letters are read for nothing until a word ends.
    """

    def __init__(self, query: str, errors: int):
        self.errors, self.masks = errors, masks_of(query)
        start = [1]
        for _ in range(errors):
            start.append(start[-1] | (start[-1] & self.masks.soft) << 1)
        self.start = (tuple(start), (0,) * (errors + 1), "")
        self.jump = self.masks.jumps[0] | self.masks.jumps[1]

    def step(self, state: tuple, c: str, ends: int = 0) -> tuple | None:
        now, before, last = state
        m, jump = self.masks, self.jump
        if c[0] == BREAK:  # a completed word ends before the next one
            c = c[1:]
            if jump:
                now = tuple(r & ~jump for r in now)
        mask = m.letters.get(c, 0)
        soft = m.soft
        swap = mask & (m.letters.get(last, 0) >> 1) & soft & soft >> 1
        done = (m.jumps[0] if ends & 1 else 0) | (m.jumps[1] if ends & 2 else 0)
        out, got = [], 0
        for j in range(self.errors + 1):
            r = now[j]
            new = (r & mask) << 1
            if jump:
                new |= r & jump | (r & done) << 1
            if j:
                low = now[j - 1]
                new |= low & m.open | (low & soft) << 1 | (got & soft) << 1 | (before[j - 1] & swap) << 2
            got = new & m.full
            out.append(got)
        return (tuple(out), now, c) if out[-1] else None

    def distance(self, state: tuple) -> int | None:
        for j, r in enumerate(state[0]):
            if r >> self.masks.length & 1:
                return j
        return None

    def crossed(self, state: tuple) -> tuple:
        """The state at the beginning of a further word."""
        return (tuple(r & ~self.jump for r in state[0]), *state[1:]) if self.jump else state


def walk(trie: Trie, automaton: Automaton, state: tuple) -> Iterator[tuple[int, tuple]]:
    """(label, state) of each path that the automaton can still finish from."""
    stack = [(0, state)]
    while stack:
        at, s = stack.pop()
        for c, nxt in trie.children[at].items():
            t = automaton.step(s, c, trie.ends[nxt])
            if t is not None:
                for label in trie.labels[nxt]:
                    yield label, t
                stack.append((nxt, t))


class Walks:
    """The walk of many automata through one trie, side by side, as arrays."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.count = np.array([len(c) for c in trie.children], np.int64)
        self.first = np.cumsum(self.count) - self.count
        edges = [(c, nxt) for cs in trie.children for c, nxt in cs.items()]
        self.alphabet = {c: i for i, c in enumerate(sorted({c[-1] for c, _ in edges}))}
        self.child = np.array([n for _, n in edges], np.int64)
        self.letter = np.array([self.alphabet[c[-1]] for c, _ in edges], np.int64)
        self.fresh = np.array([c[0] == BREAK for c, _ in edges], bool)
        self.ends = np.array(trie.ends, np.int64)
        self.holds = np.array([bool(x) for x in trie.labels], bool)

    def within(self, queries: Sequence[str], errors: int) -> list[dict[int, int]]:
        """Of each query (of up to 62 letters), the labels within `errors` and their least distance."""
        out: list[dict[int, int]] = [{} for _ in queries]
        if not queries or not len(self.child):
            return out
        made = [masks_of(q) for q in queries]
        u = np.uint64
        take = lambda f: np.array([f(m) for m in made], u)
        letters = np.zeros((len(made), len(self.alphabet)), u)
        for i, m in enumerate(made):
            for c, bits in m.letters.items():
                if c in self.alphabet:
                    letters[i, self.alphabet[c]] = bits
        soft, open_, full, top = take(lambda m: m.soft), take(lambda m: m.open), take(lambda m: m.full), take(lambda m: 1 << m.length)
        by_list, by_alias = take(lambda m: m.jumps[0]), take(lambda m: m.jumps[1])
        jump = by_list | by_alias
        one, two = u(1), u(2)
        q, node = np.arange(len(made)), np.zeros(len(made), np.int64)
        now = [np.ones(len(made), u)]
        for _ in range(errors):
            now.append(now[-1] | (now[-1] & soft) << one)
        before, last = [np.zeros(len(made), u)] * (errors + 1), np.zeros(len(made), u)
        while len(q):
            of = np.repeat(np.arange(len(q)), self.count[node])
            edge = self.first[node][of] + np.arange(len(of)) - np.repeat(np.cumsum(self.count[node]) - self.count[node], self.count[node])
            q, node = q[of], self.child[edge]
            s, j = soft[q], jump[q]
            keep_jump = np.where(self.fresh[edge], ~j, ~u(0))
            mask = letters[q, self.letter[edge]]
            swap = mask & (last[of] >> one) & s & (s >> one)
            ends = self.ends[node]
            done = np.where(ends & 1, by_list[q], u(0)) | np.where(ends & 2, by_alias[q], u(0))
            old = [r[of] & keep_jump for r in now]
            new: list[np.ndarray] = []
            for e in range(errors + 1):
                r = old[e]
                x = (r & mask) << one | r & j | (r & done) << one
                if e:
                    low = old[e - 1]
                    x |= low & open_[q] | (low & s) << one | (new[-1] & s) << one | (before[e - 1][of] & swap) << two
                new.append(x & full[q])
            alive = np.flatnonzero(new[-1])
            q, node, last = q[alive], node[alive], mask[alive]
            now, before = [x[alive] for x in new], [r[alive] for r in old]
            for i in np.flatnonzero(self.holds[node] & ((now[-1] & top[q]) != 0)):
                d = next(e for e, x in enumerate(now) if x[i] & top[q[i]])
                found = out[q[i]]
                for label in self.trie.labels[node[i]]:
                    found[label] = min(d, found.get(label, d))
        return out


def edits(a: str, b: str, far: float = 1) -> float:
    """Edit distance with swaps of neighbours; `far` is the cost of taking a key for one not beside it.

    A LISTED or ALIAS in a stands for one letter or more.
    """
    prev2: list[float] = []
    prev: list[float] = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row: list[float] = [i]
        if x in (LISTED, ALIAS):
            for j in range(1, len(b) + 1):
                row.append(min(row[-1] if j > 1 else far + len(b), prev[j - 1]))
            row[0] = len(a) + len(b)
            prev2, prev = prev, row
            continue
        for j, y in enumerate(b, 1):
            slip = 0 if x == y else 1 if far == 1 or y in BESIDE.get(x, "") else far
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + slip))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], prev2[j - 2] + 1)
        prev2, prev = prev, row
    return prev[-1]


@dataclass(frozen=True)
class Match:
    entry: int
    distance: int


@dataclass
class Reference:
    """A reference list of names, each a kind ("Maíz Choclo") and, if of several words, a variety ("Tarmina").

    entries: (id, name). aliases: other names of a kind. remarks: what may stand in brackets
    without being part of a name. The trie holds every way to write a kind (aliases, plurals)
    and continues with every variety, in both orders. Combinations that the list lacks are
    paths too: a name nearest to one of them is not in the list.
    """

    entries: Sequence[tuple[int, str]]
    aliases: Mapping[str, Sequence[str]] = field(default_factory=dict)
    fillers: frozenset[str] = frozenset({"tipo"})
    memory: int = 200_000  # readings whose result is kept

    def __post_init__(self) -> None:
        self.known: dict[tuple[str, ...], tuple[list[Match], list[Match]]] = {}
        self.remarks: dict[str, bool] = {}
        self.kinds: list[str] = []
        self.varieties: list[str] = []
        self.ids: dict[tuple[int, int], list[int]] = {}
        kinds: dict[str, int] = {}
        varieties: dict[str, int] = {}
        for i, name in self.entries:
            words = plain(name or "").split()
            if not words:
                continue
            k = kinds.setdefault(" ".join(words[:-1]) if len(words) > 1 else words[0], len(kinds))
            v = varieties.setdefault(words[-1], len(varieties)) if len(words) > 1 else -1
            self.ids.setdefault((k, v), []).append(i)
        self.kinds, self.varieties = list(kinds), list(varieties)
        self.written: list[set[str]] = [set() for _ in kinds]  # ways to write a kind, blanks dropped
        self.words: set[str] = set()  # of the list itself
        self.others: set[str] = set()  # of the aliases
        ways: list[tuple[str, int]] = []
        for kind, k in kinds.items():
            for name in (kind, *map(plain, self.aliases.get(kind, ()))):
                for w in sorted(plurals(name)):
                    self.written[k].add(w.replace(" ", ""))
                    ways.append((w.replace(" ", BREAK), k))
                (self.words if name == kind else self.others).update(name.split())
        self.words.update(varieties)
        self.sorted_words, self.sorted_others = sorted(self.words), sorted(self.others)
        self.kind_trie = Trie(ways, self.words, self.others)
        self.variety_trie = Trie(((v, i) for i, v in enumerate(self.varieties)), self.words, self.others)
        # Every way to write each entry of the list; its labels are places in `pairs`.
        self.pairs = list(self.ids)
        by_kind: dict[int, list[str]] = {}
        for w, k in ways:
            by_kind.setdefault(k, []).append(w)
        whole = Trie((), self.words, self.others)
        for label, (k, v) in enumerate(self.pairs):
            for w in by_kind[k]:
                for path in (w,) if v < 0 else (w + BREAK + self.varieties[v], self.varieties[v] + BREAK + w):
                    whole.add(path, label)
        self.walks = Walks(whole)
        self.longest = max((len(max(self.written[k], key=len)) + (len(self.varieties[v]) if v >= 0 else 0) for k, v in self.pairs), default=0)

    # -- search -------------------------------------------------------------------------------

    def near(self, query: str, errors: int) -> dict[tuple[int, int], int]:
        """Least distance of each (kind, variety) path within `errors` of the query; variety -1: none."""
        a = Automaton(query, errors)
        out: dict[tuple[int, int], int] = {}

        def keep(pair: tuple[int, int], state: tuple) -> None:
            d = a.distance(state)
            if d is not None and d < out.get(pair, errors + 1):
                out[pair] = d

        seen: dict[tuple, list[int]] = {}
        for k, s in walk(self.kind_trie, a, a.start):
            keep((k, -1), s)
            seen.setdefault(s, []).append(k)
        for s, ks in seen.items():
            for v, t in walk(self.variety_trie, a, a.crossed(s)):
                for k in ks:
                    keep((k, v), t)
        turned: dict[tuple, list[int]] = {}
        for v, s in walk(self.variety_trie, a, a.start):
            turned.setdefault(s, []).append(v)
        for s, vs in turned.items():
            for k, t in walk(self.kind_trie, a, a.crossed(s)):
                for v in vs:
                    keep((k, v), t)
        return out

    def fits(self, query: str, pair: tuple[int, int], distance: int) -> bool:
        """Whether no part of a name takes more errors than its length allows."""
        k, v = pair
        if distance <= 1 or LISTED in query or ALIAS in query:  # the beginnings of words hold no errors
            return True
        if v < 0:
            return any(distance <= allowed(len(w)) for w in self.written[k] if edits(query, w) == distance)
        variety = self.varieties[v].replace(" ", "")
        for w in self.written[k]:
            for first, second in ((w, variety), (variety, w)):
                if abs(len(first) + len(second) - len(query)) > distance:
                    continue
                for cut in range(max(1, len(first) - distance), min(len(query), len(first) + distance + 1)):
                    x, y = edits(query[:cut], first), edits(query[cut:], second)
                    if x + y == distance and x <= part(len(first)) and y <= part(len(second)):
                        return True
        return False

    def effort(self, query: str, pair: tuple[int, int]) -> float:
        """Weighted distance, to choose among equally near names: a slip to a key far off, and a
        different first letter, are less likely than other slips."""
        k, v = pair
        variety = self.varieties[v].replace(" ", "") if v >= 0 else ""
        query = query.replace(BREAK, "")
        ways = {a for w in self.written[k] for a in (w + variety, variety + w)}
        return min(edits(query, w, far=1.5) + 0.25 * (query[:1] != w[:1]) for w in ways)

    def matches(self, text: str | None) -> list[Match]:
        """All entries at the least distance within the one allowed; none if an unlisted path is nearer."""
        return self.search([text])[0][0]

    def search(self, texts: Sequence[str | None], block: int = 4096) -> list[tuple[list[Match], list[Match]]]:
        """Of each text, the entries that `matches` gives, and all entries within the distance allowed, the nearest first."""
        read = [tuple(self.queries(t)) for t in texts]
        by_errors: dict[int, list[str]] = {}
        for q in dict.fromkeys(q for qs in read if qs not in self.known for q in qs):
            n = letters_in(q)
            if n <= self.longest + allowed(n):
                by_errors.setdefault(allowed(n) if len(q) <= 62 else -1, []).append(q)
        listed: dict[str, dict[int, int]] = {}
        for errors, queries in by_errors.items():
            for lo in range(0, len(queries), block):
                part = queries[lo : lo + block]
                listed.update(zip(part, self.walks.within(part, errors) if errors >= 0 else map(self._one_by_one, part)))
        out = []
        for qs in read:
            if qs not in self.known:
                if len(self.known) >= self.memory:
                    self.known.clear()
                near = {q: {self.pairs[label]: d for label, d in listed.get(q, {}).items()} for q in qs}
                best: dict[int, int] = {}
                for found in near.values():
                    for p, d in found.items():
                        for i in self.ids[p]:
                            best[i] = min(d, best.get(i, d))
                self.known[qs] = self._nearest(near), [Match(i, d) for d, i in sorted((d, i) for i, d in best.items())]
            out.append(self.known[qs])
        return out

    def _one_by_one(self, query: str) -> dict[int, int]:
        """The walk for a query too long for one machine word."""
        a = Automaton(query, allowed(letters_in(query)))
        out: dict[int, int] = {}
        for label, s in walk(self.walks.trie, a, a.start):
            d = a.distance(s)
            if d is not None:
                out[label] = min(d, out.get(label, d))
        return out

    def _nearest(self, listed: Mapping[str, Mapping[tuple[int, int], int]]) -> list[Match]:
        """The nearest entries over the readings of a text; listed: of each, the pairs of the list within its distance."""
        best: list[Match] = []
        for query, around in listed.items():
            if not around:
                continue
            limit = allowed(letters_in(query))
            if best:
                limit = min(limit, best[0].distance)
            for level in sorted({d for d in around.values() if d <= limit}):
                if level and any(p not in self.ids and self.fits(query, p, d) for p, d in self.near(query, level - 1).items()):
                    break  # nearer to something that the list lacks
                pairs = [p for p, d in around.items() if d == level and self.fits(query, p, d)]
                if not pairs:
                    continue
                if len(pairs) > 1 and level:
                    effort = {p: self.effort(query, p) for p in pairs}
                    pairs = [p for p in pairs if effort[p] == min(effort.values())]
                ids = {i for p in pairs for i in self.ids[p]}
                if best and best[0].distance == level:  # another reading of the text, as near
                    ids |= {m.entry for m in best}
                best = [Match(i, level) for i in sorted(ids)]
                break
        return best

    def queries(self, text: str | None) -> list[str]:
        """What a text may say, letters only, the likeliest reading first."""
        t = plain(text or "")
        t = re.sub(r"^\s*\d+\s*/|\s\d+\s*/\s*$|[*:]", " ", t)
        # Brackets hold a remark, unless it reads like a variety.
        own = re.sub(r"\(([^)]*)\)", lambda m: f" {m[1]} " if self._is_variety(m[1]) else " ", t)
        readings = dict.fromkeys([own, re.sub(r"\([^)]*\)", " ", t)])
        out: list[str] = []
        for r in readings:
            r = re.sub(r"[^a-z0-9.\s]+", " ", r)
            words = [w for w in r.split() if w.strip(".") and w not in self.fillers]
            if words and all(len(w) == 1 for w in words):
                words = ["".join(words)]
            words = [w.translate(DIGITS) if re.search(r"[a-z]", w) else w for w in words]
            for q in self._readings(words):
                for x in (q, q.replace("rn", "m")):
                    if letters_in(x) and x not in out:
                        out.append(x)
        return out

    def _readings(self, words: list[str]) -> list[str]:
        """The words as one query. One that ends in a dot is the beginning of a word of the list, or else of
        an alias; if none begins so, it may be such a beginning with a slip, or the word itself."""
        pieces, slips = [], False
        for w in words:
            stem = re.sub(r"[^a-z0-9]", "", w)
            plain_word = not w.endswith(".") or "." in w.rstrip(".")
            if plain_word:
                pieces.append((stem, stem))
            elif mark := LISTED if self._begins(self.sorted_words, stem) else ALIAS if self._begins(self.sorted_others, stem) else "":
                pieces.append((BREAK + stem + mark,) * 2)
            else:
                slips |= len(stem) > 3
                pieces.append((stem + LISTED if len(stem) > 3 else stem, stem))
        whole = "".join(p[1] for p in pieces)
        return ["".join(p[0] for p in pieces), whole] if slips else [whole]

    @staticmethod
    def _begins(words: list[str], stem: str) -> bool:
        """Whether a longer word begins with the stem."""
        at = bisect_right(words, stem)
        return at < len(words) and words[at].startswith(stem)

    def _is_variety(self, text: str) -> bool:
        q = re.sub(r"[^a-z]", "", text.translate(DIGITS))
        if q not in self.remarks:
            if len(self.remarks) >= self.memory:
                self.remarks.clear()
            a = Automaton(q, min(2, len(q) // 4))
            self.remarks[q] = q != "" and any(a.distance(s) is not None for _, s in walk(self.variety_trie, a, a.start))
        return self.remarks[q]


def letters_in(query: str) -> int:
    """Letters that a query gives; those of words that it has the beginning of are not known."""
    return len(query) - sum(map(query.count, (BREAK, LISTED, ALIAS)))


def allowed(length: int) -> int:
    """Errors that a name of this length may hold."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 13 else 3


def part(length: int) -> int:
    """Errors that one part of a name may hold."""
    return 2 if length < 9 else 3


def plurals(name: str) -> set[str]:
    """The name, and its first or last word in the plural."""
    words = name.split()
    out = {name}
    for i in {0, len(words) - 1}:
        w = words[i]
        for p in {w + "s", w + "es", *({w[:-1] + "ces"} if w.endswith("z") else ())}:
            out.add(" ".join([*words[:i], p, *words[i + 1 :]]))
    return out


@lru_cache(maxsize=2)
def built(entries: tuple[tuple[int, str], ...], aliases: tuple[tuple[str, tuple[str, ...]], ...], memory: int) -> Reference:
    """The reference of a list, once for each process that searches it, however many tasks it runs."""
    return Reference(entries, dict(aliases), memory=memory)


#: Longest name, in characters, that is searched apart from its rows; longer ones are searched where they lie.
LONGEST = 256


def map_names(
    df: DataFrame,
    text: str,
    reference: DataFrame,
    entry: tuple[str, str],
    aliases: Mapping[str, Sequence[str]] | None = None,
    context: Mapping[str, str] | None = None,
    most_entries: int = 100_000,
    memory: int = 200_000,
) -> DataFrame:
    """Adds `entrada` (id of the entry meant, null if none), `distancia`, `candidatos` (all nearest entries)
    and `dentro` (all entries within the distance that the name's length allows, each with its own).

    reference: the list, with `entry` = (id, name) columns; it goes to every task, so more than
    `most_entries` entries are refused. context: columns of df that tell entries with equally near
    names apart, each with the reference column it must equal (text without case and marks, numbers
    exactly); if several or none fit, the name is ambiguous and `entrada` stays null.

    Each distinct name is searched once, and joined back to its rows: frequent names, of which there
    is a bounded number of bounded length, by broadcast, the others by name. Null, empty and unreadable
    names are unmatched; entries without id or name can't be meant. Rows are kept as they are; repeated
    rows give repeated results. Columns of df named like a result are replaced.
    """
    context = dict(context or {})
    kind = reference.schema[entry[0]].dataType
    told = {f"_c{i}": c for i, c in enumerate(context.values())}
    facts = [_told(reference, c).alias(n) for n, c in told.items()]
    rows = reference.where(F.col(entry[0]).isNotNull()).select(F.col(entry[0]).alias("_i"), F.col(entry[1]).alias("_name"), *facts)
    listed = [tuple(r) for r in rows.distinct().orderBy("_i").limit(most_entries + 1).collect()]
    if len(listed) > most_entries:
        raise ValueError(f"the reference list has more than {most_entries} entries")
    about = {r[0]: r[2:] for r in listed}
    names = tuple((r[0], r[1]) for r in listed)
    ways = tuple((k, tuple(v)) for k, v in (aliases or {}).items())
    near = StructType([StructField("entrada", kind), StructField("distancia", IntegerType()), *(StructField(f.name, f.dataType) for f in rows.schema.fields[2:])])
    found = [StructField("_near", ArrayType(near)), StructField("dentro", ArrayType(StructType(near.fields[:2])))]
    arrow = to_arrow_schema(StructType(found))

    def search(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                got = built(names, ways, memory).search(b.column(column).to_pylist())
                nearest = [[{"entrada": m.entry, "distancia": m.distance, **dict(zip(told, about[m.entry]))} for m in x] for x, _ in got]
                inside = [[{"entrada": m.entry, "distancia": m.distance} for m in x] for _, x in got]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest, arrow.field(0).type), pa.array(inside, arrow.field(1).type)], names=[*b.schema.names, *arrow.names])

        return run

    df = df.drop("entrada", "distancia", "candidatos", "dentro")
    short = F.length(text) <= LONGEST
    distinct = df.where(short).groupBy(F.col(text).alias("_name")).agg(F.count("*").alias("_n"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By another expression, so that many names with few bytes are not put together into few tasks.
    searched = distinct.repartition(tasks, F.xxhash64("_name")).mapInArrow(search("_name"), StructType([*distinct.schema.fields, *found]))
    joined = join_counted(df.where(short).withColumn("_name", F.col(text)), written(searched, "names"), ["_name"], "_n").drop("_name")
    direct = df.where(~F.coalesce(short, F.lit(False))).mapInArrow(search(text), StructType([*df.schema.fields, *found]))
    out = joined.unionByName(direct)

    def fits(m: Column) -> Column:
        same = F.lit(bool(context))
        for n, c in zip(told, context):
            same &= F.col(c).isNull() | F.coalesce(m[n] == _told(df, c), F.lit(False))
        return same

    fit = F.filter("_near", fits)
    only = F.when(F.size("_near") == 1, F.get("_near", F.lit(0))["entrada"]).when(F.size(fit) == 1, F.get(fit, F.lit(0))["entrada"])
    return out.select(*df.columns, only.alias("entrada"), F.get("_near", F.lit(0))["distancia"].alias("distancia"), F.col("_near.entrada").alias("candidatos"), "dentro")


def _told(df: DataFrame, c: str) -> Column:
    return normalised(c) if isinstance(df.schema[c].dataType, StringType) else F.col(c)
