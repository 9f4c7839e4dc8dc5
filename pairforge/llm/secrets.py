"""Secret scans: fixed expressions, and formats learned from labelled credentials by grammar inference.

For each kind of labelled credential a prefix tree over character classes is built. States whose futures are
statistically compatible (Hoeffding bounds on the shares of endings and of each class, all the way on) are merged:
first states of the same depth, so that what stands at a fixed place gathers evidence, then states of any depth, lowest
first. This gives a probabilistic automaton; every edge also keeps how often it carried each character. All candidate
strings of a text, the parts of its runs between separators, are scored by all automata: the odds, in bits, of the
automaton against characters drawn evenly. A candidate whose odds reach what the kind's own examples reach is a secret
of the kind "format", inside a span of the base expressions too; of candidates that overlap the one furthest above its
bound counts.

Nulls count as empty texts, which hold no secret. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.rows import per_row, text_of

# The base expressions, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex", "format")

#: Runs of these characters hold the candidates for the automata.
RUN = "[A-Za-z0-9+/_.=-]"
#: Bits a character costs if any of the candidates' characters is as likely as any other.
EVEN = math.log2(67)

# Published forms of credentials, as pieces of (alphabet or literal text, length).
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FORMS: dict[str, list[tuple[str, int]]] = {
    "aws": [("AKIA", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)],
    "github": [("ghp_", 0), (_ALNUM, 36)],
    "slack": [("xoxb-", 0), ("0123456789", 12), ("-", 0), ("0123456789", 12), ("-", 0), (_ALNUM, 24)],
    "google": [("AIza", 0), (_ALNUM + "-_", 35)],
    "stripe": [("sk_live_", 0), (_ALNUM, 24)],
    "sendgrid": [("SG.", 0), (_ALNUM + "-_", 22), (".", 0), (_ALNUM + "-_", 43)],
    "hex40": [("0123456789abcdef", 40)],
}


def labelled_examples(each: int = 300, seed: int = 7) -> list[tuple[str, str]]:
    """Credentials with their kinds, drawn from the published forms: training data of a fixed size."""
    draw = random.Random(seed)
    one = lambda form: "".join(text if not n else "".join(draw.choices(text, k=n)) for text, n in form)
    return [(kind, one(form)) for kind, form in FORMS.items() for _ in range(each)]


def symbol(char: str) -> str:
    """The class of a character: hex and other letters in either case, digits; anything else is its own class."""
    if char.isdigit():
        return "0"
    if "a" <= char <= "z":
        return "f" if char <= "f" else "z"
    if "A" <= char <= "Z":
        return "F" if char <= "F" else "Z"
    return char


#: The characters of a class that has several.
GROUPS = {"0": "0123456789", "f": "abcdef", "F": "ABCDEF", "z": "ghijklmnopqrstuvwxyz", "Z": "GHIJKLMNOPQRSTUVWXYZ"}


class Automaton:
    """A prefix tree whose compatible states get merged. State 0 is the start."""

    def __init__(self, examples: Iterable[str]):
        self.seen: list[int] = [0]
        self.ends: list[int] = [0]
        self.depth: list[int] = [0]
        self.edges: list[dict[str, list]] = [{}]  # class -> [target, times, Counter of characters]
        self.alias: list[int] = [0]  # what a state was merged into
        for example in examples:
            state = 0
            self.seen[0] += 1
            for char in example:
                edge = self.edges[state].get(kind := symbol(char))
                if edge is None:
                    edge = self.edges[state][kind] = [len(self.seen), 0, Counter()]
                    self.alias.append(len(self.seen))
                    self.depth.append(self.depth[state] + 1)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.edges.append({})
                edge[1] += 1
                edge[2][char] += 1
                state = edge[0]
                self.seen[state] += 1
            self.ends[state] += 1

    def _now(self, state: int) -> int:
        while self.alias[state] != state:
            self.alias[state] = self.alias[self.alias[state]]
            state = self.alias[state]
        return state

    def infer(self, alpha: float = 0.05) -> Automaton:
        """Merges states: of one depth first, then each frontier state with the first settled state it is compatible with."""
        width = math.sqrt(math.log(2 / alpha) / 2)
        level = [0]
        while level:
            found = sorted({self._now(e[0]) for s in level for e in self.edges[self._now(s)].values()})
            level = []
            for state in found:
                if self._now(state) == state:
                    self._join(level, state, width)
        settled = [0]
        while True:
            frontier = {self._now(e[0]) for s in settled for e in self.edges[s].values()}.difference(settled)
            if not frontier:
                return self
            self._join(settled, min(frontier, key=lambda s: (self.depth[s], s)), width)
            settled = sorted({self._now(s) for s in settled}, key=lambda s: (self.depth[s], s))

    def _join(self, known: list[int], state: int, width: float) -> None:
        """Merges a state with the first of the known ones that it is compatible with, or makes it one of them."""
        for other in known:
            if self._compatible(other, state, width):
                self._fold(other, state)
                return
        known.append(state)

    def _compatible(self, a: int, b: int, width: float) -> bool:
        todo, asked = [(a, b)], {(a, b)}
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) >= bound:
                return False
            for kind in self.edges[a].keys() | self.edges[b].keys():
                x, y = self.edges[a].get(kind), self.edges[b].get(kind)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) >= bound:
                    return False
                if x and y:
                    pair = self._now(x[0]), self._now(y[0])
                    if pair[0] != pair[1] and pair not in asked:
                        asked.add(pair)
                        todo.append(pair)
        return True

    def _fold(self, a: int, b: int) -> None:
        """Makes two states one, and with them those that their equal edges lead to."""
        todo = [(a, b)]
        while todo:
            a, b = map(self._now, todo.pop())
            if a == b:
                continue
            if (self.depth[b], b) < (self.depth[a], a):
                a, b = b, a
            self.alias[b] = a
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for kind, edge in self.edges[b].items():
                own = self.edges[a].get(kind)
                if own is None:
                    self.edges[a][kind] = edge
                else:
                    own[1] += edge[1]
                    own[2] += edge[2]
                    todo.append((own[0], edge[0]))

    def scorer(self) -> dict[int, dict[str, tuple[int, float]]]:
        """For each state the next state and the gain in bits for each character; "" stands for the end.

        To what goes on from a state, 20 examples are added whose classes are as frequent as in the whole automaton, and to
        an edge's characters 40; classes that a state lacks lead on like its most frequent edge.
        """
        own = [s for s in range(len(self.edges)) if self._now(s) == s]
        usual: dict[str, Counter] = {}
        for state in own:
            for kind, (_, _, chars) in self.edges[state].items():
                usual.setdefault(kind, Counter()).update(chars)
        of_class = {k: {c: (n[c] + 1) / (n.total() + len(GROUPS.get(k, k))) for c in GROUPS.get(k, k)} for k, n in usual.items()}
        all_ = sum(n.total() for n in usual.values())
        out: dict[int, dict[str, tuple[int, float]]] = {}
        for state in own:
            n, moves, edges = self.seen[state], {}, self.edges[state]
            onward = self._now(max(edges.values(), key=lambda e: (e[1], -e[0]))[0]) if edges else None
            more = 20 if edges else 0
            for kind, shares in of_class.items() if edges else ():
                target, times, chars = edges.get(kind, (onward, 0, Counter()))
                likely = (times + more * usual[kind].total() / all_) / (n + more)
                for char, share in shares.items():
                    moves[char] = (self._now(target), math.log2(likely * (chars[char] + 40 * share) / (times + 40)) + EVEN)
            if self.ends[state]:
                moves[""] = (state, math.log2(self.ends[state] / (n + more)))
            out[state] = moves
        return out


def odds(moves: dict[int, dict[str, tuple[int, float]]], text: str) -> float:
    """Bits by which the automaton makes the text likelier than even characters; -inf if it can't make it."""
    state, total = 0, 0.0
    for char in text:
        step = moves[state].get(char)
        if step is None:
            return -math.inf
        state, gain = step
        total += gain
    end = moves[state].get("")
    return total + end[1] if end else -math.inf


def shortest(moves: dict[int, dict[str, tuple[int, float]]]) -> int:
    """The length of the shortest string that the automaton can make."""
    found, steps, seen = {0}, 0, {0}
    while not any("" in moves[s] for s in found):
        found = {t for s in found for t, _ in moves[s].values()} - seen
        seen |= found
        steps += 1
        if not found:
            return 1
    return max(steps, 1)


def prospects(moves: dict[int, dict[str, tuple[int, float]]]) -> dict[int, float]:
    """For each state the most that can still be gained up to an end; without bound where a loop gains."""
    best = {s: m[""][1] if "" in m else -math.inf for s, m in moves.items()}
    for turn in range(2 * len(moves) + 1):
        new = {s: max([best[s], *(best[t] + gain for c, (t, gain) in m.items() if c)]) for s, m in moves.items()}
        if new == best:
            return best
        # what still gets better after as many steps as there are states does so in a loop
        best = new if turn < len(moves) else {s: math.inf if new[s] > best[s] else new[s] for s in new}
    return best


@dataclass(frozen=True)
class Formats:
    """Scorers of all kinds, and the odds from which a candidate counts."""

    moves: dict[str, dict]
    least: dict[str, float]

    def __post_init__(self):
        # runs shorter than what any automaton can make hold no candidate
        most = min(map(shortest, self.moves.values()), default=1)
        object.__setattr__(self, "runs", f"{RUN}{{{most},}}")
        object.__setattr__(self, "more", {k: prospects(m) for k, m in self.moves.items()})

    def score(self, text: str) -> tuple[float, str]:
        """By how many bits the best kind is over its bound, and which kind that is."""
        return max(((odds(m, text) - self.least[k], k) for k, m in self.moves.items()), default=(-math.inf, ""))


def learn_formats(examples: list[tuple[str, str]], alpha: float = 0.05) -> Formats:
    """Automata for all kinds.

    The bound of a kind is 4 bits below what 98 of 100 examples reach, 12 bits at least. Each half of the examples is
    scored by an automaton of the other half, as an automaton is too sure of what it was made from.
    """
    moves, least = {}, {}
    for kind in sorted({k for k, _ in examples}):
        own = [text for k, text in examples if k == kind]
        moves[kind] = Automaton(own).infer(alpha).scorer()
        halves = [(own[1 - k :: 2], own[k::2]) for k in (0, 1)] if len(own) > 1 else [(own, own)]
        reached = sorted(odds(scorer, text) for made, rest in halves for scorer in [Automaton(made).infer(alpha).scorer()] for text in rest)
        least[kind] = max(12.0, reached[len(reached) // 50] - 4)
    return Formats(moves, least)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed expressions as (start, place of the kind, end), by start and kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def accepted(moves: dict[int, dict[str, tuple[int, float]]], run: str, least: float = -math.inf, more: dict[int, float] | None = None) -> list[tuple[float, int, int]]:
    """Parts of a run that the automaton can make, as (odds, start, end): for each end the start of the greatest odds.

    Parts start after a separator and end before one, or at the run's ends. Starts that meet in a state go on as the
    better one, as all that follows is equal for them: the time is linear in the run, whatever it holds. Starts that can't
    come to ``least`` any more, by what ``more`` says that their state can gain, are given up.
    """
    found = []
    live: dict[int, tuple[float, int]] = {}
    for i, char in enumerate(run):
        if (i == 0 or not run[i - 1].isalnum()) and (0 not in live or live[0][0] < 0):
            live[0] = (0.0, i)
        if not live:
            continue
        stepped: dict[int, tuple[float, int]] = {}
        for state, (total, start) in live.items():
            step = moves[state].get(char)
            if step is not None and (step[0] not in stepped or stepped[step[0]][0] < total + step[1]):
                stepped[step[0]] = (total + step[1], start)
        live = stepped if more is None else {s: v for s, v in stepped.items() if v[0] + more[s] >= least}
        if live and (i + 1 == len(run) or not run[i + 1].isalnum()):
            ends = [(total + moves[state][""][1], start) for state, (total, start) in live.items() if "" in moves[state]]
            if ends:
                total, start = max(ends)
                found.append((total, start, i + 1))
    return found


def format_spans(text: str, formats: Formats) -> list[tuple[int, int, int]]:
    """Candidates of a learned format: of those that overlap, the one furthest above its bound."""
    found = []
    for m in re.finditer(formats.runs, text):
        near = []
        for kind, moves in formats.moves.items():
            longest = {}  # by start: a separator that the format allows does not end a credential
            for total, start, end in accepted(moves, m[0], formats.least[kind], formats.more[kind]):
                if total >= formats.least[kind]:
                    longest[start] = (formats.least[kind] - total, m.start() + start, m.start() + end)
            near += longest.values()
        kept: list[tuple[int, int, int]] = []
        for _, start, end in sorted(near):
            if all(end <= s or e <= start for s, _, e in kept):
                kept.append((start, 3, end))
        found += sorted(kept)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """Finds secrets in every whole text; one row for each input row.

    Returns doc_id, found as array of (kind, start, end), the base counts n_assign, n_access and n_hex, base_sha256 (of
    the base spans alone) and spans (all spans as kind:start:end, by start and kind, joined by commas). Null and empty
    texts give no spans and the digest of the empty string; repeated rows give repeated results.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(formats or learn_formats(labelled_examples()))

    def run(rows: list[tuple]) -> list[tuple]:
        out = []
        for doc_id, text in rows:
            base = base_spans(text)
            spans = sorted(base + format_spans(text, shipped.value))
            counts = Counter(k for _, k, _ in base)
            listed = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
            out.append((doc_id, listed, counts[0], counts[1], counts[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        return out

    schema = "doc_id bigint, found array<struct<kind: string, start: int, end: int>>, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return per_row(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), ["doc_id", "text"], schema, run)
