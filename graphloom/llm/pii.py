"""Personal data in texts: exact patterns, and a semi-Markov conditional random field beside them.

The patterns give the base spans. The field looks at the stretches around digits and "@": every
span of up to ``MOST`` tokens there that has one of the shapes is a candidate segment, scored by
features of the whole span (shapes, checksum, what stands left and right of it), and one dynamic
programme chooses boundaries and types together. It passes long stretches in blocks, in flat memory. Elsewhere no segment may be an entity, so the stretches are independent and
the result is that of the whole text. The field is trained here on sentences made from templates.
"""

from __future__ import annotations

import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, kept_in_worker, of_texts, with_last

# The kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: where the run's start fails, its rest does too.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
# The card pattern is [0-9]([\x20-]?[0-9])+, read run by run so that a long match needs no stack.
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = int(x) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in text.split("."))


def digits_of(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def emails(text: str) -> Iterator[Span]:
    """From each "@" outwards, which is where the leftmost matches lie; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The spans of all four patterns by start, then kind; those of one kind never overlap."""
    found = list(emails(text))
    found += [("ip", *m.span()) for m in IP.finditer(text) if is_ip(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# --- the field -----------------------------------------------------------------------------------

LABELS = (*KINDS, "secret")
OUTSIDE = len(LABELS)
MOST = 20
LONGEST = 512
TOKEN = re.compile(r"\w+|\s|[^\w\s]")
TRIGGER = re.compile(r"[0-9@]")
CUE = re.compile(r"(?i)(pass(word|wd)?|pwd|secret|token|api_?key|key)\W{0,4}\Z")
SHAPES = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9]([ -]?[0-9]){13,18}"),
    re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
    re.compile(r"(?=.*[a-f])(?=.*[0-9])[0-9a-f]{16,}"),
    re.compile(r"AKIA[0-9A-Z]{16}"),
    re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9_]{16,}"),
    re.compile(r"[0-9]+"),
)
N_FEATURES = len(SHAPES) + 13
ANY_SHAPE = re.compile("|".join(f"(?:{x.pattern})" for x in SHAPES))


def features(text: str, start: int, end: int, tokens: int) -> list[float]:
    """Of the whole span: its shapes and checks, its length, and what stands around it."""
    own, left, right = text[start:end], text[max(0, start - 16) : start], text[end : end + 2]
    digits = digits_of(own)
    shape = [bool(x.fullmatch(own)) for x in SHAPES]
    cue = bool(CUE.search(left))
    return [
        1, *shape, shape[1] and is_ip(own), shape[2] and luhn(digits), shape[3] and 10 <= len(digits) <= 15,
        cue, cue and any(shape[4:7]), left[-1:].isalnum() or left[-1:] in ("_", "@", "+") and bool(left), right[:1].isalnum() or right[:1] in ("_", "@") and bool(right),
        " " in own, tokens > 1, len(digits) * 2 >= len(own), right[:1] in ("-", ".") and right[1:].isalnum(), left[-1:] in ("-", "."),
    ]


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """The words with a digit or "@", those next to each other joined; linear in the text."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        while b < len(text) and not text[b].isspace():
            b += 1
        if start >= 0 and a - end <= 1:
            end = b
        else:
            if start >= 0:
                yield start, end
            start, end = a, b
    if start >= 0:
        yield start, end


class Tokens:
    """A stretch's tokens, numbered from 0, and its candidate segments: spans of up to MOST tokens and
    LONGEST code points that have one of the shapes."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.found = text, TOKEN.finditer(text, start, end)
        self.cuts: deque[tuple[int, int]] = deque()
        self.opens: deque[bool] = deque()  # whether a candidate may begin with the token
        self.first = self.n = 0  # tokens from ``first`` to ``n`` are held

    def take(self, most: int) -> int:
        """Reads up to ``most`` tokens more; how many there were."""
        got = 0
        for m in islice(self.found, most):
            x = m[0]
            self.cuts.append(m.span())
            self.opens.append(x == "+" or x[0].isalnum())
            got += 1
        self.n += got
        return got

    def forget(self, before: int) -> None:
        while self.first < before:
            self.cuts.popleft()
            self.opens.popleft()
            self.first += 1

    def ending(self, j: int) -> Iterator[tuple[int, list[float]]]:
        """The candidates whose last token is number j - 1, the shortest first: (first token, features)."""
        start, end = self.cuts[j - 1 - self.first]
        if not self.text[start].isalnum():
            return
        text, apart = self.text, False
        for i in range(j - 1, max(-1, j - 1 - MOST), -1):
            start = self.cuts[i - self.first][0]
            if end - start > LONGEST:
                return
            apart |= text[start].isspace()
            if apart and text[start] != "+" and end - start > 40:
                continue  # no shape with blanks is so long
            if self.opens[i - self.first] and ANY_SHAPE.fullmatch(self.text, start, end):
                yield i, features(self.text, start, end, j - i)


class Lattice:
    """A short stretch's tokens and candidates, all at once, to train on."""

    def __init__(self, text: str, start: int, end: int) -> None:
        tokens = Tokens(text, start, end)
        n = tokens.take(10**9)
        self.cuts = list(tokens.cuts)
        ending = [[], *(list(tokens.ending(j)) for j in range(1, n + 1))]
        self.spans = [[i for i, _ in x] for x in ending]  # by end, where they start
        at = [0, *accumulate(map(len, ending))]
        self.rows = [list(range(a, b)) for a, b in pairwise(at)]
        self.f = np.array([f for x in ending for _, f in x], np.float32).reshape(-1, N_FEATURES)


class Field:
    """Weights of span features for each type, and of neighbouring segments' types."""

    def __init__(self) -> None:
        self.w = np.zeros((len(LABELS), N_FEATURES))
        self.t = np.zeros((OUTSIDE + 1, OUTSIDE + 1))  # from, to

    def entities(self, text: str, start: int, end: int, block: int = 256) -> Iterator[Span]:
        """The entities of a stretch's segmentation of the highest score.

        The stretch passes in blocks of tokens. Scores are held for as many tokens as a segment may
        have; back pointers go as soon as all ways that may still win agree on them.
        """
        tokens, kinds, types = Tokens(text, start, end), range(OUTSIDE + 1), range(OUTSIDE)
        into = self.t.T.tolist()  # to, from
        v = {0: [-math.inf] * OUTSIDE + [0.0]}
        back: dict[int, list[tuple[int, int]]] = {}  # by place, of each type: the place and type before
        root = (0, OUTSIDE)

        def settled(node: tuple[int, int], cut: tuple[int, int]) -> Iterator[Span]:
            """The entities on the way from ``root`` to ``cut``, an earlier node of the way to ``node``."""
            nonlocal root
            while node != cut:
                node = back[node[0]][node[1]]
            out = []
            while node != root:
                before = back[node[0]][node[1]]
                if node[1] != OUTSIDE:
                    out.append((LABELS[node[1]], tokens.cuts[before[0] - tokens.first][0], tokens.cuts[node[0] - 1 - tokens.first][1]))
                node = before
            root = cut
            yield from reversed(out)

        while got := tokens.take(block):
            ends = range(tokens.n - got + 1, tokens.n + 1)
            ending = [list(tokens.ending(j)) for j in ends]
            rows = [f for x in ending for _, f in x]
            score = iter((np.array(rows, np.float32) @ self.w.T).tolist() if rows else ())
            enter: dict[int, list[tuple[float, int]]] = {}
            for j, candidates in zip(ends, ending, strict=True):
                last = v[j - 1]
                best, k = max((last[k] + into[OUTSIDE][k], -k) for k in kinds)
                now, ways = [-math.inf] * OUTSIDE + [best], [(0, 0)] * OUTSIDE + [(j - 1, -k)]
                for i, _ in candidates:
                    if i not in enter:
                        enter[i] = [max((v[i][k] + into[y][k], -k) for k in kinds) for y in types]
                    for y, s in zip(types, next(score), strict=True):
                        way, k = enter[i][y]
                        if way + s > now[y]:
                            now[y], ways[y] = way + s, (i, -k)
                v[j], back[j] = now, ways
            n = tokens.n
            for j in [j for j in v if j < n - MOST]:
                del v[j]
            alive = [(j, y) for j, x in v.items() for y in kinds if x[y] > -math.inf]
            top = (n, max(kinds, key=lambda y: v[n][y]))
            way, node = [top], top
            while node != root:
                node = back[node[0]][node[1]]
                way.append(node)
            place = {x: i for i, x in enumerate(way)}
            deepest = 0
            for node in alive:
                while node not in place:
                    node = back[node[0]][node[1]]
                deepest = max(deepest, place[node])
            yield from settled(top, way[deepest])
            for j in [j for j in back if j <= root[0]]:
                del back[j]
            tokens.forget(min(root[0], n - MOST))
        yield from settled(top := (tokens.n, max(kinds, key=lambda y: v[tokens.n][y])), top)

    def gradient(self, x: Lattice, gold: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood: what the gold segmentation has less what is expected."""
        n, s, m = len(x.cuts), x.f @ self.w.T, OUTSIDE + 1
        out = lambda a: np.logaddexp.reduce(a, axis=0)
        fore, back = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        fore[0, OUTSIDE], back[n] = 0, 0
        with np.errstate(invalid="ignore"):
            for j in range(1, n + 1):
                fore[j, OUTSIDE] = out(fore[j - 1] + self.t[:, OUTSIDE])
                ways = [out(fore[i][:, None] + self.t[:, :OUTSIDE]) + s[r] for i, r in zip(x.spans[j], x.rows[j], strict=True)]
                if ways:
                    fore[j, :OUTSIDE] = out(np.array(ways))
            starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
            for j in range(n + 1):
                for i, r in zip(x.spans[j], x.rows[j], strict=True):
                    starts[i].append((j, r))
            for i in range(n - 1, -1, -1):
                ways = [self.t[:, OUTSIDE] + back[i + 1, OUTSIDE]] + [out((self.t[:, :OUTSIDE] + (s[r] + back[j, :OUTSIDE])[None]).T) for j, r in starts[i]]
                back[i] = out(np.array(ways))
            z = out(fore[n])
            gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
            for j in range(1, n + 1):
                gt[:, OUTSIDE] -= np.exp(fore[j - 1] + self.t[:, OUTSIDE] + back[j, OUTSIDE] - z)
                for i, r in zip(x.spans[j], x.rows[j], strict=True):
                    p = np.exp(fore[i][:, None] + self.t[:, :OUTSIDE] + (s[r] + back[j, :OUTSIDE])[None] - z)
                    gt[:, :OUTSIDE] -= p
                    gw -= p.sum(0)[:, None] * x.f[r][None]
        last, j = OUTSIDE, 0
        by_start = {i: (j, y) for i, j, y in gold}
        while j < n:
            to, y = by_start.get(j, (j + 1, OUTSIDE))
            gt[last, y] += 1
            if y != OUTSIDE:
                gw[y] += x.f[x.rows[to][x.spans[to].index(j)]]
            last, j = y, to
        return gw, gt


def example(r: random.Random) -> tuple[str, list[Span]]:
    """A sentence from templates with its entities: one or two, or look-alikes that are none."""
    word = lambda: "".join(r.choice(("th", "er", "an", "on", "re", "in", "st", "la", "ve")) for _ in range(r.randint(1, 4)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 2)) + r.choice("abcdef") + r.choice("0123456789")

    def card(n: int, ok: bool) -> str:
        while luhn(d := num(n)) != ok:
            pass
        gap = r.choice(("", "", " ", "-"))
        return gap.join(d[i : i + 4] for i in range(0, n, 4))

    made = {
        "email": lambda: f"{word()}{r.choice(('.', '_', ''))}{word()}{r.choice(('', num(2)))}@{word()}{r.choice(('', num(1)))}.{r.choice(('com', 'example.org', 'net'))}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(r.choice((14, 15, 16, 16, 16, 19)), True),
        "phone": lambda: r.choice((f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"+{num(2)}-{num(3)}-{num(7)}")),
        "secret": lambda: r.choice(("password=", "token = \"", "api_key: ", "secret=")) + "\0" + r.choice((hexes(18), hexes(40), hexes(32))) if r.random() < 0.7 else "\0AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
    }
    none = (lambda: f"{num(1)}.", lambda: num(4), lambda: f"{num(1)}.{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(3)}-{num(4)}", lambda: card(16, False), lambda: f"{num(2)}.{num(2)}.{num(2)}.9{num(2)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{word()}@", lambda: f"{word()}{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"https://{word()}.com/{num(3)}", lambda: hexes(8), lambda: num(12), lambda: f"key={num(2)}")
    text, spans = "", []
    for _ in range(r.randint(4, 9)):
        kind = r.choice((None, None, "no", "no", *LABELS))
        if kind is None or kind == "no":
            x = word() if kind is None else r.choice(none)()
            text += x
        else:
            x = made[kind]()
            if kind == "secret":
                cue, _, x = x.partition("\0")
                text += cue
            spans.append((kind, len(text), len(text) + len(x)))
            text += x
            if kind == "secret" and cue.endswith('"'):
                text += '"'
        text += r.choice((" ", " ", " ", ", ", ". ", "\n"))
    return text, spans


@lru_cache(maxsize=2)
def trained(sentences: int = 240, rounds: int = 6, seed: int = 7) -> Field:
    """A field trained on sentences from templates by AdaGrad; the same for the same arguments."""
    r, field = random.Random(seed), Field()
    cases = []
    for _ in range(sentences):
        text, spans = example(r)
        for a, b in stretches(text):
            x = Lattice(text, a, b)
            first, last = {s: i for i, (s, _) in enumerate(x.cuts)}, {e: i + 1 for i, (_, e) in enumerate(x.cuts)}
            gold = {(first[s], last[e], LABELS.index(k)) for k, s, e in spans if s in first and e in last and a <= s < b}
            if all(i in x.spans[j] for i, j, _ in gold):
                cases.append((x, gold))
    sums = [np.full_like(field.w, 1e-6), np.full_like(field.t, 1e-6)]
    for _ in range(rounds):
        r.shuffle(cases)
        for x, gold in cases:
            for k, (own, g) in enumerate(zip((field.w, field.t), field.gradient(x, gold), strict=True)):
                g = g - 0.002 * own
                sums[k] += g * g
                own += 0.5 * g / np.sqrt(sums[k])
    return field


def all_spans(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether by a pattern) by start, then kind: the base spans, and those of the
    field that overlap none of them."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    out = [(*x, True) for x in base]
    k, reach = 0, 0  # of the base spans passed, how far they reach
    for a, b in stretches(text):
        for kind, start, end in field.entities(text, a, b):
            while k < len(taken) and taken[k][0] < end:
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= start:
                out.append((kind, start, end, False))
    return sorted(out, key=lambda x: (x[1], LABELS.index(x[0])))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """The input's columns and "spans": an array of (kind, start, end, base) in code points, end
    exclusive, by start and kind. A column "spans" of the input is replaced. Null and empty texts have
    no spans; texts are read whole; repeated rows each get their spans; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[list[str]]) -> Iterator[pa.Array]:
        own = kept_in_worker("pii", lambda: shared.value)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for texts in batches:
            found = [all_spans(x, own) if x else [] for x in texts]
            flat = [x for own_ in found for x in own_]
            spans = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], f.type) for i, f in enumerate(kind)], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), spans)

    return with_last(docs, spans=of_texts(run, SPANS)(F.col(f"`{text_col}`")))
