"""Exact merge-type subword encoding by backtracking, and decoding.

A sequence of pieces is the encoding of its text if every adjacent pair is, on its own, what
merging its joined text gives. The encoder walks a text with the longest piece at each position
(from an Aho-Corasick automaton), accepts it if it is compatible with the piece before, else tries
the next shorter one; a position from which no continuation exists is marked in a bitfield and
never tried again. Compatibility of two pieces is decided by merging their joined characters anew.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, kept_in_worker, of_texts, pieces, unused, with_last

SPACE = "▁"


@dataclass
class PieceModel:
    """What the encoder needs of a model file; small enough to travel with the tasks."""

    names: list[str]
    scores: list[float]
    kinds: list[int]  # 0 ordinary, 1 unknown, 2 control, 3 byte
    dummy_prefix: bool
    key: str = ""

    @staticmethod
    def load(path: str) -> PieceModel:
        """Reads a merge-type model without character normalisation; other kinds are an error."""
        raw = open(path, "rb").read()
        p = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = p.get_piece_size()
        kind = lambda i: 1 if p.is_unknown(i) else 2 if p.is_control(i) else 3 if p.is_byte(i) else 0
        model = PieceModel([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], [kind(i) for i in range(n)], p.encode("a", out_type=str)[0].startswith(SPACE), hashlib.sha256(raw).hexdigest())
        if 3 not in model.kinds:
            raise ValueError("the model has no byte pieces")
        for probe in ("a", "  bé  c ", "ﬁÅ x"):
            if p.decode(p.encode(probe)) != probe or Codec(model).encode(probe) != p.encode(probe):
                raise ValueError("the model normalises characters or is not of the merge type")
        return model


@dataclass
class Codec:
    model: PieceModel
    most_bytes: int = 60_000_000  # of new known parts, about; as many old ones stay beside them
    most_pairs: int = 200_000
    scores: dict[str, float] = field(init=False)

    def __post_init__(self) -> None:
        m = self.model
        self.ids = {x: i for i, x in enumerate(m.names) if m.kinds[i] == 0}
        self.scores = {x: m.scores[i] for x, i in self.ids.items()}
        self.byte = [m.names.index(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [bytes([self.byte.index(i)]) if k == 3 else b"" if k == 2 else " ⁇ ".encode() if k == 1 else x.replace(SPACE, " ").encode() for i, (x, k) in enumerate(zip(m.names, m.kinds, strict=True))]
        self.size = [len(x) for x in m.names]
        self.trie = ahocorasick.Automaton()
        ordered = sorted(self.ids.items(), key=lambda x: -self.scores[x[0]])
        self.ranks = {x: r for r, (x, _) in enumerate(ordered)}
        self.order: dict[int, int] = {}  # when a piece of several characters is made
        self.halves: dict[int, tuple[int, int]] = {}
        self.alone: dict[str, int] = {}  # pieces that merging makes of their own text
        self.odd: set[int] = set()  # made in another order than by rank
        tied = {a for a, b in zip(ordered, ordered[1:], strict=False) if self.scores[a[0]] == self.scores[b[0]]} | {b for a, b in zip(ordered, ordered[1:], strict=False) if self.scores[a[0]] == self.scores[b[0]]}
        for x, i in ordered:
            last: list[str] = []
            if self.merged(x, last) != [x]:
                continue  # no merge ever makes this piece
            self.trie.add_word(x, i)
            self.alone[x] = i
            if len(x) > 1:
                l, r = (self.ids.get(y, -1 - ord(y[0])) for y in last[-2:])
                self.order[i], self.halves[i] = self.ranks[x], (l, r)
                if (x, i) in tied or {l, r} & self.odd or max(self.order.get(l, -1), self.order.get(r, -1)) > self.ranks[x]:
                    self.odd.add(i)
        self.trie.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.forget()
        # No piece has a space after another character, and none a newline: texts fall apart there.
        apart = all(SPACE not in x[1:] or not x.strip(SPACE) for x in self.ids)
        alone = not any("\n" in x for x in self.ids)
        self.parts = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if apart and alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"[\s\S]+")

    def forget(self) -> None:
        """Lets go of all known parts and pairs."""
        self.known: dict[str, int] = {}
        self.old: tuple[dict[str, int], array, array] = {}, array("i"), array("q", [0])
        self.held, self.pairs = 0, {}
        self.flat, self.ends = array("i"), array("q", [0])

    def age(self) -> None:
        """Known parts become old; old ones that weren't used since they did go."""
        self.old = self.known, self.flat, self.ends
        self.known, self.held, self.flat, self.ends = {}, 0, array("i"), array("q", [0])

    def merged(self, text: str, last: list[str] | None = None) -> list[str]:
        """The text's symbols after all merges: best score first, then leftmost. last: gets both sides of each merge."""
        own, scores = list(text), self.scores
        after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
        heap = [(-scores[p], i, p) for i in range(len(own) - 1) if (p := own[i] + own[i + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if not own[i] or j >= len(own) or own[i] + own[j] != p:
                continue
            if last is not None:
                last += own[i], own[j]
            own[i], own[j], after[i] = p, "", after[j]
            if after[i] < len(own):
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < len(own) and (q := own[a] + own[b]) in scores:
                    heapq.heappush(heap, (-scores[q], a, q))
        return [x for x in own if x]

    def name(self, i: int) -> str:
        """A piece's text; -1 and below stand for characters without a piece."""
        return self.model.names[i] if i >= 0 else chr(-1 - i)

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives these two again.

        Goes back through the merges at the seam, the later one first: no merge across the seam
        may come before the one that used up the piece at its left or right.
        """
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        key, name, order, ranks = a << 22 | b + (1 << 21), self.name, self.order, self.ranks
        if a in self.odd or b in self.odd:
            x, y = name(a), name(b)
            ok = self.merged(x + y) == [x, y]
        else:
            limit = len(ranks)
            while True:
                if (c := ranks.get(name(a) + name(b))) is not None and c < limit:
                    ok = False
                    break
                ra, rb = order.get(a, -1), order.get(b, -1)
                if ra < 0 and rb < 0:
                    ok = True
                    break
                if ra > rb:
                    limit, a = ra, self.halves[a][1]
                else:
                    limit, b = rb + 1, self.halves[b][0]
        self.pairs[key] = ok
        return ok

    def split(self, text: str) -> list[int]:
        """The pieces of a text (spaces already replaced); a character without a piece is -1 - its code."""
        size, known = self.size, self.pairs.get
        options: list[list[int]] = [[] for _ in text]  # by start, shorter first
        for end, i in self.trie.iter(text):
            options[end - size[i] + 1].append(i)
        for at, own in enumerate(options):
            if not own or size[own[0]] != 1:
                own.insert(0, -1 - ord(text[at]))
        n, failed, at, taken, left = len(text), 0, 0, [], [len(options[0])]
        while at < n:
            own, k, placed = options[at], left[-1], False
            while k:
                k -= 1
                i = own[k]
                to = at + (size[i] if i >= 0 else 1)
                if failed >> to & 1:
                    continue
                if taken:
                    j = taken[-1]
                    ok = known(j << 22 | i + (1 << 21))
                    if not (self.fit(j, i) if ok is None else ok):
                        continue
                left[-1] = k
                taken.append(i)
                at, placed = to, True
                left.append(len(options[at]) if at < n else 0)
                break
            if not placed:  # no way on from here, whatever came before
                failed |= 1 << at
                left.pop()
                i = taken.pop()
                at -= size[i] if i >= 0 else 1
        return taken

    def part(self, part: str) -> int:
        """The number of a part of a text; its ids lie in ``flat`` between two ``ends``."""
        got = self.known.get(part)
        if got is None:
            known, flat, ends = self.old
            if (n := known.get(part)) is not None:
                self.flat.extend(flat[ends[n] : ends[n + 1]])
            elif (n := self.alone.get(part)) is not None:
                self.flat.append(n)
            else:
                for i in self.split(part):
                    if i >= 0:
                        self.flat.append(i)
                    else:
                        self.flat.extend(self.byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass"))
            self.ends.append(len(self.flat))
            got = self.known[part] = len(self.ends) - 2
            self.held += 180 + 5 * len(part)
        return got

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of each text's."""
        if self.held > self.most_bytes:
            self.age()
        prefix, get, find = SPACE if self.model.dummy_prefix else "", self.known.get, self.parts.findall
        numbers, counts = [], []
        for text in texts:
            parts = find(prefix + text.replace(" ", SPACE)) if text else []
            own = list(map(get, parts))
            if None in own:
                own = list(map(self.part, parts))
            numbers.append(own)
            counts.append(len(own))
        own = np.fromiter(chain.from_iterable(numbers), np.int64, sum(counts))
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.int32)
        sizes = (ends[1:] - ends[:-1])[own] if len(own) else own
        to = np.zeros(len(own) + 1, np.int64)
        np.cumsum(sizes, out=to[1:])
        at = np.arange(to[-1]) + np.repeat(ends[:-1][own] - to[:-1], sizes) if len(own) else np.zeros(0, np.int64)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        return flat[at], to[first]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Joins the pieces' bytes; every byte that isn't part of valid UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.model.dummy_prefix and raw[:1] == b" " and self.model.names[next(i for i in ids if self.raw[i])].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", raw.decode("utf-8", "surrogateescape"))


def codec(model: PieceModel) -> Codec:
    """The worker process's codec of a model."""
    return kept_in_worker(f"piece_bpe {model.key}", lambda: Codec(model))


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """The input's columns and two more: ids (array of int) and decoded (string).

    The ids are those of the sentencepiece library without begin or end ids. A null or empty text
    has no ids and decodes to the empty text; long texts are encoded whole. Columns of the input
    named ids or decoded are replaced; repeated rows each get their result; an empty table gives an
    empty result. The model is read on the driver and travels with the tasks.
    """
    arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def run(batches: Iterator[list[str]]) -> Iterator[pa.Array]:
        own = codec(model.value)
        for texts in batches:
            for a, b in pieces(texts):
                ids, ends = own.encode_many(texts[a:b])
                decoded = [own.decode(ids[i:j].tolist()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], ["ids", "decoded"])

    both = unused(docs, "__encoded")
    out = docs.withColumn(both, of_texts(run, "struct<ids:array<int>,decoded:string>")(F.col(f"`{text_col}`")))
    return with_last(out, ids=F.col(both)["ids"], decoded=F.col(both)["decoded"]).drop(both)
