"""SentencePiece segmentations drawn without replacement, and their decoding."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import freed, mix64, slices

#: Where the model lies on every machine.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations drawn of each text.
TOP_K = 2
#: Sharpness of the distribution over segmentations.
ALPHA = 1.0
#: Lattice edges that a worker remembers; with more it builds fewer lattices again and takes more memory.
REMEMBERED = 4_000_000
#: Code points that are sampled in one go (one text may hold more).
TOGETHER = 300_000
SPACE = "▁"
#: Stands for a literal U+2581 among code points.
LITERAL = 0x110000


def prefix_hashes(chars: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length from 1 on: the places with so many code points ``left``, and a hash of
    the run of that length from each."""
    c = mix64(chars.astype(np.uint64) + np.uint64(1))
    place, h, length = np.arange(len(c)), np.zeros(len(c), np.uint64), 0
    while len(place):
        length += 1
        keep = np.flatnonzero(left[place] >= length)
        place, h = place[keep], h[keep]
        with np.errstate(over="ignore"):
            h = (h ^ c[place + (length - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield place, h


class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback, and a weight for each.

    A piece weighs -alpha * ln(2 + id): ids of a merge model stand by rank, and
    frequencies fall about as one over the rank. A byte weighs as the rarest piece.
    """

    def __init__(self, path: str = MODEL, alpha: float = ALPHA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.ids, self.weight, self.raw = n, {}, [0.0] * n, [b""] * n
        self.byte = [0] * 256
        for i in range(n):
            p = sp.id_to_piece(i)
            self.weight[i] = -alpha * log(2 + i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b], self.raw[i], self.weight[i] = i, bytes([b]), -alpha * log(2 + n)
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.ids[p] = i
                self.raw[i] = p.replace(SPACE, " ").encode()
        self.weights = np.array(self.weight)
        self.bytes_of = np.array([*self.raw, None], object)[:-1]
        self.longest = max(map(len, self.ids))
        self.parts = self._parts()
        self.tables = {}
        by_length: dict[int, list[str]] = {}
        for p in self.ids:
            by_length.setdefault(len(p), []).append(p)
        for length, same in by_length.items():
            chars = np.frombuffer("".join(same).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            left = np.tile(np.arange(length, 0, -1), len(same))
            *_, (_, h) = (x for x, _ in zip(prefix_hashes(chars, left), range(length), strict=False))
            order = np.argsort(h)
            # where the hashes with each value of the top bits begin
            begin = np.searchsorted(h[order] >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32)
            self.tables[length] = (h[order], np.array([self.ids[p] for p in same])[order], begin)

    def matches(self, chars: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length: the places at which a piece of it stands, and the piece."""
        for length, (place, h) in zip(range(1, self.longest + 1), prefix_hashes(chars, left), strict=False):
            if length not in self.tables:
                if length == 1:
                    yield length, np.empty(0, np.int64), np.empty(0, np.int64)
                continue
            keys, ids, begin = self.tables[length]
            top = (h >> np.uint64(46)).astype(np.int64)
            at, end = begin[top], begin[top + 1]
            some = np.flatnonzero(at < end)
            place, h, at, end = place[some], h[some], at[some], end[some]
            found = keys[at] == h
            # few hashes share their top bits; those that do are looked at in turn
            more = np.flatnonzero(~found & (at + 1 < end))
            while len(more):
                at[more] += 1
                found[more] = keys[at[more]] == h[more]
                more = more[~found[more] & (at[more] + 1 < end[more])]
            yield length, place[found], ids[at[found]]

    def _parts(self) -> re.Pattern:
        """Cuts texts where no piece of this vocabulary reaches across: before spaces, around
        characters that only stand alone in pieces, and between letters and those marks that
        no piece joins with a letter."""
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        joined = set("".join(pairs)) - {SPACE}
        letters = {c for c in joined if c.isalpha()}
        marks = joined - letters - {c for a, b in pairs for c, other in ((a, b), (b, a)) if other in letters}
        one = re.escape("".join(c for c in map(chr, range(256)) if c not in joined))
        runs = [f"[{x}]++(?![^{SPACE}{one}{y}])" for x, y in itertools.permutations(re.escape("".join(sorted(c))) for c in (letters, marks)) if x]
        return re.compile(f"{SPACE}*+(?:{'|'.join([*runs, f'[^{SPACE}{one}]+'])})|{SPACE}+" + (f"|[{one}]" if one else ""))

    def units(self, text: str) -> list[str | None]:
        """Parts between which no piece reaches.

        A literal U+2581 is None: it has to be spelled in bytes, as its piece means a space.
        """
        if not text:
            return []
        cut = self.parts.findall
        if SPACE not in text:
            return cut(SPACE + text.replace(" ", SPACE))
        out: list[str | None] = []
        for k, part in enumerate(text.split(SPACE)):
            out += ([None] if k else []) + cut((SPACE if k == 0 else "") + part.replace(" ", SPACE))
        return out

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of a segmentation, with the first space that the encoder put there."""
        return b"".join(self.bytes_of[ids].tolist())

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        return self.spell(np.asarray(ids, np.int64))[1:].decode("utf-8", "surrogatepass")


class _Numbers(dict):
    """Numbers units as they are first asked for; ``new`` has those since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str | None] = []

    def __missing__(self, unit: str | None) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class Lattices:
    """Lattices of the units met so far. An edge of a node is taken with the share of
    the segmentations' total weight that goes through it (backward sums), so that going
    from node to node draws whole segmentations exactly."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        self.v, self.remembered = vocabulary, remembered
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.starts = _Numbers(), np.zeros(1 << 14, np.int32)
        self.n_nodes = self.n_edges = 0
        self.first, self.last = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.cum = np.zeros(1 << 15)
        self.to, self.piece, self.node = (np.zeros(1 << 15, np.int32) for _ in range(3))
        self.logp, self.others = np.zeros(1 << 15, np.float32), np.zeros(1 << 15, np.float32)
        self.spelled: list[list[int]] = []

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            more = np.zeros(max(at + len(values), len(held) * 3 // 2), held.dtype)
            more[:at] = held[:at]
            setattr(self, name, held := more)
        held[at : at + len(values)] = values

    def nodes_of(self, texts_units: list[list[str | None]]) -> list[np.ndarray]:
        """The start node of each unit; units not met before get their lattices first."""
        if self.n_edges > self.remembered:
            self._forget()
        get, known = self.numbers.__getitem__, len(self.numbers)
        asked = [np.fromiter(map(get, u), np.int32, len(u)) for u in texts_units]
        if self.numbers.new:
            self._build(self.numbers.new, known)
            self.numbers.new = []
        return [self.starts[x] for x in asked]

    def _build(self, new: list[str | None], number: int) -> None:
        """Lattices of many units at once, their code points laid end to end; the first has ``number``."""
        lens = np.fromiter((1 if w is None else len(w) for w in new), np.int64, len(new))
        chars = np.frombuffer("".join(SPACE if w is None else w for w in new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(lens)
        starts, n, base = ends - lens, int(ends[-1]), self.n_nodes
        for k, w in enumerate(new):
            if w is None:
                chars[starts[k]] = LITERAL
        self._put("starts", number, (starts + base).astype(np.int32))
        left = np.repeat(ends, lens) - np.arange(n)  # code points up to the unit's end
        src, size, piece, weight = [], [], [], []
        for length, place, found in self.v.matches(chars, left):
            src.append(place)
            size.append(np.full(len(place), length))
            piece.append(found)
            weight.append(self.v.weights[found])
            if length == 1:
                alone = np.ones(n, bool)
                alone[place] = False
                place = np.flatnonzero(alone)
                known, back = np.unique(chars[place], return_inverse=True)
                spelled = [[self.v.byte[b] for b in (SPACE if c == LITERAL else chr(c)).encode("utf-8", "surrogatepass")] for c in known.tolist()]
                names = -np.arange(len(self.spelled) + 1, len(self.spelled) + len(known) + 1)
                self.spelled += spelled
                src.append(place)
                size.append(np.ones(len(place), np.int64))
                piece.append(names[back] if len(place) else place)
                weight.append(np.array([sum(self.v.weight[x] for x in s) for s in spelled])[back] if len(place) else np.zeros(0))
        src, size, piece, weight = (np.concatenate(x) for x in (src, size, piece, weight))
        # backward sums, for all nodes as far from their unit's end at a time
        order = np.argsort((left[src] * (n + 1) + src) * (self.v.longest + 1) + size)
        src, size, piece, weight = src[order], size[order], piece[order], weight[order]
        far = left[src]
        inside = size < far
        heads = np.concatenate([[0], np.flatnonzero(src[1:] != src[:-1]) + 1])
        beta, value = np.zeros(n + 1), weight
        target = np.minimum(src + size, n)
        steps = np.searchsorted(far, np.arange(1, int(far[-1]) + 2))
        starts_of = np.searchsorted(heads, steps)
        for k, (a, b) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True)):
            if a == b:
                continue
            if k:
                value[a:b] += np.where(inside[a:b], beta[target[a:b]], 0.0)
            at = heads[starts_of[k] : starts_of[k + 1]]
            beta[src[at]] = np.logaddexp.reduceat(value[a:b], at - a)
        logp = np.minimum(value - beta[src], 0.0)
        many = np.diff(np.append(heads, len(src)))
        # a node's likeliest edge goes first
        top = np.flatnonzero(logp == np.repeat(np.maximum.reduceat(logp, heads), many))
        node_of = np.repeat(np.arange(len(heads)), many)
        top = top[np.concatenate([[True], node_of[top][1:] != node_of[top][:-1]])]
        swap = np.arange(len(src))
        swap[heads], swap[top] = top, heads
        size, piece, logp, inside = size[swap], piece[swap], logp[swap], inside[swap]
        share = np.exp(logp)
        small = np.where(share > 0.5, 0.0, share)
        others = np.where(share > 0.5, np.repeat(np.add.reduceat(small, heads), many), 1.0 - share)
        # summed node by node, so that the sums don't depend on the units built together
        run, at, left_of = share.copy(), heads, many
        while len(at := at[left_of > 1]):
            left_of = left_of[left_of > 1] - 1
            run[at + 1] += run[at]
            at = at + 1
        run[np.append(heads[1:], len(src)) - 1] = 2.0
        e = self.n_edges
        first, last = np.empty(n, np.int32), np.empty(n, np.int32)
        first[src[heads]], last[src[heads]] = e + heads, e + heads + many
        self._put("first", base, first)
        self._put("last", base, last)
        self._put("cum", e, run)
        self._put("node", e, (base + src).astype(np.int32))
        self._put("to", e, np.where(inside, base + src + size, -1).astype(np.int32))
        self._put("piece", e, piece.astype(np.int32))
        self._put("logp", e, logp.astype(np.float32))
        self._put("others", e, others.astype(np.float32))
        self.n_nodes, self.n_edges = base + n, e + len(src)

    def draw(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one segmentation of the rest of each unit from ``nodes`` (-1: none
        is left), in order, and how many each unit has."""
        count = np.zeros(len(nodes), np.int64)
        idx = np.flatnonzero(nodes >= 0)
        node, seeds, steps = nodes[idx], seeds[idx], []
        while len(idx):
            u = uniform(seeds, len(steps))
            e = self.first[node]
            late = np.flatnonzero(u >= self.cum[e])
            while len(late):
                e[late] += 1
                late = late[u[late] >= self.cum[e[late]]]
            steps.append((idx, e))
            count[idx] += 1
            node = self.to[e]
            go = np.flatnonzero(node >= 0)
            idx, node, seeds = idx[go], node[go], seeds[go]
        place = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for k, (idx, e) in enumerate(steps):
            out[place[idx] + k] = e
        return out, count


def uniform(seeds: np.ndarray, k: int) -> np.ndarray:
    """Numbers strictly between 0 and 1 that depend on the seeds and k alone."""
    with np.errstate(over="ignore"):
        x = mix64(seeds + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


class _Branch:
    """All segmentations that share ``edges[:start]`` and then leave ``edges``, but for
    some that were found already. ``mass`` has the share of those that leave at each
    place from ``start`` on, ``taken`` the edges there that were followed; ``value`` is
    the largest perturbed log probability among them."""

    __slots__ = ("edges", "mass", "seed", "start", "taken", "value")


def _truncated(at: float, top: float, u: float) -> float:
    """A Gumbel variable at ``at`` given that it is below ``top``."""
    return -float(np.logaddexp(-top, log(-log(u)) - at))


def _unit(seed: int, k: int) -> float:
    return ((_mixed(seed, k) >> 12) + 0.5) / float(1 << 52)


def _mixed(*parts: int) -> int:
    """A 64-bit number from several, as ``mix64`` makes it."""
    m, x = 0xFFFFFFFFFFFFFFFF, 0
    for p in parts:
        x = (x + p + 1) & m
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m
        x ^= x >> 32
    return x


class Sampler:
    """Gumbel top-k over whole texts by best-first search.

    Every segmentation of a text has its log probability plus a Gumbel variable as
    value; the k largest are k draws without replacement. They are found from the top
    down, by sets of segmentations with a common start in the lattice: the largest value
    of a set is a Gumbel variable at the log of the set's probability, below that of the
    set it was split from, and belongs to a member drawn in proportion. The search
    follows the open set with the largest value. That bound is attained, so the set
    yields the next segmentation at once; what is left of it, and what leaves the new
    one, become open sets. After k, the largest value still open is the threshold of
    the inclusion scores.
    """

    def __init__(self, vocabulary: Vocabulary, k: int = TOP_K, seed: int = 23, remembered: int = REMEMBERED) -> None:
        self.lat, self.v, self.k, self.seed = Lattices(vocabulary, remembered), vocabulary, k, seed

    def __call__(self, texts: list[str], keys: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k of (ids, log probability, value, log inclusion), best first.

        Log inclusion is that of the probability that the segmentation's value exceeds
        the threshold. An empty text has the empty segmentation, and a text with fewer
        than k segmentations has all of them, with inclusion 1.
        """
        lat = self.lat
        nodes = lat.nodes_of([self.v.units(t) for t in texts])
        roots = [_mixed(self.seed, key) for key in keys]
        found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
        open_: list[list[_Branch]] = [[] for _ in texts]
        todo = [(d, np.empty(0, np.int32), nodes[d], -log(-log(_unit(roots[d], 0)))) for d in range(len(texts))]
        for j in range(self.k):
            if not todo:
                break
            sizes = [len(t[2]) for t in todo]
            with np.errstate(over="ignore"):
                seeds = np.repeat(np.array([_mixed(roots[t[0]], j, 1) for t in todo], np.uint64), sizes)
                seeds += np.concatenate([np.arange(n, dtype=np.uint64) for n in sizes]) * np.uint64(0xC2B2AE3D27D4EB4F)
            edges, count = lat.draw(np.concatenate([t[2] for t in todo]), seeds)
            upto = np.concatenate([[0], np.cumsum(count)])
            a, new = 0, []
            for (d, head, _, value), n in zip(todo, sizes, strict=True):
                whole = edges[upto[a] : upto[a + n]]
                a += n
                if len(head):
                    whole = np.concatenate([head, whole])
                found[d].append((whole, float(lat.logp[whole].sum(dtype=np.float64)), value))
                self._open(open_[d], whole, len(head), value, _mixed(roots[d], j, 2))
                if j + 1 < self.k and open_[d] and (best := max(open_[d], key=lambda x: x.value)).value > -np.inf:
                    edge, t = self._leave(best)
                    unit = int((lat.to[best.edges[:t]] < 0).sum())
                    new.append((d, np.append(best.edges[:t], np.int32(edge)), np.concatenate([lat.to[[edge]], nodes[d][unit + 1 :]]), self._last))
            todo = new
        out = []
        for d in range(len(texts)):
            least = max((x.value for x in open_[d]), default=-np.inf)
            out.append([(self._ids(e), total, value, _log_inclusion(total - least)) for e, total, value in found[d]])
        return out

    def _open(self, into: list[_Branch], edges: np.ndarray, start: int, value: float, seed: int) -> None:
        """Opens the set of what leaves ``edges`` at place ``start`` or later."""
        b = _Branch()
        b.edges, b.start, b.seed, b.taken = edges, start, seed, {}
        # shares fall with each place and are nothing from 1e-308 on
        some = start + 2048
        while True:
            part = edges[:some]
            upto = np.cumsum(self.lat.logp[part], dtype=np.float64)
            if some >= len(edges) or upto[-1] < -700:
                break
            some *= 4
        before = np.concatenate([[0.0], upto[:-1]])[start:] if len(part) else upto
        b.mass = np.exp(before) * self.lat.others[part[start:]]
        self._bound(b, value)
        into.append(b)

    def _bound(self, b: _Branch, below: float) -> None:
        total = float(b.mass.sum())
        b.seed = _mixed(b.seed, 5)
        b.value = _truncated(log(total), below, _unit(b.seed, 1)) if total > 0 else -np.inf

    def _leave(self, b: _Branch) -> tuple[int, int]:
        """Draws where and by which edge the set's best member leaves; the rest stays open."""
        lat, self._last = self.lat, b.value
        run = np.cumsum(b.mass)
        at = min(int(np.searchsorted(run, _unit(b.seed, 2) * run[-1], side="right")), len(run) - 1)
        while b.mass[at] == 0:
            at -= 1
        t = b.start + at
        e = int(b.edges[t])
        node = int(lat.node[e])
        gone = b.taken.setdefault(t, {e})
        left = [x for x in range(int(lat.first[node]), int(lat.last[node])) if x not in gone]
        share = np.exp(lat.logp[left], dtype=np.float64)
        ran = np.cumsum(share)
        got = min(int(np.searchsorted(ran, _unit(b.seed, 3) * ran[-1], side="right")), len(left) - 1)
        gone.add(left[got])
        b.mass[at] = b.mass[at] * (1.0 - share[got] / ran[-1]) if len(left) > 1 else 0.0
        self._bound(b, b.value)
        return left[got], t

    def _ids(self, edges: np.ndarray) -> np.ndarray:
        ids = self.lat.piece[edges]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.int32)
        spelled = [self.lat.spelled[-int(ids[x]) - 1] for x in odd]
        count = np.ones(len(ids), np.int64)
        count[odd] = [len(s) for s in spelled]
        out = np.repeat(ids, count).astype(np.int32)
        place = np.cumsum(count) - count
        for x, s in zip(odd.tolist(), spelled, strict=True):
            out[place[x] : place[x] + len(s)] = s
        return out


def _log_inclusion(x: float) -> float:
    """ln(1 - exp(-exp(x)))."""
    if x > 4:
        return 0.0
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = TOP_K, seed: int = 23, path: str = MODEL, alpha: float = ALPHA, remembered: int = REMEMBERED, together: int = TOGETHER) -> DataFrame:
    """``(doc_id, n_pieces, segmentations, decodes)`` of whole texts.

    segmentations holds up to k distinct ones, best value first: ``ids``, ``logp``,
    ``value``, ``inclusion`` (its logarithm as ``log_inclusion``). n_pieces is the first
    one's length, and decodes tells that all give back the text. The row key that seeds
    the draws is the id; a null id counts as -1. A null or empty text has one empty
    segmentation. Equal rows give equal results on every run, whatever ``remembered``
    and ``together``, which only trade memory for time.
    """
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("logp", pa.float64()), ("value", pa.float64()), ("inclusion", pa.float64()), ("log_inclusion", pa.float64())])
    out = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("segmentations", pa.list_(kind)), ("decodes", pa.bool_())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(Vocabulary(path, alpha), k, seed, remembered)
        spell = sampler.v.spell

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            got = sampler(texts, [-1 if i is None else i for i in ids])
            flat = [s for g in got for s in g]
            lens = np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])])
            values = pa.array(np.concatenate([s[0] for s in flat]))
            num = [pa.array([s[x] for s in flat], pa.float64()) for x in (1, 2)]
            incl = np.array([s[3] for s in flat])
            structs = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(lens, pa.int32()), values), *num, pa.array(np.exp(incl)), pa.array(incl)], fields=list(kind))
            segs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(g) for g in got])]), pa.int32()), structs)
            want = ((" " + t if t else t).encode("utf-8", "surrogatepass") for t in texts)
            same = [all(spell(s[0]) == w for s in g) for g, w in zip(got, want, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(g[0][0]) for g in got], pa.int64()), segs, pa.array(same)], schema=out)

        for b in slices(batches):
            ids, texts, n = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                if ids and n + len(t) > together:
                    yield done(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(t)
                n += len(t)
            if ids:
                yield done(ids, texts)

    schema = "doc_id long, n_pieces long, segmentations array<struct<ids:array<int>,logp:double,value:double,inclusion:double,log_inclusion:double>>, decodes boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(freed(go), schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str = MODEL) -> DataFrame:
    """``(doc_id, rank, text)`` for each segmentation of ``encode``'s result, rank from 1."""
    out = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("text", pa.string())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([vocabulary.decode(x.as_py()) for x in b.column(2)], pa.string())], schema=out)

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode("segmentations").alias("p", "s"))
    return rows.select("doc_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("s.ids").alias("ids")).mapInArrow(freed(go), "doc_id long, rank int, text string")
