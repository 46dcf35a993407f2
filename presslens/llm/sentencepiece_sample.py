"""SentencePiece segmentations sampled without replacement, and decoding.

A text is normalised as the model says (identity, a space before the text,
spaces as U+2581); its lattice has a node per character border and an arc per
piece. Arcs have the piece's log-probability: its score in a unigram model;
for a BPE model, whose scores are merge ranks, Zipf's law over the ranks. A
character in no piece is spelt by byte pieces.

``k`` distinct segmentations are drawn by the Gumbel-top-k trick, top down
(Kool et al. 2019; A* sampling, Maddison et al. 2014). Backward sums over the
lattice give every partial path the log-mass of its completions. The root has
a Gumbel value; a node's children get Gumbel values under the condition that
their maximum is the node's. The search always expands the open branch of
greatest value: a branch keeps its value along the child of greatest value
down to a complete segmentation, which is the next sample, and leaves the
other children open. The path's choices do not depend on its value, and the
best of the children left open at a node has a Gumbel value with their summed
mass, below that of the path; so a path is drawn at once, and then one value
per node of it. The first k complete paths are a sample without
replacement in proportion to their probabilities, and with ``kappa``, the
greatest value still open, ``1 - exp(-exp(log_prob - kappa))`` is a sample's
inclusion score (1 if nothing is open).

Random numbers come from a counter hash of the row's seed, the sample's number
and the place in the text, so a row draws the same whatever batch it is in.

The lattice falls apart between characters that are neighbours in no piece
(such as a letter and U+2581). Distinct stretches between them are searched for pieces
once per group of texts, and all stretches of a group are drawn side by side.

Defined cases: null and empty texts have no segmentation but the empty one
(one sample of no pieces, log-probability 0, inclusion 1); a text with fewer
than k segmentations gives all of them; rows with the same id draw from the
same seed; an empty table gives an empty result. A literal U+2581 decodes to a
space, as by the library.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import chunks_by_bytes, giving_back

SAMPLES = 2
SEED = 3
#: Bytes of a group of texts; a longer text is one group.
GROUP_CHARS = 1 << 18
#: Arcs of known stretches kept between groups (some 32 bytes each).
MOST_ARCS = 1 << 20
BAR = "▁"

_M = np.uint64(0x9E3779B97F4A7C15)
_SPELT = 1 << 24  # marks a character spelt by bytes
_LINEAR = 24  # distance up to which backward sums can't underflow: no piece has less than exp(-28)


def _mix(x: np.ndarray) -> np.ndarray:
    """Counter hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) from hashed counters."""
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class _Strings:
    """Open-addressing table from hashes of code-point strings to piece numbers (-1: only a prefix)."""

    def __init__(self, pieces: dict[str, int]):
        values = {p[:n]: -1 for p in pieces for n in range(1, len(p))} | pieces
        self.bits = max(10, (len(values) * 4).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.value = np.full(1 << self.bits, -2, np.int32)
        for s, v in values.items():
            h = 0
            for c in s:
                h = (h * int(_M) + ord(c)) & (1 << 64) - 1
            at = self._slot(np.array([h], np.uint64))[0]
            while self.value[at] != -2:
                if self.key[at] == h:
                    raise ValueError("two strings have one hash")
                at = at + 1 & (1 << self.bits) - 1
            self.key[at], self.value[at] = h, v

    def _slot(self, h):
        return ((h ^ (h >> np.uint64(32))) * _M >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Piece number, -1 for a mere prefix of pieces, -2 for neither."""
        at = self._slot(h)
        out = self.value[at]
        todo = np.flatnonzero((out != -2) & (self.key[at] != h))
        while len(todo):
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
            out[todo] = self.value[at[todo]]
            todo = todo[(out[todo] != -2) & (self.key[at[todo]] != h[todo])]
        return out


class Model:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.known = _Known()
        self.strings = _Strings({sp.id_to_piece(i): i for i in plain})
        score = np.array([sp.get_score(i) for i in range(n)])
        if (score[plain] <= 0).all() and len({*score[plain]}) > 0.9 * len(plain) and (score[plain] % 1 == 0).all():
            ranks = 1 - score  # merge ranks
            self.log_p = -np.log(ranks) - np.log((1 / ranks[plain]).sum())
        else:
            self.log_p = score
        self.log_spelt = float(self.log_p[plain].min()) - 1
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.longest = max(len(sp.id_to_piece(i)) for i in plain)
        self.bytes_of = [sp.id_to_piece(i).replace(BAR, " ").encode() for i in range(n)]
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of[i] = b""
        for b, i in enumerate(self.byte.tolist()):
            self.bytes_of[i] = bytes([b])

        longer = [sp.id_to_piece(i) for i in plain if len(sp.id_to_piece(i)) > 1]
        letters = sorted(set("".join(longer)))
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.pair = np.zeros((len(letters) + 1) ** 2, bool)
        for p in longer:
            at = self.letter[[ord(c) for c in p]]
            self.pair[at[:-1] * (len(letters) + 1) + at[1:]] = True

    def joined(self, points: np.ndarray) -> np.ndarray:
        """Whether some piece holds two neighbours, for each character but the first."""
        at = self.letter[points]
        return self.pair[at[:-1] * round(len(self.pair) ** 0.5) + at[1:]]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a piece sequence; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


@dataclass
class Lattice:
    """Distinct stretches laid end to end; arcs in the order of their nodes, longer ones first."""

    first: np.ndarray  # per node: its first arc (one more entry at the end)
    size: np.ndarray  # per arc: characters
    piece: np.ndarray  # per arc: piece number, or _SPELT
    log_p: np.ndarray  # per arc: log-probability given its node
    upto: np.ndarray  # per arc: probability of the node's arcs up to this one
    others: np.ndarray  # per arc: log-probability of the node's other arcs


def _arcs(m: Model, points: np.ndarray, to_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, node, size, piece) of all arcs, node by node."""
    h = points.astype(np.uint64)
    at = np.arange(len(points))
    found = []
    for size in range(1, m.longest + 1):
        if size > 1:
            fits = to_end[at] >= size
            at = at[fits]
            h = h[fits] * _M + points[at + (size - 1)]
        piece = m.strings.get(h)
        hit = piece >= 0
        if size == 1:
            found.append((at, np.where(hit, piece, _SPELT)))
        else:
            found.append((at[hit], piece[hit]))
        on = piece != -2
        at, h = at[on], h[on]
        if not len(at):
            break
    counts = np.zeros(len(points), np.int64)
    for nodes, _ in found:
        counts[nodes] += 1
    first = np.r_[0, np.cumsum(counts)]
    node, sizes, pieces = (np.empty(first[-1], t) for t in (np.int64, np.int32, np.int32))
    free = first[:-1].copy()
    for size in range(len(found), 0, -1):
        nodes, piece = found[size - 1]
        place = free[nodes]
        node[place], sizes[place], pieces[place] = nodes, size, piece
        free[nodes] += 1
    return first, node, sizes, pieces


def lattice(m: Model, points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Lattice:
    """``points``: code points of the stretches; ``begin``, ``length``: theirs."""
    to_end = np.repeat(begin + length, length) - np.arange(len(points))
    first, node, size, piece = _arcs(m, points, to_end)
    if not len(node):
        none = np.zeros(0)
        return Lattice(first, size, piece, none, none, none)
    weight = np.where(piece == _SPELT, m.log_spelt, m.log_p[np.minimum(piece, len(m.log_p) - 1)])
    # backward sums, for all stretches by distance to their end
    distance = to_end[node]
    most = int(distance.max())
    order = np.argsort(distance.astype(np.uint16) if most < 1 << 16 else distance, kind="stable")
    target = node + size
    target[distance == size] = len(points)  # a stretch's end, whose log-mass is 0
    w, to, own = weight[order], target[order], node[order]
    group = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    cuts = np.searchsorted(distance[order], np.arange(1, most + 2))
    group_cuts = np.searchsorted(group, cuts)
    share = np.exp(w)
    mass, log_mass = np.ones(len(points) + 1), np.zeros(len(points) + 1)
    for d in range(most):
        part = slice(cuts[d], cuts[d + 1])
        begins = group[group_cuts[d]:group_cuts[d + 1]]
        nodes = own[begins]
        if d < _LINEAR:
            mass[nodes] = np.add.reduceat(share[part] * mass[to[part]], begins - part.start)
            continue
        if d == _LINEAR:
            log_mass = np.log(mass)
        value = w[part] + log_mass[to[part]]
        top = np.maximum.reduceat(value, begins - part.start)
        counts = np.diff(np.r_[begins, part.stop])
        log_mass[nodes] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), begins - part.start))
    if most <= _LINEAR:
        log_mass = np.log(mass)
    log_p = weight + log_mass[target] - log_mass[node]
    p = np.exp(log_p)
    total = np.cumsum(p)
    upto = total - np.r_[0.0, total][first[node]]
    # beside a likely arc the others are added up, so that a small sum is exact
    likely = p >= 0.9
    rest = np.add.reduceat(np.where(likely, 0.0, p), first[:-1])
    with np.errstate(divide="ignore"):
        others = np.log(np.where(likely, rest[node], 1 - p))
    return Lattice(first, size, piece, log_p, upto, others)


class _Known:
    """Lattices of the stretches that a process met lately, laid end to end.
    Beyond MOST_ARCS all are forgotten before the next group."""

    FIELDS = ("size", "piece", "log_p", "upto", "others")

    def __init__(self) -> None:
        self.node: dict[int, int] = {}  # hash of a stretch -> its first node
        self.first = np.zeros(1, np.int64)
        self.n_nodes = self.n_arcs = 0
        room = MOST_ARCS + MOST_ARCS // 4
        self.arcs = {"size": np.zeros(room, np.int32), "piece": np.zeros(room, np.int32)} | {
            c: np.zeros(room) for c in self.FIELDS[2:]}

    @staticmethod
    def _grown(x: np.ndarray, need: int) -> np.ndarray:
        return x if len(x) >= need else np.concatenate([x, np.zeros(max(need, len(x) * 5 // 4) - len(x), x.dtype)])

    def forget(self) -> None:
        """Empty, with the room it has."""
        self.node, self.n_nodes, self.n_arcs = {}, 0, 0

    def add(self, kinds: list[int], begin: np.ndarray, new: Lattice) -> None:
        n, n_arcs = len(new.first) - 1, len(new.size)
        self.first = self._grown(self.first, self.n_nodes + n + 1)
        self.first[self.n_nodes:self.n_nodes + n + 1] = new.first + self.n_arcs
        for c in self.FIELDS:
            self.arcs[c] = self._grown(self.arcs[c], self.n_arcs + n_arcs)
            self.arcs[c][self.n_arcs:self.n_arcs + n_arcs] = getattr(new, c)
        self.node.update(zip(kinds, (begin + self.n_nodes).tolist()))
        self.n_nodes += n
        self.n_arcs += n_arcs

    def lattice(self) -> Lattice:
        return Lattice(self.first, **self.arcs)


class _Group:
    """Texts of a group, their stretches and lattice."""

    def __init__(self, m: Model, texts: Sequence[str]):
        self.model = m
        flat = "".join([BAR + t.replace(" ", BAR) if t else "" for t in texts])
        self.points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.points)
        self.text_size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.text_end = np.cumsum(self.text_size)
        self.text_at = self.text_end - self.text_size
        cut = np.r_[True, ~m.joined(self.points)] if n else np.zeros(0, bool)
        cut[self.text_at[self.text_size > 0]] = True
        self.at = np.flatnonzero(cut)  # stretches by place
        self.size = np.diff(np.r_[self.at, n])
        if n:
            h = self.points.astype(np.uint64)
            place = np.arange(n) - np.repeat(self.at, self.size)
            kind = np.add.reduceat(_mix(h + place.astype(np.uint64) * _M), self.at) ^ (self.size.astype(np.uint64) * _M)
            kinds, example, kind = np.unique(kind, return_index=True, return_inverse=True)
        else:
            kinds = example = kind = np.zeros(0, np.int64)
        if m.known.n_arcs > MOST_ARCS:
            m.known.forget()
        names = kinds.tolist()
        begin_at = np.array([m.known.node.get(x, -1) for x in names], np.int64)
        new = np.flatnonzero(begin_at < 0)
        if len(new):
            length = self.size[example[new]]
            begin = np.cumsum(length) - length
            source = np.repeat(self.at[example[new]] - begin, length) + np.arange(int(length.sum()))
            begin_at[new] = begin + m.known.n_nodes
            m.known.add([names[i] for i in new.tolist()], begin, lattice(m, self.points[source], begin, length))
        self.lattice = m.known.lattice()
        self.node_shift = begin_at[kind] - self.at  # place in the group -> node


def _gumbel_below(log_mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of location ``log_mass`` under the condition that they are below ``top``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(log_mass == -np.inf, -np.inf, log_mass - np.log(np.exp(log_mass - top) - np.log(u)))


class _Open:
    """The best open branches of every text, best first. A branch is what is
    left of a node: its arcs but those in ``closed``."""

    def __init__(self, n_texts: int, width: int):
        self.value = np.full((n_texts, width), -np.inf)
        self.at = np.zeros((n_texts, width), np.int64)
        self.before = np.zeros((n_texts, width))  # log-probability of the path up to the node
        self.sample = np.full((n_texts, width), -1, np.int64)  # the sample whose path it left
        self.closed = np.full((n_texts, width, width), -1, np.int64)

    def pop(self) -> tuple[np.ndarray, ...]:
        best = tuple(x[:, 0].copy() for x in (self.value, self.at, self.before, self.sample, self.closed))
        for x, empty in ((self.value, -np.inf), (self.at, 0), (self.before, 0.0), (self.sample, -1), (self.closed, -1)):
            x[:, :-1] = x[:, 1:]
            x[:, -1] = empty
        return best

    def push(self, texts: np.ndarray, value, at, before, sample: int, closed: np.ndarray) -> None:
        """One branch for each of ``texts``; the worst of a text is dropped (no later pop can reach it)."""
        worse = self.value[texts, -1] < value
        texts, value, at, before, closed = texts[worse], value[worse], at[worse], before[worse], closed[worse]
        self.value[texts, -1], self.at[texts, -1], self.before[texts, -1] = value, at, before
        self.sample[texts, -1] = sample
        self.closed[texts, -1] = -1
        self.closed[texts, -1, :closed.shape[1]] = closed
        order = np.argsort(-self.value[texts], axis=1, kind="stable")
        for x in (self.value, self.at, self.before, self.sample):
            x[texts] = np.take_along_axis(x[texts], order, 1)
        self.closed[texts] = np.take_along_axis(self.closed[texts], order[:, :, None], 1)


def _choose_open(lat: Lattice, first: np.ndarray, n_arcs: np.ndarray, closed: np.ndarray, u: np.ndarray):
    """One of a node's arcs that are not closed, by probability, and the log-probability of those then left."""
    arcs = first[:, None] + np.arange(int(n_arcs.max()))
    free = (np.arange(arcs.shape[1]) < n_arcs[:, None]) & ~(arcs[:, :, None] == closed[:, None, :]).any(2)
    p = np.where(free, np.exp(lat.log_p[np.where(free, arcs, 0)]), 0.0)
    upto = np.cumsum(p, axis=1)
    pick = np.argmax((upto > u[:, None] * upto[:, -1:]) & free, axis=1)
    rows = np.arange(len(arcs))
    p[rows, pick] = 0.0
    with np.errstate(divide="ignore"):
        return arcs[rows, pick], np.log(p.sum(1))


def sample_group(m: Model, texts: Sequence[str], seeds: np.ndarray, k: int = SAMPLES):
    """For each sample: (texts that have it, piece ids of all texts end to end,
    where each text's end, log-probabilities, inclusion scores)."""
    group = _Group(m, texts)
    lat = group.lattice
    n_texts = len(texts)
    seeds = seeds.astype(np.int64).view(np.uint64)
    drawn: list[np.ndarray] = []  # per sample: piece at each place of the group where one begins, else -1
    values, log_probs = [], []
    stretch_at = np.repeat(np.arange(len(group.at)), group.size)  # place -> stretch
    open_ = _Open(n_texts, k)
    root = -np.log(-np.log(_uniform(seeds + _M)))
    for number in range(k):
        if number:
            top, node_at, so_far, left, closed = open_.pop()
        else:
            top, node_at, so_far = root, group.text_at.copy(), np.zeros(n_texts)
        going = np.flatnonzero(top > -np.inf)
        own = _mix(seeds + np.uint64((number + 2) * 0xD1342543DE82EF95 & (1 << 64) - 1))

        def uniform(text: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
            return _uniform(own[text] + (at - group.text_at[text]).astype(np.uint64) * _M + np.uint64(salt << 56))

        marks = np.full(len(group.points), -1, np.int32)
        at = node_at.copy()
        if number and len(going):
            for t, sample in zip(going.tolist(), left[going].tolist()):  # what it shares with the sample that it left
                marks[group.text_at[t]:at[t]] = drawn[sample][group.text_at[t]:at[t]]
            node = node_at[going] + group.node_shift[stretch_at[node_at[going]]]
            first = lat.first[node]
            arc, rest = _choose_open(lat, first, lat.first[node + 1] - first, closed[going], uniform(going, node_at[going], 2))
            value = _gumbel_below(so_far[going] + rest, top[going], uniform(going, node_at[going], 3))
            also = np.sort(np.concatenate([closed[going], arc[:, None]], axis=1), axis=1)[:, ::-1][:, :k]
            open_.push(going, value, node_at[going], so_far[going], number, also)
            marks[node_at[going]] = lat.piece[arc]
            so_far[going] += lat.log_p[arc]
            at[going] += lat.size[arc]
        # draw the rest of the path, all stretches side by side
        rest = going[at[going] < group.text_end[going]]
        if len(rest):
            stretch = stretch_at[at[rest]]
            count = np.searchsorted(group.at, group.text_end[rest]) - stretch
            begun = np.cumsum(count) - count
            lane_text = np.repeat(rest, count)
            lane = np.arange(len(lane_text)) + np.repeat(stretch - begun, count)
            lane_at = group.at[lane]
            lane_at[begun] = at[rest]
            lane_end = group.at[lane] + group.size[lane]
            shift, counter = group.node_shift[lane], own[lane_text] - group.text_at[lane_text].astype(np.uint64) * _M
            taken = np.full(len(group.points), -1, np.int64)
            while len(lane_at):
                node = lane_at + shift
                arc, last = lat.first[node], lat.first[node + 1] - 1
                u = _uniform(counter + lane_at.astype(np.uint64) * _M)
                more = np.flatnonzero((u >= lat.upto[arc]) & (arc < last))
                while len(more):
                    arc[more] += 1
                    more = more[(u[more] >= lat.upto[arc[more]]) & (arc[more] < last[more])]
                taken[lane_at] = arc
                lane_at = lane_at + lat.size[arc]
                on = np.flatnonzero(lane_at < lane_end)
                lane_at, lane_end, shift, counter = lane_at[on], lane_end[on], shift[on], counter[on]
            places = np.flatnonzero(taken >= 0)
            arc = taken[places]
            marks[places] = lat.piece[arc]
            begins = np.searchsorted(places, at[rest])
            gains = lat.log_p[arc]
            upto = np.cumsum(gains) - gains
            text = np.repeat(np.arange(len(rest)), np.diff(np.r_[begins, len(places)]))
            before = upto - upto[begins][text] + so_far[rest][text]
            # what each node leaves open has the value of its best
            value = _gumbel_below(before + lat.others[arc], top[rest][text], uniform(rest[text], places, 1))
            for _ in range(k - number):
                best = np.maximum.reduceat(value, begins)
                has = np.flatnonzero(best > -np.inf)
                if not len(has):
                    break
                hits = np.flatnonzero(value == best[text])
                hit = hits[np.searchsorted(text[hits], has)]
                open_.push(rest[has], best[has], places[hit], before[hit], number, arc[hit][:, None])
                value[hit] = -np.inf
            so_far[rest] += np.add.reduceat(gains, begins)
        drawn.append(marks)
        values.append(top)
        log_probs.append(so_far)
    kappa = open_.value[:, 0]
    out = []
    for marks, top, log_prob in zip(drawn, values, log_probs):
        with np.errstate(over="ignore"):
            score = np.where(np.isfinite(kappa), -np.expm1(-np.exp(np.minimum(log_prob - kappa, 700.0))), 1.0)
        out.append((top > -np.inf, *_ids(m, group, marks), log_prob, score))
    return out


def _ids(m: Model, group: _Group, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and where each text's end."""
    at = np.flatnonzero(marks >= 0)
    piece = marks[at]
    spelt = piece == _SPELT
    counts = np.ones(len(at), np.int64)
    if spelt.any():
        chars = group.points[at[spelt]]
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        counts[spelt] = width
        ids = np.repeat(piece, counts)
        data = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        ids[ids == _SPELT] = m.byte[np.frombuffer(data, np.uint8)]
        piece = ids
    upto = np.r_[0, np.cumsum(counts)]
    return piece.astype(np.int32), upto[np.searchsorted(at, group.text_end)]


def groups(sizes: Sequence[int]) -> Iterator[slice]:
    """Slices of a batch of about GROUP_CHARS."""
    return chunks_by_bytes(sizes, GROUP_CHARS)


SAMPLE = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("log_prob", T.DoubleType()),
                       T.StructField("inclusion", T.DoubleType()), T.StructField("round_trip", T.BooleanType())])


def sampled_batch(m: Model, texts: Sequence[str], seeds: np.ndarray, k: int) -> pa.Array:
    """The column ``samples`` of a group of texts."""
    found = sample_group(m, texts, seeds, k)
    ids, sizes, log_prob, score, exact, owner = [], [], [], [], [], []
    for present, flat, ends, log_p, inclusion in found:
        begins = np.r_[0, ends[:-1]]
        own = np.flatnonzero(present)
        owner.append(own)
        sizes.append((ends - begins)[own])
        ids.append(flat)
        log_prob.append(log_p[own])
        score.append(inclusion[own])
        exact.append([m.decode(flat[begins[t]:ends[t]].tolist()) == texts[t].replace(BAR, " ") for t in own.tolist()])
    owner_ = np.concatenate(owner)
    order = np.argsort(owner_, kind="stable")
    sizes_ = np.concatenate(sizes)
    pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes_)], pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    rows = pa.StructArray.from_arrays(
        [pieces, pa.array(np.concatenate(log_prob)), pa.array(np.concatenate(score)), pa.array(np.concatenate(exact), pa.bool_())],
        names=["ids", "log_prob", "inclusion", "round_trip"]).take(pa.array(order))
    per_text = np.bincount(owner_, minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text)], pa.int32()), rows)


def sample_segmentations(docs: DataFrame, path: str, keep: Sequence[str], k: int = SAMPLES, seed: int = SEED,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``_row`` (a struct of the ``keep`` columns) and ``samples``, an array of
    (ids, log_prob, inclusion, round_trip) in the order drawn. ``path``: the
    model file, readable on every machine."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                         F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("_seed"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("_text")).to_pylist()
            for own in groups(sizes):  # only a group's texts become Python strings at a time
                part = batch.slice(own.start, own.stop - own.start)
                seeds = part.column("_seed").to_numpy(zero_copy_only=False)
                samples = sampled_batch(m, part.column("_text").to_pylist(), seeds, k)
                yield pa.RecordBatch.from_arrays([part.column("_row"), samples], names=["_row", "samples"])
            pa.default_memory_pool().release_unused()

    return packed.mapInArrow(giving_back(sampled), T.StructType([packed.schema["_row"], T.StructField("samples", T.ArrayType(SAMPLE))]))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of the piece ids in ``ids_col``; null ids give a null text."""
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_pylist()
            texts = pa.array([None if x is None else m.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["_row", out])

    kept = [c for c in rows.columns if c != out]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(ids_col).alias("_ids"))
    return packed.mapInArrow(decoded, T.StructType([packed.schema["_row"], T.StructField(out, T.StringType())])).select("_row.*", out)
