"""Token counts by finite-state transducers compiled from a BPE tokenizer file.

The tokenizer (a ``tokenizers`` JSON of the word-end BPE kind: NFC, lower
case, white space dropped, contractions / letter runs / single numbers / runs
of other characters, byte alphabet, end-of-word suffix) is compiled into two
deterministic transducers:

* The **lexer** reads character classes and marks where words begin. A text is
  cut into chunks at arbitrary places; each chunk is run from every state at
  once, which gives its state map (entry state -> exit state); the maps are
  composed by a parallel prefix scan, and then every chunk is run once more
  from its true entry state.
* The **BPE transducer** reads the bytes of words, the last one as a symbol of
  its own. Its state holds, for the places where a token still to come may
  begin, the last token of the encoding up to there and how many tokens that
  encoding has; a transition emits the number of tokens the encoding grows by
  (it may shrink). A token is the last one of a prefix's encoding if it and the
  token before it stay apart: no merge across their border comes before both
  are complete. A word's last symbol leads back to the start state, so chunks
  that begin with a word are entered there. Words longer than a lane are cut
  too: such a chunk's map is kept for the entry states that may occur, the maps
  are composed by the same scan, and where a composition meets a state that the
  map lacks, the map grows by it. Lanes step side by side, their counts add up.
  States and transitions are compiled when first met (subset construction on
  demand) and kept by the process.

The tokenizer library is not used to count; tests compare with it.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); the strings of
special tokens in a text count as one token each, as by the library's default;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 2048
#: Characters of a group of texts; a longer text is one group.
GROUP_CHARS = 1 << 18
#: Characters of a lexer chunk, bytes of a BPE lane.
CHUNK, LANE = 64, 256
#: Symbols read at once, those looked back on for a lane's likely entry state.
SLICE, LOOK = 1 << 18, 32
#: States kept between slices.
MOST_STATES = 1 << 17
#: Entry states that a lane's map is kept for; as an entry: none of them.
UNDEFINED = 3

SPACE, LETTER, NUMBER, OTHER, QUOTE, E_, L_, R_, V_, STMD = range(10)
START, IN_LETTERS, IN_OTHER, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
# What a lexer transition says of word beginnings at the place before and at the place read.
NONE, HERE, BEFORE, BOTH = range(4)
# Code points with the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Code points assigned after Python's tables, which the library knows as letters, as numbers, and as the
# lower case of capitals (first, last, lower case of the first; step 1).
LATE_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
                (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
                (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
                (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
                (0x1E5F0, 0x1E5F0))
LATE_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
                (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LATE_CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD),
                 (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
                 (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70),
                 (0x16EA0, 0x16EB8, 0x16EBB))
# Marks that the library's composition, of older tables than Python's, takes for plain characters (first,
# last); among them U+11930, which it does not compose.
LATE_MARKS = (
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C),
    (0x0EBA, 0x0EBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C),
    (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930),
    (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47),
    (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42),
    (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF),
    (0x1E4EC, 0x1E4EF))


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    for ranges, late in ((LATE_LETTERS, LETTER), (LATE_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first:last + 1] = late
    table[list(WHITE_SPACE)] = SPACE
    for chars, kind in (("'", QUOTE), ("e", E_), ("l", L_), ("r", R_), ("v", V_), ("stmd", STMD)):
        table[[ord(c) for c in chars]] = kind
    return table


@lru_cache(1)
def _lexer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of each state and class."""
    letters = (LETTER, E_, L_, R_, V_, STMD)
    after = np.zeros((7, 10), np.uint8)
    says = np.zeros((7, 10), np.uint8)

    def rule(state: int, kinds: Sequence[int], to: int, out: int) -> None:
        after[state, list(kinds)], says[state, list(kinds)] = to, out

    def fresh(state: int, out: int) -> None:
        """The character read begins a word of its own, or is a space."""
        rule(state, letters, IN_LETTERS, out)
        rule(state, [NUMBER], START, out)
        rule(state, [OTHER], IN_OTHER, out)
        rule(state, [QUOTE], AT_QUOTE, out)

    for state in (START, IN_LETTERS, IN_OTHER, AT_QUOTE):
        fresh(state, HERE)
    rule(IN_LETTERS, letters, IN_LETTERS, NONE)
    rule(IN_OTHER, [OTHER, QUOTE], IN_OTHER, NONE)
    rule(AT_QUOTE, [OTHER, QUOTE], IN_OTHER, NONE)
    rule(AT_QUOTE, [STMD], START, NONE)
    for kind, state, end in ((R_, QUOTE_R, E_), (V_, QUOTE_V, E_), (L_, QUOTE_L, L_)):
        rule(AT_QUOTE, [kind], state, NONE)
        fresh(state, BOTH)
        rule(state, letters, IN_LETTERS, BEFORE)
        rule(state, [SPACE], START, BEFORE)
        rule(state, [end], START, NONE)
    return after, says


def prefix_states(maps: np.ndarray) -> np.ndarray:
    """Entry state of every chunk from the chunks' state maps (chunks x states),
    the first entered in START: the maps are composed by doubling strides."""
    total = maps.copy()
    stride = 1
    while stride < len(total):
        total[stride:] = np.take_along_axis(total[stride:], total[:-stride].astype(np.int64), axis=1)
        stride *= 2
    return np.r_[np.array([START], maps.dtype), total[:-1, START]]


def word_begins(points: np.ndarray) -> np.ndarray:
    """Per character (the last must be a space), whether a word begins there."""
    after, says = _lexer()
    n = len(points)
    rows = -(-n // CHUNK)
    kinds = np.zeros(rows * CHUNK, np.uint8)
    kinds[:n] = _classes()[points]
    kinds = np.ascontiguousarray(kinds.reshape(rows, CHUNK).T)
    states = after.shape[0]
    flat_after, flat_says = after.reshape(-1), says.reshape(-1)
    maps = np.tile(np.arange(states, dtype=np.uint8), (rows, 1))
    for kind in kinds:
        maps = flat_after[maps * np.uint8(10) + kind[:, None]]
    state = prefix_states(maps)
    said = np.empty((CHUNK, rows), np.uint8)
    for t, kind in enumerate(kinds):
        at = state * np.uint8(10) + kind
        said[t], state = flat_says[at], flat_after[at]
    said = said.T.reshape(-1)[:n]
    begins = (said == HERE) | (said == BOTH)
    begins[:-1] |= (said[1:] == BEFORE) | (said[1:] == BOTH)
    return begins


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the file: printable ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The BPE transducer of a tokenizer file, compiled on demand."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.suffix = model["end_of_word_suffix"]
        alphabet = _byte_alphabet()
        # a symbol string is a tuple of 0..255, the last one 256 higher at a word's end
        self.token: dict[tuple[int, ...], int] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        names = {}
        for name, number in model["vocab"].items():
            end = name.endswith(self.suffix)
            symbols = [alphabet[c] for c in (name[:-len(self.suffix)] if end else name)]
            if end:
                symbols[-1] += 256
            names[name] = number
            self.token[tuple(symbols)] = number
        for rank, (left, right) in enumerate(model["merges"]):
            whole = names[left + right]
            self.rank[names[left], names[right]] = rank
            if whole not in self.halves:
                self.halves[whole], self.born[whole] = (names[left], names[right]), rank
        self.prefixes = {symbols[:k] for symbols in self.token for k in range(len(symbols))}
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        self._apart: dict[tuple[int, int], bool] = {}
        self._proper: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.columns = np.full(512, -1, np.int32)
        self.n_columns, self.room = 0, 64
        self.table = np.full((1024, self.room), -1, np.int32)  # next state << 8 | tokens + 128
        self.symbols: list[int] = []
        # of a state: the symbols that a token to come may begin with, and from the place before them on
        # the last token (-1: none) and the number of tokens, less that at the end
        self.states: list[tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = [((), (-1,), (0,))]
        self.number = {self.states[0]: 0}

    def _spine(self, token: int, side: int) -> Iterator[tuple[int, float]]:
        """The parts of a token at one border (0: left, 1: right) with the rank of the merge that ends each."""
        dies = float("inf")
        yield token, dies
        while token in self.halves:
            dies = self.born[token]
            token = self.halves[token][side]
            yield token, dies

    def _crossed(self, a: int, b: int, below: float) -> bool:
        """Whether some merge across the border of two neighbours comes first, at a rank under ``below``."""
        right = list(self._spine(b, 0))
        for x, x_dies in self._spine(a, 1):
            for y, y_dies in right:
                rank = self.rank.get((x, y))
                # of equal ranks the merge further left comes first
                if rank is not None and rank < x_dies and rank <= y_dies and rank < below:
                    return True
        return False

    def apart(self, a: int, b: int) -> bool:
        found = self._apart.get((a, b))
        if found is None:
            found = self._apart[a, b] = not self._crossed(a, b, float("inf"))
        return found

    def proper(self, token: int) -> bool:
        """Whether a token's own string is encoded as that token."""
        found = self._proper.get(token)
        if found is None:
            if token not in self.halves:
                found = True
            else:
                a, b = self.halves[token]
                found = self.proper(a) and self.proper(b) and not self._crossed(a, b, self.born[token])
            self._proper[token] = found
        return found

    def _compile(self, state: int, symbol: int) -> int:
        seen, last, counts = self.states[state]
        symbols = (*seen, symbol)
        for size in range(len(symbols), 0, -1):
            token = self.token.get(symbols[-size:])
            if token is None or not self.proper(token):
                continue
            before = last[-size]  # the token that ends where this one begins
            if before < 0 or self.apart(before, token):
                grown = counts[-size] + 1
                break
        else:
            raise ValueError(f"symbol {symbol} is in no token")
        if symbol >= 256:
            return 0 << 8 | grown + 128
        keep = next(k for k in range(len(symbols), -1, -1) if symbols[len(symbols) - k:] in self.prefixes)
        now = (symbols[len(symbols) - keep:], (*last, token)[-keep - 1:],
               tuple(c - grown for c in (*counts, grown)[-keep - 1:]))
        return self._number(now) << 8 | grown + 128

    def _number(self, state: tuple) -> int:
        """The number of a state, a new one if it is met first."""
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
            if to >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return to

    def _column(self, symbols: np.ndarray) -> np.ndarray:
        for s in np.flatnonzero(np.bincount(symbols, minlength=512)):
            if self.columns[s] < 0:
                if self.n_columns == self.room:
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                    self.room *= 2
                self.columns[s] = self.n_columns
                self.symbols.append(int(s))
                self.n_columns += 1
        return self.columns[symbols]

    def _run(self, column: np.ndarray, first: np.ndarray, size: np.ndarray,
             state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens emitted by lanes that enter in the given states, and the states they end in."""
        order = np.argsort(-size, kind="stable")
        first, size, now = first[order], size[order], state[order].astype(np.int32)
        total = np.zeros(len(first), np.int64)
        steps = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(steps), "left")
        for t in range(steps):
            n = alive[t]
            at = now[:n] * self.room + column[first[:n] + t]
            got = self.table.reshape(-1)[at]
            if (got < 0).any():
                for pair in np.unique(at[got < 0]).tolist():
                    s, k = divmod(pair, self.room)
                    self.table[s, k] = self._compile(s, self.symbols[k])
                got = self.table.reshape(-1)[at]
            total[:n] += (got & 255) - 128
            now[:n] = got >> 8
        tokens, ends = np.empty_like(total), np.empty_like(now)
        tokens[order], ends[order] = total, now
        return tokens, ends

    def count(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Tokens emitted per lane. ``begins``: the places, ascending from 0, where lanes begin, inside words or not.

        Lanes are taken in slices of SLICE symbols; only the state at a slice's end goes on to the next."""
        out = np.empty(len(begins), np.int64)
        bounds = np.r_[begins, len(symbols)]
        ends = np.flatnonzero(symbols >= 256)
        entry = self.states[0]
        lo = 0
        while lo < len(begins):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, "right")) - 1)
            if len(self.states) > MOST_STATES:
                self.clear()
            out[lo:hi], entry = self._count_slice(symbols, bounds[lo:hi + 1], ends, entry)
            lo = hi
        return out

    def _count_slice(self, symbols: np.ndarray, bounds: np.ndarray, ends: np.ndarray,
                     entry: tuple) -> tuple[np.ndarray, tuple]:
        """Tokens per lane and the state at the end. A lane's map is kept for the entry states that may occur: that
        after the LOOK symbols before it, that in which the lane before ends from its own such state, and at last
        the true one if it is neither. An undefined entry is the map's last one; maps compose by prefix scan."""
        first, size = bounds[:-1], np.diff(bounds)
        base = max(int(first[0]) - LOOK, 0)
        column = self._column(symbols[base:bounds[-1]])
        last_end = np.searchsorted(ends, first, "left")
        word = np.where(last_end > 0, ends[last_end - 1] + 1, 0) if len(ends) else np.zeros(len(first), np.int64)
        known = word == first  # entered in the start state
        entries = np.full((len(first), UNDEFINED), -1, np.int32)
        exits, tokens = entries.copy(), np.zeros(entries.shape, np.int64)
        open_ = np.flatnonzero(~known)
        back = np.maximum(first[open_] - LOOK, np.maximum(word[open_], base))
        entries[known, 0] = 0
        entries[open_, 0] = self._run(column, back - base, first[open_] - back, np.zeros(len(open_)))[1]
        if not known[0]:
            entries[0, 0], known[0] = self._number(entry), True

        def run(lanes: np.ndarray, k: int) -> None:
            tokens[lanes, k], exits[lanes, k] = self._run(column, first[lanes] - base, size[lanes], entries[lanes, k])

        run(np.arange(len(first)), 0)
        other = np.flatnonzero(~known[1:] & (exits[:-1, 0] != entries[1:, 0])) + 1
        entries[other, 1] = exits[other - 1, 0]
        run(other, 1)
        while True:
            maps = np.full((len(first), UNDEFINED + 1), UNDEFINED, np.uint8)
            for k in range(UNDEFINED):  # exit states as places among the next lane's entries
                for to in reversed(range(UNDEFINED)):
                    meets = (exits[:-1, k] >= 0) & (exits[:-1, k] == entries[1:, to])
                    maps[:-1, k][meets] = to
            maps[known] = maps[known, :1]
            at = prefix_states(maps)
            lost = np.flatnonzero((at[1:] == UNDEFINED) & (at[:-1] != UNDEFINED)) + 1
            if not len(lost):
                break
            entries[lost, 2] = exits[lost - 1, at[lost - 1]]
            run(lost, 2)
        rows = np.arange(len(first))
        return tokens[rows, at], self.states[exits[-1, at[-1]]]


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@lru_cache(1)
def _late() -> tuple[re.Pattern, re.Pattern, dict[str, str]]:
    lower = {chr(c): chr(c - first + to) for first, last, to in LATE_CAPITALS for c in range(first, last + 1)}
    marks = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATE_MARKS)
    return re.compile(f"([{marks}])"), re.compile(f"[{''.join(lower)}]"), lower


def _lower(text: str) -> str:
    """NFC, then each character in lower case by itself (no final sigma)."""
    if text.isascii():
        return text.lower()
    marks, capitals, lower = _late()
    # a plain character composes with nothing and no mark is moved across it
    text = "".join(unicodedata.normalize("NFC", part) for part in marks.split(text)).replace("Σ", "σ").lower()
    return capitals.sub(lambda m: lower[m[0]], text)


def count_group(machine: Transducer, texts: Sequence[str]) -> np.ndarray:
    """Tokens per text without special tokens."""
    low = [_lower(t) for t in texts]
    flat = " ".join(low) + " "
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = word_begins(points)
    solid = np.flatnonzero(_classes()[points] != SPACE)
    counts = np.zeros(len(texts), np.int64)
    if not len(solid):
        return counts
    points, begins = points[solid], begins[solid]
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.cumsum(width) - width
    data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    symbols = np.frombuffer(data, np.uint8).astype(np.int32)
    words = byte_at[begins]
    symbols[np.r_[words[1:], len(symbols)] - 1] += 256
    # lanes: every first word of a text, in between the first word of each LANE bytes, and each LANE bytes of longer words
    text_at = np.cumsum([0, *[len(t) + 1 for t in low]])[:-1]
    text_of = np.searchsorted(text_at, solid[begins], "right") - 1
    stripe = words // LANE
    new = np.r_[True, (text_of[1:] != text_of[:-1]) | (stripe[1:] != stripe[:-1])]
    length = np.diff(np.r_[words, len(symbols)])
    lanes, owner = words[new], text_of[new]
    long = np.flatnonzero(length > LANE)
    if len(long):
        inside = [np.arange(w + LANE, w + n, LANE) for w, n in zip(words[long].tolist(), length[long].tolist())]
        lanes = np.concatenate([lanes, *inside])
        owner = np.concatenate([owner, np.repeat(text_of[long], [len(i) for i in inside])])
        order = np.argsort(lanes, kind="stable")
        lanes, owner = lanes[order], owner[order]
    np.add.at(counts, owner, machine.count(symbols, lanes))
    return counts


def count_texts(path: str, texts: Sequence[str | None]) -> list[int]:
    machine = transducer(path)
    special = re.compile("|".join(map(re.escape, sorted(machine.special, key=len, reverse=True))) or r"(?!)")
    out = [0] * len(texts)
    parts: list[tuple[int, str]] = []
    for i, text in enumerate(texts):
        if text and "<|" in text or machine.special and text and any(s in text for s in machine.special):
            pieces = special.split(text)
            out[i] += len(pieces) - 1
            parts += [(i, p) for p in pieces if p]
        elif text:
            parts.append((i, text))
    parts.sort(key=lambda p: len(p[1]))
    at = 0
    while at < len(parts):
        end, total = at, 0
        while end < len(parts) and (end == at or total + len(parts[end][1]) <= GROUP_CHARS):
            total += len(parts[end][1])
            end += 1
        for (i, _), n in zip(parts[at:end], count_group(machine, [p for _, p in parts[at:end]]).tolist()):
            out[i] += n
        if len(machine.states) > MOST_STATES:
            machine.clear()
        at = end
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit. ``path``: the tokenizer file, readable on every machine."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), sizes, pa.array(count_texts(path, texts.to_pylist()), pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(counted, schema).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
