"""Token counts by a compiled finite-state transducer.

The tokenizer file's byte-pair merges become a deterministic transducer over bytes whose
transitions carry the change in the number of tokens.  It rests on one property of BPE: a
token sequence is what the merges give exactly if every neighbouring pair of it, and every
token alone, is what the merges give for its own string.  So each prefix of a word has one
last token, and what the rest of a word can still change is bounded: the suffixes of the
prefix that begin a longer token, the last token before each, and their counts relative to
the prefix.  That, with the weight of ending the word here, is a state.  States are made when
a text first needs them, equal ones are one, and between chunks the table is emptied when it
passes ``MAX_STATES`` (the counts do not depend on it).

A text is normalised and cut into words by code-point classes (whitespace; letters; single
numbers; runs of the rest; contractions), which mark bytes where any state falls back to the
start.  Bytes are dealt into stripes.  A stripe's state map is the same for every entry state
after its first mark, so all stripes run in lockstep from there; their heads then run from
the exit state of the stripe before, which needs another round only for words that fill whole
stripes: many of them side by side, a few one after the other.  A prefix sum over the weights gives each text's count.

Null text: counted as empty, 0 tokens.  Special-token strings inside a text count as one
token each, as the library does by default; no others are added.  Rows are counted one by one,
repeated rows and null ids included; an empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_bytes

STRIPE = 256
CHUNK = 2 << 20
MAX_STATES = 200_000
LIMIT = 2048
FEW = 64  # heads: with no more lanes than these each is run by itself, through all stripes of its word

#: Code points with the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that are words of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else from U+0100 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(1)
def code_classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    category = unicodedata.category
    for c in range(0x110000):
        kind = category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[WHITE] = _SPACE
    return out


class Merges:
    """The merges of a tokenizer file, and what they give for short strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        symbols = byte_symbols()
        self.byte = symbols
        self.vocab = set(model["vocab"]) - set(self.special)
        missing = [s for s in symbols if s not in self.vocab or s + self.end not in self.vocab]
        if missing:
            raise ValueError("the vocabulary must hold every byte")
        self.begins = {t[:i] for t in self.vocab for i in range(1, len(t.removesuffix(self.end)) + bool(self.end and t.endswith(self.end)))}
        self._own: dict[str, bool] = {}
        self._pair: dict[tuple[str, str], bool] = {}

    def apply(self, symbols: list[str]) -> list[str]:
        rank, none = self.rank, len(self.rank)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), none))
            if (symbols[best], symbols[best + 1]) not in rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def own(self, token: str) -> bool:
        """Is the token what the merges give for its string?"""
        got = self._own.get(token)
        if got is None:
            got = self._own[token] = token in self.vocab and self.apply(self.symbols(token)) == [token]
        return got

    def pair(self, left: str, right: str) -> bool:
        got = self._pair.get((left, right))
        if got is None:
            if len(self._pair) > 300_000:
                self._pair.clear()
            got = self._pair[left, right] = self.apply(self.symbols(left) + self.symbols(right)) == [left, right]
        return got


class Transducer:
    """states: (suffix, ((length, last token, count relative to here), ...), end weight)."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [("", ((0, "", 0),), 0)]
        self.number = {self.states[0]: 0}
        self.columns = np.zeros(256, np.int64)
        self.byte_of = [0]
        self.next = np.full((1024, 64), -1, np.int32)
        self.weight = np.zeros((1024, 64), np.int16)
        self.end = np.zeros(1024, np.int16)
        self.next[0, 0] = 0

    def use(self, data: np.ndarray) -> None:
        """Give every byte of ``data`` a column."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if not self.columns[b]:
                self.columns[b] = len(self.byte_of)
                self.byte_of.append(int(b))
        if len(self.byte_of) > self.next.shape[1]:
            more = 256 + 1 - self.next.shape[1]
            self.next = np.pad(self.next, ((0, 0), (0, more)), constant_values=-1)
            self.weight = np.pad(self.weight, ((0, 0), (0, more)))

    def _last(self, suffix: str, open_: tuple, symbol: str) -> tuple[str, int]:
        """The token that ends here, and its count relative to the state's."""
        m = self.merges
        for length, last, count in open_:
            token = suffix[len(suffix) - length :] + symbol
            if m.own(token) and (not last or m.pair(last, token)):
                return token, count + 1
        raise RuntimeError("no token ends here")

    def add(self, state: int, column: int) -> None:
        suffix, open_, _ = self.states[state]
        m = self.merges
        symbol = m.byte[self.byte_of[column]]
        token, step = self._last(suffix, open_, symbol)
        ended = self._last(suffix, open_, symbol + m.end)[1] - step if m.end else 0
        kept = [(length + 1, last, count - step) for length, last, count in open_ if suffix[len(suffix) - length :] + symbol in m.begins]
        longest = kept[-1][0] if kept else 0
        new = ((suffix + symbol)[len(suffix) + 1 - longest :], ((0, token, 0), *kept), ended)
        found = self.number.get(new)
        if found is None:
            found = self.number[new] = len(self.states)
            self.states.append(new)
            if found >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.weight = np.concatenate([self.weight, np.zeros_like(self.weight)])
                self.end = np.concatenate([self.end, np.zeros_like(self.end)])
            self.end[found] = ended
            self.next[found, 0] = -2  # a space is always a mark
        self.next[state, column] = found
        self.weight[state, column] = step

    def step(self, state: np.ndarray, column: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and weights; a mark ends the word and goes on from the start."""
        out = np.where(mark, self.end[state], 0)
        state = np.where(mark, 0, state)
        new = self.next[state, column]
        lost = new == -1
        if lost.any():
            for pair in set(zip(state[lost].tolist(), column[lost].tolist(), strict=True)):
                self.add(*pair)
            new = self.next[state, column]
        return new, out + self.weight[state, column]

    def _follow(self, i: int, column: np.ndarray, head: np.ndarray, state: np.ndarray, out: np.ndarray, known: np.ndarray, done: np.ndarray) -> None:
        """Run the head of stripe ``i`` and those that its word fills or ends in after it."""
        at = int(state[i - 1]) if i else 0
        while i < len(head) and not done[i]:
            size, weights = int(head[i]), []
            for c in column[i, :size].tolist():
                if self.next[at, c] == -1:
                    self.add(at, c)
                weights.append(self.weight[at, c])
                at = self.next[at, c]
            out[i, :size] = weights
            known[i] = done[i] = True
            if size < STRIPE:  # the mark after the head ends the word
                out[i, size] += self.end[at]
                return
            state[i] = at
            i += 1

    def run(self, column: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The weight of every byte; the last byte must be a space."""
        n = -(-len(column) // STRIPE)
        pad = n * STRIPE - len(column)
        column = np.pad(column, (0, pad)).reshape(n, STRIPE)
        mark = np.pad(mark, (0, pad), constant_values=True).reshape(n, STRIPE)
        out = np.zeros((n, STRIPE), np.int16)
        head = np.where(mark.any(axis=1), mark.argmax(axis=1), STRIPE)
        state = np.zeros(n, np.int64)
        columns, marks = np.ascontiguousarray(column.T), np.ascontiguousarray(mark.T)
        order = np.argsort(head, kind="stable")
        begun = np.searchsorted(head[order], np.arange(STRIPE), "right")
        for i in range(STRIPE):  # after its head, a stripe does not depend on where it came from
            lanes = order[: begun[i]]
            if len(lanes):
                state[lanes], out[lanes, i] = self.step(state[lanes], columns[i, lanes], marks[i, lanes])
        known, done = head < STRIPE, head == 0
        todo = np.flatnonzero(head > 0)
        while len(todo):  # heads, from the exit state of the stripe before
            ready = todo[(todo == 0) | known[todo - 1]]
            if len(ready) <= FEW:
                for i in ready.tolist():
                    self._follow(i, column, head, state, out, known, done)
                todo = todo[~done[todo]]
                continue
            entry = np.where(ready > 0, state[ready - 1], 0)
            for i in range(int(head[ready].max())):
                on = head[ready] > i
                lanes = ready[on]
                entry[on], out[lanes, i] = self.step(entry[on], columns[i, lanes], marks[i, lanes])
            # the mark after the head ends the word that the head carried on
            inner = head[ready] < STRIPE
            out[ready[inner], head[ready[inner]]] += self.end[entry[inner]]
            state[ready[~inner]] = entry[~inner]
            known[ready] = done[ready] = True
            todo = todo[~done[todo]]
        whole = np.flatnonzero(head[1:] == 0) + 1  # the mark at the very start does so as well
        out[whole, 0] += self.end[state[whole - 1]]
        return out.ravel()[: out.size - pad]


@lru_cache(4)
def transducer(path: str) -> Transducer:
    return Transducer(Merges(path))


def _lower(text: str) -> str:
    """Lower case letter by letter, without regard to what stands around."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def marks(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For code points: whether a word begins or white space stands here, and the white space."""
    kind = code_classes()[code]
    start = np.ones(len(code), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER) | (kind[1:] == _SPACE)
    quote = np.flatnonzero(start & (code == 0x27))
    after = np.concatenate([code, np.zeros(3, code.dtype)])
    for c in CONTRACTIONS:
        here = quote
        for i, letter in enumerate(c[1:], 1):
            here = here[after[here + i] == ord(letter)]
        start[here + 1] = False
        here = here[here + len(c) < len(code)]
        start[here + len(c)] = True
    return start, kind == _SPACE


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    t = transducer(path)
    special = regex.compile("|".join(regex.escape(s) for s in t.merges.special)) if t.merges.special else None
    extra = np.zeros(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        if special is not None and "<" in text:
            text, extra[i] = special.subn("\n", text)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        parts.append(_lower(text))
    sizes = np.array([len(p) + 1 for p in parts])
    joined = "\n".join(parts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    start, space = marks(code)
    data = np.frombuffer(joined.encode(), np.uint8)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    mark = np.zeros(len(data), bool)
    mark[at] = start
    if len(t.states) > MAX_STATES:
        t.clear()
    plain = data.copy()
    blank = np.repeat(space, np.diff(np.append(at, len(data))))
    t.use(plain[~blank])
    column = t.columns[data]
    column[blank] = 0
    mark |= blank
    total = np.concatenate([[0], np.cumsum(t.run(column, mark), dtype=np.int64)])
    ends = np.append(at, len(data))[np.cumsum(sizes)]
    return np.diff(np.concatenate([[0], total[ends]])) + extra


def token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``path`` names the tokenizer file
    on each executor."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        plain, edges = data.tobytes(), offsets.tolist()
        found, lo = [], 0
        while lo < len(edges) - 1:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
            found.append(count_tokens([plain[a:b].decode() for a, b in zip(edges[lo:hi], edges[lo + 1 : hi + 1], strict=True)], path))
            lo = hi
        n = np.concatenate(found) if found else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lambda batches: map(count, batches), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
