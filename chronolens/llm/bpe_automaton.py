"""Byte-pair encoding as a deterministic automaton over tokens.

The merge list is compiled by successive merge gadgets. The automaton starts
with one state that every byte loops on. The gadget of merge ``(u, v) -> w``
  * splits the state that ``u`` leads to and takes the arc ``v`` from the copy,
  * gives every state that still has an arc ``u`` an arc ``w``,
  * lets ``w`` lead to the state that ``v`` led to before the split.
After each gadget a token leads to one state wherever it is read, so a state is
named by the token last read and the arcs are a relation on pairs of tokens.
Its full table would have billions of cells; the gadgets are kept instead
(``left``, ``right``, ``rank``, ``removed``), and a cell is worked out from them
when first asked for and then stays in the transition table.

``compiled`` makes the table in full for the first so many merges; the tests hold cells against it.

A sequence of tokens is what BPE makes of its bytes exactly if the automaton
accepts it, and each byte string has one such sequence. So each prefix of a
pre-split word leads to one state, and encoding is one pass over the bytes
that finds the state of each prefix from those before it: of the tokens that end
there, which a second table (Aho and Corasick's) gives from the longest on, it is the
one that has an arc from the state before it. Nothing is taken back. Decoding
emits the arcs' labels.

Texts: null counts as empty. Empty texts have no ids. Texts of any length are
encoded whole; strings of added tokens inside a text become those tokens, as in
the tokenizers library by default. Repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pre-split pattern of byte-level BPE.
PRESPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank between two visible characters always starts a pre-split word.
_SURE_BREAK = re.compile(r"(?<=\S) (?=\S)")
_LATE = 1 << 60
#: the transition table remembers at most 2^CELLS cells, at nine bytes
CELLS = 21


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeAutomaton:
    """The compiled automaton of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if model["type"] != "BPE" or spec["normalizer"] or not plain or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without normalizer are supported")
        alphabet = _byte_alphabet()
        self.label = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items()}
        self.token = {b: i for i, b in self.label.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.label.update({i: s.encode() for s, i in self.special.items()})
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max(self.label) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [0] * size
        self.removed: dict[int, int] = {}
        for at, pair in enumerate(model["merges"], 1):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(at, model["vocab"][u], model["vocab"][v], model["vocab"][u + v])
        self._table: dict[int, bool] = {}
        self._split = regex.compile(PRESPLIT).findall
        self.arrays = self._tables()

    def _gadget(self, at: int, u: int, v: int, w: int) -> None:
        self.removed.setdefault(u << 20 | v, at)
        if not self.rank[w] and len(self.label[w]) > 1:
            self.left[w], self.right[w], self.rank[w] = u, v, at

    def _arc(self, state: int, label: int) -> bool:
        """Does the state that token ``state`` leads to have the arc ``label``? Gadgets are undone from the latest on."""
        rank, before = self.rank, _LATE
        while True:
            cut = self.removed.get(state << 20 | label)
            if cut is not None and cut < before:
                return False
            a, b = rank[state], rank[label]
            if a == b == 0:
                return True
            if a > b:  # this state began as a copy of its right part's
                before, state = a, self.right[state]
            elif b > a:  # this arc came where the left part's arc was left
                before, label = b + 1, self.left[label]
            else:
                before, state, label = a, self.right[state], self.left[label]

    def arc(self, state: int, label: int) -> bool:
        key = state << 20 | label
        found = self._table.get(key)
        if found is None:
            if len(self._table) > 2_000_000:
                self._table.clear()
            found = self._table[key] = self._arc(state, label)
        return found

    def word(self, b: bytes) -> list[int]:
        """The ids of one pre-split word."""
        whole = self.token.get(b)
        if whole is not None:
            return [whole]
        x, table = self.arrays, self._table
        move, ends, shorter, length = x.move, x.ends, x.shorter, x.length
        state, node = [-1], 0
        for at, c in enumerate(b, 1):
            node = int(move[node, c])
            t = int(ends[node])
            while True:
                before = at - int(length[t])
                if not before:
                    break
                ok = table.get(state[before] << 20 | t)
                if ok or ok is None and self.arc(state[before], t):
                    break
                t = int(shorter[t])
            state.append(t)
        path, at = [], len(b)
        while at:
            path.append(state[at])
            at -= int(length[state[at]])
        return path[::-1]

    def split(self, text: str) -> list[str]:
        """The pre-split words of a text without added tokens."""
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return [text]
        return self._split(text)

    def _tables(self) -> SimpleNamespace:
        """The automaton as arrays, for many words at a time.

        ``move[node, byte]`` goes on to the longest end of what was read that begins a token, ``ends[node]`` is the
        longest token that ends there, ``shorter[token]`` the next shorter token that ends it.
        """
        size, most = len(self.left), 1 + sum(map(len, self.token))
        step, ends, n = np.zeros((most, 256), np.int32), np.full(most, -1, np.int32), 1
        levels: list[list[tuple[int, int, int]]] = []
        own = np.zeros(size, np.int64)
        for b, i in self.token.items():
            node = 0
            for depth, c in enumerate(b):
                then = int(step[node, c])
                if not then:
                    then, n = n, n + 1
                    step[node, c] = then
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((node, c, then))
                node = then
            ends[node], own[i] = i, node
        move, ends, fail = step[:n].copy(), ends[:n], np.zeros(n, np.int64)
        del step
        for depth, found in enumerate(levels):
            up, c, node = np.array(found).T
            if depth:
                fail[node] = move[fail[up], c]
            for lo in range(0, len(node), 4096):
                part = node[lo : lo + 4096]
                rows = move[part]
                move[part] = np.where(rows, rows, move[fail[part]])
            ends[node] = np.where(ends[node] >= 0, ends[node], ends[fail[node]])
        shorter = np.full(size, -1, np.int64)
        tokens = np.array(list(self.token.values()))
        shorter[tokens] = ends[fail[own[tokens]]]
        length = np.zeros(size, np.int64)
        length[list(self.label)] = [len(b) for b in self.label.values()]
        keys = np.fromiter(self.removed, np.int64, len(self.removed))
        order = np.argsort(keys)
        at = np.fromiter(self.removed.values(), np.int64, len(self.removed))[order]
        return SimpleNamespace(
            move=move, ends=ends, length=length, keys=keys[order], at=at, shorter=shorter,
            left=np.array(self.left, np.int64), right=np.array(self.right, np.int64), rank=np.array(self.rank, np.int64),
            # cells of the transition table that were asked for, by hash of (state, label); a later one takes the place of an earlier
            known=np.full(1 << CELLS, -1, np.int64), arc=np.zeros(1 << CELLS, bool),
        )

    def _cells(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The transition table at many pairs."""
        x, key = self.arrays, state << 20 | label
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELLS)).astype(np.int64)
        out = x.arc[slot]
        new = np.flatnonzero(x.known[slot] != key)
        if len(new):
            out[new] = self._arcs(state[new], label[new])
            x.known[slot[new]], x.arc[slot[new]] = key[new], out[new]
        return out

    def _arcs(self, state: np.ndarray, label: np.ndarray, before: int = _LATE) -> np.ndarray:
        """``_arc`` for many pairs, in the automaton of the merges whose rank is under ``before``."""
        x = self.arrays
        out, open_, before = np.ones(len(state), bool), np.arange(len(state)), np.full(len(state), before)
        while len(open_):
            key = state << 20 | label
            at = np.minimum(np.searchsorted(x.keys, key), len(x.keys) - 1)
            cut = (x.keys[at] == key) & (x.at[at] < before)
            out[open_[cut]] = False
            a, b = x.rank[state], x.rank[label]
            go = ~cut & ((a > 0) | (b > 0))
            open_, state, label, a, b = open_[go], state[go], label[go], a[go], b[go]
            before = np.where(a >= b, a, b + 1)
            state, label = np.where(a >= b, x.right[state], state), np.where(b >= a, x.left[label], label)
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """``word`` for many short words in step, each as unsigned 32-bit ids."""
        if not words:
            return []
        x, n = self.arrays, np.array([len(b) for b in words])
        order = np.argsort(-n, kind="stable")
        n = n[order]
        width = int(n[0])
        flat = np.zeros((len(words), width), np.uint8)
        flat[np.arange(width) < n[:, None]] = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        state, node = np.zeros((width + 1, len(words)), np.int64), np.zeros(len(words), np.int64)
        for at in range(1, width + 1):
            live = int(np.searchsorted(-n, -at, side="right"))
            node = x.move[node[:live], flat[:live, at - 1]]
            t = x.ends[node].astype(np.int64)
            open_ = np.arange(live)
            while True:
                before = at - x.length[t[open_]]
                open_, before = open_[before > 0], before[before > 0]
                open_ = open_[~self._cells(state[before, open_], t[open_])]
                if not len(open_):
                    break
                t[open_] = x.shorter[t[open_]]
            state[at, :live] = t
        # from the end back: the ids of a word stand at the end of its row
        path, at, open_, depth = np.zeros((len(words), width), np.uint32), n.copy(), np.arange(len(words)), 0
        count = np.zeros(len(words), np.int64)
        while len(open_):
            depth += 1
            t = state[at[open_], open_]
            path[open_, width - depth] = t
            count[open_] = depth
            at[open_] -= x.length[t]
            open_ = open_[at[open_] > 0]
        out = [b""] * len(words)
        for k, (i, c) in enumerate(zip(order.tolist(), count.tolist())):
            out[i] = path[k, width - c :].tobytes()
        return out

    def decode(self, ids: list[int]) -> bytes:
        label = self.label
        return b"".join([label[i] for i in ids])


def compiled(machine: BpeAutomaton, merges: int) -> tuple[list[int], np.ndarray]:
    """(tokens, table): the automaton of the first ``merges`` merges in full, ``table[state, label]`` by their places in ``tokens``.

    Made by the gadgets one after another, a state split and arcs moved each time; its cells grow as the square of the tokens.
    """
    made = sorted((r, w) for w, r in enumerate(machine.rank) if 0 < r <= merges)
    tokens = [i for i, b in machine.label.items() if len(b) == 1] + [w for _, w in made]
    place, n = {t: k for k, t in enumerate(tokens)}, len(tokens) - len(made)
    table = np.zeros((len(tokens), len(tokens)), bool)
    table[:n, :n] = True
    cuts = sorted((r, key >> 20, key & (1 << 20) - 1) for key, r in machine.removed.items() if r <= merges)
    new = dict(made)
    for rank, u, v in cuts:
        was = table[place[v], :n].copy()
        table[place[u], place[v]] = False
        if rank in new:
            w = place[new[rank]]
            table[w, :n] = was
            n += 1
            table[:n, w] = table[:n, place[u]]
    return tokens, table


@lru_cache(maxsize=4)
def automaton(path: str) -> BpeAutomaton:
    """One automaton a process and file."""
    return BpeAutomaton(path)


class Encoder:
    """Encodes texts chunk by chunk and remembers what ``make(ids)`` gave for a chunk.

    A chunk starts at a blank or line break between two visible characters,
    which always starts a pre-split word. ``ids`` are bytes, 32 bits an id. At
    most about ``limit`` chunks and as many words are remembered.
    """

    def __init__(self, path: str, make: Callable[[bytes], object], limit: int = 400_000):
        self.machine, self.make, self.limit = automaton(path), make, limit
        self.known: dict[str | int, object] = {}
        self.word: dict[str, bytes] = {}

    def _keys(self, text: str, slow: bool = False) -> list:
        """Chunks; one with \\0 or \\1 before it is taken as it is, others miss the blank before them; added tokens as ids."""
        m = self.machine
        if m._special is not None and (parts := m._special.split(text)) and len(parts) > 1:
            return [x for k, s in enumerate(parts) for x in ([m.special[s]] if k % 2 else self._slow(s))]
        if slow or "\0" in text or "\1" in text:
            return self._slow(text)
        return ("\0" + text).replace("\n", " \n \0").split(" ")

    def _slow(self, text: str) -> list[str]:
        return ["\1" + " " * (k > 0) + w for k, w in enumerate(_SURE_BREAK.split(text)) if w]

    def _learn(self, new: list[str]) -> None:
        m, word = self.machine, self.word
        if len(word) > self.limit:
            word.clear()
        split = [m.split(k[1:] if k[0] in "\0\1" else k if k == "\n" else " " + k) for k in new]
        fresh = {w for ws in split for w in ws if w not in word}
        raw = [(w, w.encode()) for w in fresh]
        short = [x for x in raw if len(x[1]) <= 48]
        word.update(zip((w for w, _ in short), m.words([b for _, b in short])))
        word.update((w, np.array(m.word(b), np.uint32).tobytes()) for w, b in raw if len(b) > 48)
        make = self.make
        self.known.update((k, make(b"".join([word[w] for w in ws]))) for k, ws in zip(new, split))

    def parts(self, texts: list[str | None]) -> list[list]:
        """For each text what ``make`` gave for its chunks, in order."""
        if len(self.known) > self.limit:
            self.known.clear()
        keys = [self._keys(t) if t else [] for t in texts]
        new = set().union(*keys).difference(self.known)
        odd = {k for k in new if type(k) is str and k != "\n" and (k.strip() is not k or k in ("", "\0") or k[0] == "\0" and k[1].isspace())}
        if odd:  # blanks side by side: such texts are split with care
            keys = [self._keys(t, True) if t and not odd.isdisjoint(ks) else ks for t, ks in zip(texts, keys)]
            new = set().union(*keys).difference(self.known)
        for k in [k for k in new if type(k) is int]:
            self.known[k] = self.make(np.uint32(k).tobytes())
            new.discard(k)
        if new:
            self._learn(list(new))
        known = self.known
        return [[known[k] for k in ks] for ks in keys]


def sliced(texts: list[str | None], chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about ``chars`` characters, each text whole."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t or "")
        if n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """A row per document: number of ids, digest of the ids and of the text decoded from them.

    ``docs`` needs doc_id and text; other columns are ignored. One pass, no
    shuffle: each worker compiles the automaton once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        names, label = [str(i) for i in range(1 << 17)], machine.label

        def make(raw: bytes) -> tuple[str, bytes, int]:
            ids = np.frombuffer(raw, np.uint32).tolist()
            return ",".join([names[i] for i in ids]), b"".join([label[i] for i in ids]), len(ids)

        enc = Encoder(path, make)
        for batch in batches:
            rows = []
            for texts in sliced(batch.column(1).to_pylist()):
                for parts in enc.parts(texts):
                    ids, labels, counts = zip(*parts) if parts else ((), (), ())
                    rows.append((sum(counts), sha256(",".join(ids).encode()).hexdigest(), sha256(b"".join(labels)).hexdigest()))
            cols = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string())))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def bpe_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the encoding itself, and the text decoded from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        enc = Encoder(path, bytes)
        for batch in batches:
            ids = [np.frombuffer(b"".join(p), np.uint32).tolist() for texts in sliced(batch.column(1).to_pylist()) for p in enc.parts(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([machine.decode(x).decode("utf-8", "replace") for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
