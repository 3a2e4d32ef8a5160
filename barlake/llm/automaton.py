"""A byte-level BPE vocabulary as a deterministic automaton over tokens.

States are "the last token read" (and a start state); an arc carries one token
and leads to that token's state. At first every byte may follow every byte. The
merges are then applied in order, each as a gadget on the automaton so far: for
``u v -> w`` a state for ``w`` is added that keeps the arcs leaving ``v``'s state,
every state that has an arc ``u`` gets an arc ``w``, and the arc ``v`` is taken from
``u``'s state. What remains accepts exactly the token sequences that merging in
order produces, so a word has one accepted reading.

Written out, the arcs of a 50k vocabulary would be billions. They are kept by
the gadget that removes them instead: an arc ``b`` is missing in ``a``'s state if and
only if some gadget (u, v) removed it from a state whose arcs ``a`` inherited (``u``
ends ``a`` and was not yet merged away inside it) for an arc from which ``b`` stems
(``v`` begins ``b``, likewise). ``Tables`` holds those inherited chains with the rank
at which each ended; asked arcs are kept, so the hot part of the automaton is a
table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np

NEVER = 1 << 60
#: Words of more bytes are read one by one.
LONG = 48
#: Places of the kept part of the transition table, as a power of two.
KEPT_BITS = 21


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tables:
    """What the gadgets leave: ids of byte strings, a trie over them, and per token the chains at both edges.

    ``edges``: node, byte, node (0 is the root); ``node_token``: the token that ends at
    a node, or -1. What is derived is made once in each process and not shipped.
    """

    ids: dict[bytes, int]
    labels: list[bytes]
    edges: np.ndarray
    node_token: np.ndarray
    removed: dict[int, int]
    heads: list[tuple[tuple[int, int], ...]]
    tails: list[tuple[tuple[int, int], ...]]

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each node and the table row x byte -> node (0: none); nodes without steps share the empty row 0."""
        inner = np.unique(self.edges[:, 0])
        row = np.zeros(len(self.node_token), dtype=np.int32)
        row[inner] = np.arange(1, len(inner) + 1)
        to = np.zeros((len(inner) + 1, 256), dtype=np.int32)
        to[row[self.edges[:, 0]], self.edges[:, 1]] = self.edges[:, 2]
        return row, to

    @cached_property
    def chains(self) -> tuple[np.ndarray, ...]:
        """Removed pairs in order with their ranks, and the chains at the ends and heads of tokens, one after the other."""
        keys = np.array(sorted(self.removed), dtype=np.int64)
        out = [keys, np.array([self.removed[k] for k in keys.tolist()], dtype=np.int64)]
        for chains in (self.tails, self.heads):
            size = np.array([len(c) for c in chains])
            flat = np.fromiter((v for c in chains for x in c for v in x), dtype=np.int64, count=2 * int(size.sum())).reshape(-1, 2)
            out += [np.concatenate([[0], np.cumsum(size)]), flat[:, 0].copy(), flat[:, 1].copy()]
        return tuple(out)

    @cached_property
    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """The part of the transition table asked for so far: the pair held at each place, and whether its arc is open."""
        return np.full(1 << KEPT_BITS, -1, dtype=np.int64), np.zeros(1 << KEPT_BITS, dtype=bool)


def compile_merges(vocabulary_path: str) -> Tables:
    """Apply every merge's gadget in order."""
    with open(vocabulary_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = byte_alphabet()
    raw = lambda token: bytes(alphabet[c] for c in token)
    vocab = model["vocab"]
    ids = {raw(t): i for t, i in vocab.items() if all(c in alphabet for c in t)}
    size = max(ids.values()) + 1
    labels = [b""] * size
    for t, i in ids.items():
        labels[i] = t
    heads: list[tuple[tuple[int, int], ...]] = [()] * size
    tails: list[tuple[tuple[int, int], ...]] = [()] * size
    for b in range(256):
        i = ids[bytes([b])]
        heads[i] = tails[i] = ((i, NEVER),)
    removed: dict[int, int] = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        u, v, w = vocab[left], vocab[right], vocab[left + right]
        removed.setdefault((u << 20) | v, rank)
        if heads[w]:
            continue
        # w's state inherits what leaves v's state, and w's arc what leads along u's: until this rank, from then on as w.
        heads[w] = tuple((x, min(end, rank)) for x, end in heads[u]) + ((w, NEVER),)
        tails[w] = tuple((x, min(end, rank)) for x, end in tails[v]) + ((w, NEVER),)
    trie: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for t, i in ids.items():
        node = 0
        for b in t:
            nxt = trie[node].setdefault(b, len(trie))
            if nxt == len(trie):
                trie.append({})
                ends.append(-1)
            node = nxt
        ends[node] = i
    edges = np.array([(node, b, nxt) for node, steps in enumerate(trie) for b, nxt in steps.items()], dtype=np.int32)
    return Tables(ids, labels, edges, np.array(ends, dtype=np.int32), removed, heads, tails)


class Automaton:
    """Reads words along the arcs; ``arcs`` is the part of the transition table asked for so far, decided once and then looked up.

    ``encode_many`` reads many words at a time over the same tables held as arrays.
    """

    ARCS = 2_000_000

    def __init__(self, tables: Tables):
        self.t = tables
        self.arcs: dict[int, bool] = {}

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``has_arc`` of pairs."""
        keys, ranks, tail_at, tail, tail_end, head_at, head, head_end = self.t.chains
        tails, heads = tail_at[a + 1] - tail_at[a], head_at[b + 1] - head_at[b]
        n = tails * heads
        of = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        u, v = tail_at[a][of] + k // heads[of], head_at[b][of] + k % heads[of]
        key = (tail[u] << 20) | head[v]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        cut = (keys[at] == key) & (ranks[at] < tail_end[u]) & (ranks[at] <= head_end[v])
        found = np.ones(len(a), dtype=bool)
        found[of[cut]] = False
        return found

    def _arcs_open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The transition table at pairs; what it does not hold is decided and takes its place."""
        key = (a.astype(np.int64) << 20) | b
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEPT_BITS)).astype(np.int64)
        kept, open_ = self.t.kept
        miss = np.flatnonzero(kept[at] != key)
        found = open_[at]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            decided = self._decide(new >> 20, new & 0xFFFFF)
            found[miss] = decided[back]
            kept[at[miss]], open_[at[miss]] = key[miss], decided[back]
        return found

    def encode_many(self, words: Iterable[bytes]) -> list[bytes]:
        """The readings of pre-split words, each as 32-bit integers in bytes, by the same pass from left to right over all of them."""
        words = list(words)
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            whole = self.t.ids.get(w)
            if whole is not None:
                out[i] = np.int32(whole).tobytes()
            elif len(w) > LONG:
                out[i] = np.array(self.encode(w), dtype=np.int32).tobytes()
            elif w:
                short.append(i)
        if not short:
            return out
        (row_of, to), token_at = self.t.steps, self.t.node_token
        size = np.array([len(words[i]) for i in short])
        order = np.argsort(-size, kind="stable")
        size, short = size[order], [short[i] for i in order]
        n, longest = len(short), int(size[0])
        text = np.frombuffer(b"".join([words[i].ljust(longest, b"\0") for i in short]), dtype=np.uint8).reshape(n, longest).T.copy()
        last, begin = np.full((longest + 1, n), -1, dtype=np.int32), np.zeros((longest + 1, n), dtype=np.int16)
        reach = np.searchsorted(-size, -np.arange(longest + 1), side="left")  # words longer than k come first
        for at in range(longest):
            rows = np.arange(reach[at]) if not at else np.flatnonzero(last[at, : reach[at]] >= 0)
            node = np.zeros(len(rows), dtype=np.int32)
            state = last[at, rows]
            for i in range(at, longest):
                if i > at:
                    within = rows < reach[i]
                    rows, node, state = rows[within], node[within], state[within]
                node = to[row_of[node], text[i, rows]]
                live = node > 0
                if not live.all():
                    rows, node, state = rows[live], node[live], state[live]
                if not len(rows):
                    break
                token = token_at[node]
                ask = np.flatnonzero((token >= 0) & (last[i + 1, rows] < 0))
                if at and len(ask):
                    ask = ask[self._arcs_open(state[ask], token[ask])]
                last[i + 1, rows[ask]], begin[i + 1, rows[ask]] = token[ask], at
        # Followed back from the end, all words at once.
        here, rows, found = size.copy(), np.arange(n), []
        while len(rows):
            token = last[here[rows], rows]
            if (token < 0).any():
                raise ValueError("the vocabulary misses a byte")
            found.append((rows, token))
            here[rows] = begin[here[rows], rows]
            rows = rows[here[rows] > 0]
        many = np.zeros(n, dtype=np.int64)
        for rows, _ in found:
            many[rows] += 1
        ends = np.cumsum(many)
        flat = np.zeros(int(ends[-1]), dtype=np.int32)
        for k, (rows, token) in enumerate(found):
            flat[ends[rows] - 1 - k] = token
        data, ends = flat.tobytes(), (4 * ends).tolist()
        start = 0
        for i, end in zip(short, ends):
            out[i] = data[start:end]
            start = end
        return out

    def has_arc(self, a: int, b: int) -> bool:
        key = (a << 20) | b
        known = self.arcs.get(key)
        if known is None:
            known = True
            removed = self.t.removed
            for u, u_end in self.t.tails[a]:
                for v, v_end in self.t.heads[b]:
                    rank = removed.get((u << 20) | v)
                    # Leftmost first: at equal rank the pair inside ``a`` is merged before this one, the pair inside ``b`` after it.
                    if rank is not None and rank < u_end and rank <= v_end:
                        known = False
                        break
                if not known:
                    break
            if len(self.arcs) > self.ARCS:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The accepted reading of one pre-split word.

        Every prefix of a word has one accepted reading, so the state reached at
        each place, its last token, is settled once and for all when the places
        before it are: one pass from left to right along the arcs, and the reading is
        followed back from the end.
        """
        whole = self.t.ids.get(word)
        if whole is not None:
            return (whole,)
        (row_of, to), token_at = self.t.steps, self.t.node_token
        arcs, has_arc = self.arcs, self.has_arc
        n = len(word)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        for at in range(n):
            state = last[at]
            if at and state < 0:
                continue
            node = 0
            for i in range(at, n):
                node = int(to[row_of[node], word[i]])
                if not node:
                    break
                token = int(token_at[node])
                if token >= 0 and last[i + 1] < 0:
                    if at:
                        open_ = arcs.get((state << 20) | token)
                        if not (has_arc(state, token) if open_ is None else open_):
                            continue
                    last[i + 1], begin[i + 1] = token, at
        path, i = [], n
        while i:
            if last[i] < 0:
                raise ValueError("the vocabulary misses a byte")
            path.append(last[i])
            i = begin[i]
        return tuple(path[::-1])

    def decode(self, ids: list[int]) -> bytes:
        """The labels along the arcs."""
        return b"".join([self.t.labels[i] for i in ids])
