"""Byte-level BPE by a lazily determinised finite-state transducer.

A text is cut into pre-tokens by a pattern; each is read byte by byte. Let
last(k) be the last token of the encoding of a pre-token's first k bytes. It is
the one token t that ends at k, encodes to itself, and fits after last(k - |t|):
two tokens fit when the merges leave their joined bytes as those two. An automaton
gives the tokens that end at k, whatever came before. So the
encodings of all prefixes form a tree, and a later token can only start where
some longer token may still begin. Tokens on the way from the root to the
deepest node that all those places have in common are certain and are emitted.
What remains - the token emitted last and the bytes since - is the state; states
and transitions are made when first met and kept (Berglund and van der Merwe show
that the lookahead is bounded). Beyond a bound of states further transitions are
taken without being kept; when many have been, all kept ones go, so that those
that are kept follow the data.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sluice.llm import kept

#: Bounds of what a worker keeps; they change no result. The transducer starts anew
#: after RENEW transitions for each of MAX_STATES that were not kept; of pre-tokens the
#: last two lots of MAX_WORDS are kept. SOON: bytes after which a walk without states
#: looks which tokens are certain.
RENEW, SOON = 50, 64
MAX_STATES, MAX_FITS, MAX_STEPS, MAX_WORDS, MAX_WORD_CHARS = 30_000, 300_000, 150_000, 200_000, 48
#: Stands for the token before the first.
FIRST = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """What the transducer is compiled from: ranks, and which tokens fit together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._edges: dict[tuple[bytes, bool], list[tuple[int, bytes]]] = {}
        #: For each token that was asked for: whether it can stand after the tokens met so far.
        self.fits: dict[int, dict[int, bool]] = {}
        self.held = 0

    def merge(self, data: bytes, upto: int = 1) -> list[bytes]:
        """The encoding by its definition: the pair of lowest rank merges first.

        upto: stop when so many parts are left.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > upto:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None where its bytes never become it."""
        if token not in self._halves:
            parts = self.merge(token, 2)
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def whole(self, token: bytes) -> bool:
        """Whether the token's bytes encode to the token."""
        return len(token) == 1 or self.halves(token) is not None

    def edge(self, token: bytes, right: bool) -> list[tuple[int, bytes]]:
        """The parts that stand at one end of a token while it is merged, in order, with their ranks."""
        if (found := self._edges.get((token, right))) is None:
            part, found = token, []
            while len(part) > 1:
                found.append((self.ranks[part], part))
                part = self.halves(part)[right]
            found.append((-1, part))
            found.reverse()
            self._edges[token, right] = found
        return found

    def fit(self, a: int, b: int) -> bool:
        """Whether token b, which is whole, can stand after token a (or first, where a is FIRST).

        When MAX_FITS answers are held all go, so that those held follow the data.
        """
        found = a == FIRST or self._fit(self.tokens[a], self.tokens[b])
        if self.held >= MAX_FITS:
            for answers in self.fits.values():
                answers.clear()
            self.held = 0
        self.fits[b][a] = found
        self.held += 1
        return found

    def _fit(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave the bytes of a and b as just these two tokens.

        They do unless, at some time, the parts on both sides of the border make a
        token that merges before either of them grows.
        """
        left, right, ranks = self.edge(a, True), self.edge(b, False), self.ranks
        i, j, never = 0, 0, 1 << 60
        while True:
            rank = ranks.get(left[i][1] + right[j][1], never)
            grow_left = left[i + 1][0] if i + 1 < len(left) else never
            grow_right = right[j + 1][0] if j + 1 < len(right) else never
            if rank < grow_left and rank <= grow_right and rank < never:
                return False
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1


class Ends:
    """The beginnings of tokens with which the bytes read so far end (Aho and Corasick).

    A node is the longest of them, those shorter are on its way back by `back`; node
    0 is the empty one. From a node that is `open` a longer token may still come.
    """

    def __init__(self, merges: Merges):
        self.merges, self.edges, at = merges, {}, {}
        self.depth, self.back, self.open = array("i", [0]), array("i", [0]), bytearray(1)
        for token, rank in merges.ranks.items():
            node = 0
            for byte in token:
                if (after := self.edges.get(node << 8 | byte)) is None:
                    after = self.edges[node << 8 | byte] = len(self.depth)
                    self.open[node] = 1
                    self.depth.append(self.depth[node] + 1)
                    self.open.append(0)
                node = after
            at[node] = rank
        self.back.extend([0] * (len(self.depth) - 1))
        for key in sorted(self.edges, key=lambda key: self.depth[key >> 8]):
            if node := key >> 8:
                self.back[self.edges[key]] = self._after(self.back[node], key & 255)
        self._at = at
        #: For each node that was met the whole tokens that end there, the longest first:
        #: length, token, which tokens it fits after.
        self.tokens: list[tuple[tuple[int, int, dict[int, bool]], ...] | None] = [None] * len(self.depth)
        self.step: dict[int, int] = {}

    def _after(self, node: int, byte: int) -> int:
        while (found := self.edges.get(node << 8 | byte)) is None:
            if not node:
                return 0
            node = self.back[node]
        return found

    def _tokens(self, node: int) -> tuple[tuple[int, int, dict[int, bool]], ...]:
        if (found := self.tokens[node]) is None:
            found = self._tokens(self.back[node]) if node else ()
            token = self._at.get(node)
            if token is not None and self.merges.whole(self.merges.tokens[token]):
                found = ((self.depth[node], token, self.merges.fits.setdefault(token, {})), *found)
            self.tokens[node] = found
        return found

    def after(self, key: int) -> int:
        """The node after a node and a byte (node << 8 | byte), which step then holds."""
        found = self._after(key >> 8, key & 255)
        self._tokens(found)
        if len(self.step) >= MAX_STEPS:
            self.step.clear()
        self.step[key] = found
        return found


class State:
    """The bytes since the token emitted last; that token and, for each of their
    prefixes, the last token; the beginnings of longer tokens with which they end."""

    __slots__ = ("pending", "last", "node", "step", "rest")

    def __init__(self, pending: bytes, last: tuple[int, ...], node: int):
        self.pending, self.last, self.node = pending, last, node
        self.step: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.rest: list[int] | None = None


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.ends = Ends(self.merges)
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.states: dict[tuple[int, bytes], State] = {}
        self.clear()

    def clear(self) -> None:
        """Lets all states go."""
        for state in self.states.values():
            state.step = {}
        self.start = State(b"", (FIRST,), 0)
        self.states = {(FIRST, b""): self.start}
        self.walked = 0

    def _tokens(self, last: Sequence[int], k: int) -> list[int]:
        """The tokens of the first k bytes."""
        sizes, found = self.sizes, []
        while k:
            found.append(last[k])
            k -= sizes[last[k]]
        found.reverse()
        return found

    def _read(self, last: list[int], node: int, data: bytes) -> int:
        """Adds to last the last token after each byte of data; the node at its end."""
        step, tokens, fit = self.ends.step, self.ends.tokens, self.merges.fit
        for byte in data:
            key = node << 8 | byte
            if (node := step.get(key)) is None:
                node = self.ends.after(key)
            for size, token, fits in tokens[node]:
                left = last[-size]
                if (fitting := fits.get(left)) is None:
                    fitting = fit(left, token)
                if fitting:
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {byte}")
        return node

    def _certain(self, last: Sequence[int], node: int) -> tuple[int, int]:
        """The deepest place that the ways back from all places share from which a longer
        token may still come, and the node that stands for these."""
        depth, back, is_open, sizes = self.ends.depth, self.ends.back, self.ends.open, self.sizes
        while not is_open[node]:
            node = back[node]
        n = k = cut = len(last) - 1
        on = {0}
        while k:
            on.add(k)
            k -= sizes[last[k]]
        at = node
        while at:
            if is_open[at]:
                k = n - depth[at]
                while k not in on:
                    k -= sizes[last[k]]
                cut = min(cut, k)
            at = back[at]
        return cut, node

    def _advance(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        last = list(state.last)
        node = self._read(last, state.node, bytes((byte,)))
        cut, node = self._certain(last, node)
        at = last[cut], (state.pending + bytes((byte,)))[cut:]
        if (after := self.states.get(at)) is None:
            after = self.states[at] = State(at[1], tuple(last[cut:]), node)
        state.step[byte] = found = after, tuple(self._tokens(last, cut))
        return found

    def encode(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if self.walked > RENEW * MAX_STATES:
            self.clear()
        state, ids = self.start, []
        for i, byte in enumerate(data):
            if (known := state.step.get(byte)) is None:
                if len(self.states) >= MAX_STATES:
                    return ids + self._walk(state, data[i:])
                known = self._advance(state, byte)
            state, sent = known
            if sent:
                ids += sent
        if state.rest is None:
            state.rest = self._tokens(state.last, len(state.pending))
        ids += state.rest
        return ids

    def _walk(self, state: State, rest: bytes) -> list[int]:
        """The ids of what is pending and of the rest, by transitions that are not kept.

        Every SOON bytes the certain tokens are emitted and only what is pending stays.
        """
        last, node, ids = list(state.last), state.node, []
        self.walked += len(rest)
        for first in range(0, len(rest), SOON):
            if first:
                cut, node = self._certain(last, node)
                ids += self._tokens(last, cut)
                del last[:cut]
            node = self._read(last, node, rest[first : first + SOON])
        return ids + self._tokens(last, len(last) - 1)


class Utf8Stream:
    """Incremental UTF-8: feed() returns the text completed so far; a state of at
    most three bytes waits for the rest of its character."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data)
        for back in range(1, min(4, cut + 1)):
            byte = data[cut - back]
            if byte < 0x80:
                break
            if byte >= 0xC0:  # a first byte: are all its followers there?
                if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4):
                    cut -= back
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Words(dict):
    """Pre-token to its ids and their decimals joined by commas; those not held are
    encoded by the transducer."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.encode, self.older = transducer.encode, {}

    def __missing__(self, word: str) -> tuple[list[int], str]:
        found = self.older.get(word)
        if found is None:
            ids = self.encode(word.encode())
            found = ids, ",".join(map(str, ids))
        if len(word) <= MAX_WORD_CHARS:
            if len(self) >= MAX_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


_WIDE = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r" \t\n\r\x0b\x0c"}


def ascii_pattern(pattern: str) -> str | None:
    """A pattern for the quicker re module that cuts ASCII texts as pattern does.

    None where pattern has an escape that this does not know.
    """
    out, inside, at = "", False, 0
    while at < len(pattern):
        known = next((w for w in _WIDE if pattern.startswith(w, at)), None)
        if known:
            out += _WIDE[known] if inside else f"[{_WIDE[known]}]"
            at += len(known)
            continue
        c = pattern[at]
        if pattern.startswith(r"\S", at) and not inside:
            out += "[^" + _WIDE[r"\s"] + "]"
            at += 2
            continue
        if c == "\\":
            return None
        inside = c == "[" or inside and c != "]"
        out += c
        at += 1
    return out


class Codec:
    """Encodes and decodes texts; keeps the ids of frequent pre-tokens."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.split_ascii = re.compile(plain).findall if plain else self.split
        self.transducer = Transducer(ranks)
        self.bytes = {i: t for t, i in ranks.items()}
        self.words = Words(self.transducer)

    def encoded(self, text: str) -> tuple[list[int], str]:
        """The ids of a text, and their decimals joined by commas."""
        words = self.split_ascii(text) if text.isascii() else self.split(text)
        found = list(map(self.words.__getitem__, words))
        return list(chain.from_iterable(map(itemgetter(0), found))), ",".join(map(itemgetter(1), found))

    def encode(self, text: str) -> list[int]:
        return self.encoded(text)[0]

    def decode_stream(self, ids: Iterable[int], chunk: int = 8192) -> Iterator[str]:
        """The text of ids, piece by piece."""
        ids, stream = list(ids), Utf8Stream()
        for i in range(0, len(ids), chunk):
            yield stream.feed(b"".join(map(self.bytes.__getitem__, ids[i : i + chunk])))
        yield stream.close()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, until another operator's tasks come. What it
    keeps lives as long, so looking for garbage among it often would be wasted."""

    def make() -> Codec:
        gc.set_threshold(1_000_000, 50, 100)
        return Codec(path, pattern)

    return kept.keep(("bpe", path, pattern), make)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True, verify: bool = True) -> DataFrame:
    """key, n_tokens, ids (if with_ids), ids_sha256, decoded_sha256 for every row of docs.

    path is a .tiktoken file that every machine has; pattern cuts the pre-tokens.
    Special tokens are ordinary text. A null or empty text has no tokens. The
    hashes are lowercase hex: of the decimal ids joined by commas, and of the
    UTF-8 bytes of the text decoded from the ids (null where verify is off).
    Rows stay in their partitions; other columns are not read. Which characters
    are letters or digits is the regex module's Unicode version's to say; newly
    assigned ones can be cut differently by a library of another version.
    """
    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, n_tokens bigint" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for some in range(0, batch.num_rows, 512):  # bounds the ids held at once
                part = batch.slice(some, 512)
                n, lists, hashes, decoded = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids, decimals = c.encoded(text or "")
                    n.append(len(ids))
                    if with_ids:
                        lists.append(ids)
                    hashes.append(sha(decimals.encode()))
                    if verify:
                        decoded.append(digest(c.decode_stream(ids)))
                    else:
                        decoded.append(None)
                columns = [part.column(0), pa.array(n, pa.int64())]
                columns += [pa.array(lists, pa.list_(pa.int32()))] if with_ids else []
                columns += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = [key, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key, docs[text].cast("string")).mapInArrow(run, schema)


def digest(pieces: Iterable[str]) -> str:
    """SHA-256 of the UTF-8 bytes of a text that comes in pieces."""
    h = hashlib.sha256()
    for piece in pieces:
        h.update(piece.encode())
    return h.hexdigest()
