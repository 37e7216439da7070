"""Operator 5: byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Encoding. Every text is read character by character, in chunks, by a deterministic transducer. Its state is the text read
whose tokens are not stable yet: the open piece (merges never cross the splitter's pieces), and what may have begun a
special token. A transition emits the ids that it makes stable (of a whole piece those that the library's model
gives for it). Transitions are determinised on first use and remembered up to a bound; each pass through unknown ground adds one state. Inside a long piece tokens are emitted once
stable too: as soon as as many bytes follow them as the merge list's sufficient lookahead. So memory does not grow with
the text.

Sufficient lookahead. Let the piece be known up to q and let more bytes follow. A merge (u, v) split at p can only turn
out otherwise if, before its rank comes, something crosses the end of v; the first merge to cross there is (u', v'),
where u' is v or a right-hand part of v in its own derivation, and has a lower rank. So disturbances run leftwards along
chains of falling rank, (u, v) <- (u', v') <- ..., and reach no farther than the longest sum of |v| along such a chain.
`lookahead` computes that sum over the merge list. Merges of one rank go from left to right and so never run back.

Decoding. A state machine takes ids and gives text as soon as its bytes form whole characters; it holds three bytes at most.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from meshqa.llm.common import table, tokenizer_path

#: The splitter's pattern, a fixed value of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that a text is read in at a time; any number gives the same ids.
CHUNK = 1 << 16
#: States and transitions that are remembered, and pieces with their ids; then they are found anew.
REMEMBERED, PIECES = 800_000, 400_000
#: Characters of an open piece that are gathered before they go to its stream.
GATHERED = 1024


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Merges:
    """The vocabulary and ordered merges of a byte-level BPE file, and their sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if bad := [s for s in self.special for t in self.special if s != t and s in t]:
            raise ValueError(f"special tokens inside others: {bad[:3]}")
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        #: pair of ids -> rank; rank -> id of the whole
        self.rank: dict[tuple[int, int], int] = {}
        self.whole: list[int] = []
        self.parts: dict[int, tuple[int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            u, v = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.ids[u + v]
            self.rank[self.ids[u], self.ids[v]] = n
            self.whole.append(whole)
            self.parts.setdefault(whole, (self.ids[u], self.ids[v]))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.lookahead = self._lookahead()
        self.letter = {b: c for c, b in letters.items()}
        self.model = Tokenizer.from_file(path).model.tokenize

    def of_piece(self, piece: str) -> list[int]:
        """The ids of one whole piece, by the library's model; merge gives the same."""
        return [t.id for t in self.model(piece.encode().decode("latin-1").translate(self.letter))]

    def _lookahead(self) -> int:
        best: dict[int, int] = {}
        most = 0
        for u, v in self.rank:  # in order of rank
            reach, part = 0, v
            while True:
                reach = max(reach, best.get(part, 0))
                if part not in self.parts:
                    break
                part = self.parts[part][1]
            reach += len(self.bytes_of[v])
            best[u] = max(best.get(u, 0), reach)
            most = max(most, reach)
        return most

    def merge(self, data: bytes) -> list[int]:
        """The ids of one whole piece: the lowest rank first, from left to right."""
        ids = [self.single[b] for b in data]
        return self._merge_few(ids) if len(ids) <= 32 else self._merge_many(ids)

    def _merge_few(self, ids: list[int]) -> list[int]:
        none, rank = len(self.whole), self.rank.get
        found = list(map(rank, zip(ids, ids[1:]), repeat(none)))
        while found and (best := min(found)) != none:
            at = found.index(best)
            ids[at : at + 2] = [self.whole[best]]
            del found[at]
            if at:
                found[at - 1] = rank((ids[at - 1], ids[at]), none)
            if at < len(found):
                found[at] = rank((ids[at], ids[at + 1]), none)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, u, v = heapq.heappop(heap)
            j = after[i] if ids[i] == u else n
            if j >= n or ids[j] != v:
                continue
            ids[i], ids[j] = self.whole[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceStream:
    """Merges inside one piece whose end is not known yet. Holds at most `window` bytes besides what it is fed."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""
        self.window = 4 * merges.lookahead + 1024

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.window):
            self.held += data[i : i + self.window]
            if len(self.held) < self.window:
                break
            stable = len(self.held) - self.merges.lookahead
            at = 0
            for t in self.merges.merge(self.held):
                if at + (n := len(self.merges.bytes_of[t])) > stable:
                    break
                out.append(t)
                at += n
            self.held = self.held[at:]
        return out

    def close(self) -> list[int]:
        ids, self.held = self.merges.merge(self.held), b""
        return ids


#: A state is a dict: character -> (next state, ids emitted); None -> the same for the end of the text; PENDING -> the text
#: whose ids are not emitted yet; KIND -> the class of its last character if it is one piece that more of them lengthen
#: and any other character but white space's closes.
#: Both are strings, longer than a character: a dict whose keys are all strings is smaller and looked up faster.
PENDING, KIND = "pending", "kind"
State = dict
NOTHING = b""
LETTER, NUMBER, OTHER, SPACE = range(4)


class Kinds(dict):
    """The class of a character in the splitter's pattern; characters that begin special tokens and the end (None) have
    one of their own."""

    _of = regex.compile(r"(\p{L})|(\p{N})|([^\s\p{L}\p{N}])|(\s)")

    def __missing__(self, c: str) -> int:
        kind = self[c] = self._of.match(c).lastindex - 1
        return kind


class OpenPiece:
    """The state inside a piece that is new: it gathers characters of one kind until another comes. When the same piece
    comes again, the states on the way to it are remembered."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.merges, self.kinds = encoder, encoder.merges, encoder.kinds
        self.stay = self, NOTHING

    def begin(self, state: State, c: str, kind: int) -> OpenPiece:
        """Enter it from a state that has no transition for c yet."""
        self.came, self.text, self.kind, self.tail, self.stream = state, [state[PENDING], c], kind, "", None
        return self

    def __getitem__(self, c: str | None) -> tuple:
        if self.kinds[c] == self.kind and not self.tail:
            self.text.append(c)
            return self.stay if len(self.text) < GATHERED else self._pass_on()
        if c is None:
            # what might have begun a special token has not
            return self._released(self.tail, "", None) if self.tail else (self.encoder.start, self._closed(self.text))
        if self.tail or c in self.encoder.begins:
            t = self.tail + c
            if t in self.merges.special:
                return self.encoder.start, self._closed(self.text) + packed([self.merges.special[t]])
            hold = self.encoder.begun(t)
            if hold == len(t):
                self.tail = t
                return self.stay
            return self._released(t[: len(t) - hold], t[len(t) - hold :], c)
        return self._take(c)

    def _pass_on(self) -> tuple:
        self.stream = self.stream or PieceStream(self.merges)
        ids = self.stream.feed("".join(self.text[:-1]).encode())
        self.text = self.text[-1:]
        return self, packed(ids) if ids else NOTHING

    def _released(self, text: str, hold: str, c: str | None) -> tuple:
        """Go on with text that is no special token, holding back what may begin another."""
        self.tail, state, out = "", self, NOTHING
        for x in text:
            state, ids = self._take(x) if state is self else self.encoder.step(state, x)
            out += ids
        if state is self:
            self.tail = hold
        else:
            for x in hold:
                state, ids = self.encoder.step(state, x)
                out += ids
        if c is None:
            state, ids = state[None] if state is self else self.encoder.step(state, None)
            out += ids
        return state, out

    def _take(self, c: str) -> tuple:
        if self.encoder.class_of(c) == self.kind:
            self.text.append(c)
            return self.stay if len(self.text) < GATHERED else self._pass_on()
        if self.kind != SPACE:
            ids = self._closed(self.text)
            state, more = self.encoder.step(self.encoder.start, c)
            return state, ids + more
        # the last white space of a run stands apart: a blank joins what follows
        run, last = "".join(self.text)[:-1], self.text[-1][-1]
        ids = self._closed([run])
        if last != " ":
            ids += self.encoder.ids_of(last)
        state, more = self.encoder.step(self.encoder.state_of(" " if last == " " else ""), c)
        return state, ids + more

    def _closed(self, text: list[str]) -> bytes:
        piece, encoder = "".join(text), self.encoder
        if self.stream is None:
            if piece in encoder.known:
                encoder.lay(self.came, piece, self.kind)
            return encoder.ids_of(piece)
        ids = self.stream.feed(piece.encode()) + self.stream.close()
        self.stream = None
        return packed(ids)


class Encoder:
    """A streaming encoder: feed(chunk), ..., close() give ids as little-endian unsigned 32-bit integers. encode(text) is
    the same over one text, as a list."""

    def __init__(self, merges: Merges):
        self.merges, self.pieces = merges, regex.compile(PATTERN)
        self.prefixes = {s[:k] for s in merges.special for k in range(1, len(s))}
        self.begins = {s[0] for s in merges.special}
        self.longest = max(map(len, self.prefixes), default=0)
        self.kinds = Kinds({c: -1 for c in (None, *self.begins)})
        self.open = OpenPiece(self)
        self.states: dict[str, State] = {}
        self._forget()
        self.state = self.start

    def _forget(self) -> None:
        # every cycle of states goes through one of these: without their transitions all are freed, with no collection
        for state in self.states.values():
            pending, kind = state[PENDING], state[KIND]
            state.clear()
            state[PENDING], state[KIND] = pending, kind
        self.states, self.size, self.known = {}, 0, {}
        self.start = self.state_of("")

    def class_of(self, c: str) -> int:
        return self.kinds[c] if self.kinds[c] >= 0 else Kinds()[c]

    def state_of(self, pending: str) -> State:
        """The state after what was cut off, of a character or less, or an apostrophe and one more."""
        state = self.states.get(pending)
        if state is None:
            kind = self.class_of(pending) if len(pending) == 1 and pending != "'" else None
            state = self.states[pending] = self.new_state(pending, kind)
        return state

    def new_state(self, pending: str, kind: int | None) -> State:
        self.size += 1
        return {PENDING: pending, KIND: kind if kind != SPACE else None}

    def lay(self, state: State, piece: str, kind: int) -> None:
        """Remember the path from a state, inside a piece, to its end."""
        for c in piece[len(state[PENDING]) :]:
            if c not in state:
                state[c] = self.new_state(state[PENDING] + c, kind), NOTHING
            state = state[c][0]

    def begun(self, text: str) -> int:
        """The length of the longest end of a text with which a special token may begin, less than whole."""
        if self.begins.isdisjoint(text[-self.longest :]):
            return 0
        return next((k for k in range(min(len(text), self.longest), 0, -1) if text[-k:] in self.prefixes), 0)

    def ids_of(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = packed(self.merges.of_piece(piece))
            if len(piece) <= 32:
                if len(self.known) >= PIECES:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def step(self, state: State, c: str | None) -> tuple:
        try:
            return state[c]
        except KeyError:
            return self._learn(state, c)

    def _learn(self, state: State, c: str | None) -> tuple:
        """Determinise a transition: what it emits, and the state that it leads to."""
        if self.size >= REMEMBERED:
            self._forget()
        self.size += 1
        pending, kind = state[PENDING], state[KIND]
        if c is None:
            state[None] = found = (self.start, b"".join(map(self.ids_of, self.pieces.findall(pending))))
            return found
        if kind is not None and c not in self.begins:
            if self.kinds[c] == kind:
                return self.open.begin(state, c, kind), NOTHING
            state[c] = found = (self.state_of(c), self.ids_of(pending))
            return found
        text = pending + c
        for s, n in self.merges.special.items():
            if text.endswith(s):
                state[c] = found = (self.start, b"".join(map(self.ids_of, self.pieces.findall(text[: -len(s)]))) + packed([n]))
                return found
        if self.begun(text):
            state[c] = found = (self.new_state(text, None), NOTHING)
            return found
        cut = self.pieces.findall(text)
        # an apostrophe and r, v or l may still become a contraction
        still = 2 if cut[-1] in ("r", "v", "l") and len(cut) > 1 and cut[-2] == "'" else 1
        rest = "".join(cut[-still:])
        if len(cut) == still:
            if len(text) > 2 and text[0] != "'":
                return self.open.begin(state, c, self.class_of(c)), NOTHING
            state[c] = found = (self.new_state(text, self.class_of(c) if text[0] != "'" else None), NOTHING)
            return found
        # what is cut off may have waited for a special token: then the rest is longer, and seldom worth remembering
        short = len(rest) == 1
        found = (self.state_of(rest) if short else self.new_state(rest, self.class_of(c) if still == 1 and rest[0] != "'" else None), b"".join(map(self.ids_of, cut[:-still])))
        if short:
            state[c] = found
        return found

    def feed(self, chunk: str) -> bytes:
        state, out = self.state, []
        for c in chunk:
            try:
                state, ids = state[c]
            except KeyError:
                state, ids = self._learn(state, c)
            if ids:
                out.append(ids)
        self.state = state
        return b"".join(out)

    def close(self) -> bytes:
        _, ids = self.step(self.state, None)
        self.state = self.start
        return ids

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        self.state = self.start
        for c in chunks:
            yield self.feed(c)
        yield self.close()

    def stream_text(self, text: str) -> Iterator[bytes]:
        yield from self.stream(text[i : i + CHUNK] for i in range(0, len(text), CHUNK))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.stream_text(text)), "<u4").tolist()


class Decoder:
    """ids -> text, as soon as bytes form whole characters; bytes that never do become U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes_of = [merges.bytes_of.get(i) for i in range(max(merges.bytes_of) + 1)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """A row for each row of docs (doc_id, text; others are not read): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty (no tokens, the hashes of nothing). Ids may be null or repeated: rows are encoded each by
    itself, so there are no ties. Texts of any length are encoded in chunks, with no more state than an open piece's
    window. An empty table gives an empty result.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        dec = Decoder(enc.merges)
        # states are many and none is garbage until all are forgotten: collections would only walk through them
        collecting = gc.isenabled()
        gc.disable()
        try:
            yield from encoded(batches, enc, dec)
        finally:
            if collecting:
                gc.enable()

    def encoded(batches: Iterator[pd.DataFrame], enc: Encoder, dec: Decoder) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch["text"]:
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for ids in enc.stream_text(text or ""):
                    n += len(ids) // 4
                    a.update(ids)
                    b.update(dec.feed(np.frombuffer(ids, "<u4").tolist()).encode())
                b.update(dec.close().encode())
                counts.append(n)
                of_ids.append(a.hexdigest())
                of_text.append(b.hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text})

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file."""
    return Encoder(Merges(path))
