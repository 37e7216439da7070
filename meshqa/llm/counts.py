"""Operator 3: token counts by a compiled finite-state transducer.

Compilation reads the vocabulary and finds where no piece can reach across: before a word mark that follows another
character, and around characters that stand in no piece of several characters. The transducer reads a text character by
character. Its state is the unit read since the last such cut; a transition that closes a unit is annotated with the
number of tokens that it emits. Transitions are determinised on first use and remembered up to a bound: a unit's tokens
are found once, by the library's model or by merging as it does, and the states on the way to it are laid when it comes again.

Every text is read in chunks, and a chunk is a state map. Whatever unit is open where it is entered, it lengthens that by
its head, and then either leaves it open or closes it, emits what its cuts enclose, and leaves another unit open: (head,
emitted, tail). These maps compose associatively, so a text's chunks are summarised apart and joined by a prefix scan,
neighbour by neighbour and level by level. A text's chunks are all read in the task that holds its row.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshqa.llm.common import table, tokenizer_path

SPACE = "▁"
#: Characters of a chunk; any number gives the same counts.
CHUNK = 1 << 12
LIMIT = 4096
#: States that are remembered, and units with their tokens; then they are found anew.
REMEMBERED = 400_000

#: What a chunk does: (head, emitted, tail), or (text, None, "") where it has no cut.
StateMap = tuple[str, int | None, str]
#: A state is a dict: character -> (next state, tokens emitted); None -> the same for the end of the text; UNIT -> the open unit.
#: That is a string, longer than a character: a dict whose keys are all strings is smaller and looked up faster.
UNIT = "unit"


class OpenUnit:
    """The state inside a unit that is new: it gathers characters up to a cut."""

    def __init__(self, machine: Transducer):
        self.machine, self.stay = machine, (self, 0)

    def begin(self, state: dict, c: str) -> OpenUnit:
        self.came, self.text, self.marks = state, [state[UNIT], c], not (state[UNIT] + c).strip(SPACE)
        return self

    def __getitem__(self, c: str | None) -> tuple:
        if c not in self.machine.cuts:
            self.text.append(c)
            self.marks = False
            return self.stay
        if self.marks and c == SPACE:
            self.text.append(c)
            return self.stay
        unit, machine = "".join(self.text), self.machine
        if unit in machine.tokens:
            machine.lay(self.came, unit)
        return machine.entered(c), machine.count_of(unit) + machine.alone(c)


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if bad := [p for p in self.score if SPACE in p.lstrip(SPACE)]:
            raise ValueError(f"pieces with an inner word mark can't be cut there: {bad[:3]}")
        # the library puts a word mark before a text; units that begin with one mark are asked of it without that
        self.library = lambda unit: model.encode(unit[1:])
        self.lowest = min(self.score.values(), default=0.0) - 1
        joined = {c for p in self.score if len(p) > 1 for c in p}
        single = [chr(c) for c in range(128) if chr(c) not in joined and chr(c) != " "]
        self.cuts = {SPACE, None, *single}
        alone = "".join(map(re.escape, single))
        self.units = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.open = OpenUnit(self)
        self.tokens: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.size, self.start, self.marked = 0, {UNIT: ""}, {UNIT: SPACE}

    def merged(self, unit: str) -> int:
        """Tokens of a unit: the best-scored adjacent pair is merged first, leftmost of equals; what is no piece in the
        end falls back to its bytes."""
        parts = self._merge_few(list(unit)) if len(unit) <= 32 else self._merge_many(list(unit))
        return sum(1 if p in self.score else len(p.encode()) for p in parts)

    def _merge_few(self, parts: list[str]) -> list[str]:
        score, none = self.score.get, self.lowest
        found = list(map(score, map(add, parts, parts[1:]), repeat(none)))
        while found and (best := max(found)) != none:
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(found):
                found[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def _merge_many(self, parts: list[str | None]) -> list[str]:
        n, score = len(parts), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := score.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(whole) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (s := score.get(pair := whole + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, pair))
            if (h := before[i]) >= 0 and (s := score.get(pair := parts[h] + whole)) is not None:
                heapq.heappush(heap, (-s, h, pair))
        return [p for p in parts if p is not None]

    def count_of(self, unit: str) -> int:
        if not unit:
            return 0
        n = self.tokens.get(unit)
        if n is None:
            n = len(self.library(unit)) if unit[0] == SPACE and unit[1:2] not in ("", SPACE) else self.merged(unit)
            if len(unit) <= 32:
                if len(self.tokens) >= REMEMBERED:
                    self.tokens.clear()
                self.tokens[unit] = n
        return n

    def alone(self, c: str | None) -> int:
        """Tokens of a character at which a unit is cut and that is a unit by itself."""
        return 0 if c is None or c == SPACE else self.count_of(c)

    def entered(self, c: str | None) -> dict:
        """The state after a cut at c."""
        return self.marked if c == SPACE else self.start

    def lay(self, state: dict, unit: str) -> None:
        """Remember the path from a state to the end of a unit."""
        for c in unit[len(state[UNIT]) :]:
            if c not in state:
                state[c] = {UNIT: state[UNIT] + c}, 0
                self.size += 1
            state = state[c][0]

    def _learn(self, state: dict, c: str | None) -> tuple:
        """Determinise a transition."""
        if self.size >= REMEMBERED:
            self._forget()
        unit = state[UNIT]
        if c not in self.cuts or (c == SPACE and unit and not unit.strip(SPACE)):
            return self.open.begin(state, c), 0
        state[c] = found = self.entered(c), self.count_of(unit) + self.alone(c)
        self.size += 1
        return found

    def run(self, state, text: str) -> tuple:
        """The state after a text and the tokens emitted."""
        emitted = 0
        for c in text:
            try:
                state, n = state[c]
            except KeyError:
                state, n = self._learn(state, c)
            if n:
                emitted += n
        return state, emitted

    def end(self, state) -> int:
        """Tokens of the open unit, if the text ends in a state."""
        try:
            return state[None][1]
        except KeyError:
            return self._learn(state, None)[1]

    def state_map(self, chunk: str) -> StateMap:
        first = self.units.match(chunk)
        if not first or first.end() == len(chunk):
            return chunk, None, ""
        state, emitted = self.run(self.start, chunk[first.end() :])
        return first[0], emitted, state[UNIT] if isinstance(state, dict) else "".join(state.text)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b."""
        head, left, tail = a
        first, right, last = b
        if left is None:
            joint = self.state_map(head + first)
            if right is None:
                return joint
            head, left, tail = joint
            return (head, right, last) if left is None else (head, left + self.count_of(tail) + right, last)
        state, emitted = self.run(self.run(self.start, tail)[0], first)
        if right is None:
            return head, left + emitted, state[UNIT] if isinstance(state, dict) else "".join(state.text)
        return head, left + emitted + self.end(state) + right, last

    def total(self, m: StateMap) -> int:
        """Tokens of a whole text, entered at its start."""
        head, inner, tail = m
        state, emitted = self.run(self.start, head)
        return emitted + self.end(state) + (inner or 0) + self.count_of(tail)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Neighbours are composed pair by pair, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else ("", None, "")

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        return self.total(self.scan([self.state_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]))


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One transducer a Python worker and file."""
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """A row for each row of docs (doc_id, text; others are not read): doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeated: rows are counted each by itself, so there
    are no ties. Texts of any length are counted whole, chunk by chunk. An empty table gives an empty result.
    """

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for batch in texts:
            yield pd.Series([machine.count(t) for t in batch], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
