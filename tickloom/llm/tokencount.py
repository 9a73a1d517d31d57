"""Token counts by a compiled finite-state tokenizer.

A BPE model's greedy merges are compiled, state by state as texts need them, to a deterministic transducer over
characters. What the future needs of the past is: for each start j of a suffix that some piece begins with, the last
token of the encoding that ends at j and the count up to j. That is a state; a transition carries the change of the
token count. The encoding of a prefix is unique and two neighbouring tokens are settled by their pair alone (they stay
apart in the whole exactly if they do in the pair), so the state decides everything.

A chunk of a text maps entry states to exit states and counts. Where a word begins, every state falls into one; so a
map is its head (the text before the first word start, run when the entry is known) and a constant. The constant is the
sum over words, whose exit states and counts are kept once they were run. Maps compose, and a text's chunks are composed
pairwise, level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, table

#: What the model writes for a space.
SPACE = "▁"
#: Characters of a chunk.
CHUNK = 4096
#: A word as the machine sees it: the spaces before it begin it.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Characters of a word, and words, that a worker keeps the results of.
LONGEST_WORD, MOST_WORDS = 48, 200_000
#: States beyond which a worker compiles anew, so that its memory is bounded.
MOST_STATES = 300_000


class State(dict):
    """Character -> (next state, change of the count); compiled when first asked for."""

    __slots__ = ("live", "machine", "word")

    def __init__(self, machine: Machine, live: tuple, word: bool):
        super().__init__()
        self.machine, self.live, self.word = machine, live, word

    def __missing__(self, c: str) -> tuple[State, int]:
        self[c] = found = self.machine.compile(self, c)
        return found


class Machine:
    """The transducer of a set of pieces with scores. Characters outside it cost a token for each byte."""

    def __init__(self, scores: dict[str, float]):
        for piece in scores:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"a piece goes on after a word: {piece!r}")
        self.scores = scores
        self.beginnings = {p[:n] for p in scores for n in range(1, len(p))}
        self.forget()

    def forget(self) -> None:
        """Drops all compiled states."""
        self.states: dict[tuple, State] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[State, int]] = {}
        self.start = self.state((("", None, 0),), False)

    def state(self, live: tuple, word: bool) -> State:
        key = (live, word)
        if key not in self.states:
            self.states[key] = State(self, live, word)
        return self.states[key]

    def merged(self, text: str) -> list[str]:
        """The greedy merges of a short text: best score first, leftmost among equals. Only the compiler calls this."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max(((self.scores.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def stay_apart(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        if (a, b) not in self.apart:
            self.apart[a, b] = self.merged(a + b) == [a, b]
        return self.apart[a, b]

    def compile(self, at: State, c: str) -> tuple[State, int]:
        if c == SPACE and at.word:  # no piece goes on: this word's past is settled
            nxt, n = self.start[SPACE]
            return nxt, n
        token, count = next((s + c, n) for s, last, n in at.live if (not s or s + c in self.scores) and self.whole(s + c) and self.stay_apart(last, s + c))
        change = count + (1 if token in self.scores else len(token.encode()))
        live = tuple((s + c, last, n - change) for s, last, n in at.live if s + c in self.beginnings)
        return self.state((*live, ("", token, 0)), c != SPACE), change

    @lru_cache(maxsize=1 << 16)  # noqa: B019  one machine lives as long as its worker
    def whole(self, token: str) -> bool:
        """Whether the merges of a token's own text end in it."""
        return len(token) == 1 or self.merged(token) == [token]

    def run(self, at: State, text: str) -> tuple[State, int]:
        n = 0
        for c in text:
            at, more = at[c]
            n += more
        return at, n

    def word(self, text: str) -> tuple[State, int]:
        """Exit state and count of a word, whatever comes before it."""
        found = self.words.get(text)
        if found is None:
            found = self.run(self.start, text)
            if len(text) <= LONGEST_WORD:
                if len(self.words) >= MOST_WORDS:
                    self.words.clear()
                self.words[text] = found
        return found


@dataclass(frozen=True)
class ChunkMap:
    """Entry state -> exit state and count: the head is run from the entry; then `count` more, and `exit`.

    exit is None where no word begins inside: then the head is the whole chunk.
    """

    head: str
    count: int = 0
    exit: State | None = None

    def then(self, after: ChunkMap, machine: Machine) -> ChunkMap:
        if self.exit is None:
            return ChunkMap(self.head + after.head, after.count, after.exit)
        at, n = machine.run(self.exit, after.head)
        return ChunkMap(self.head, self.count + n + after.count, at if after.exit is None else after.exit)


def chunk_map(text: str, machine: Machine) -> ChunkMap:
    at = text.find(SPACE, 1)
    while at > 0 and text[at - 1] == SPACE:
        at = text.find(SPACE, at + 1)
    if at <= 0:
        return ChunkMap(text)
    n, end = 0, machine.start
    for w in WORD.findall(text, at):
        end, more = machine.word(w)
        n += more
    return ChunkMap(text[:at], n, end)


def count_tokens(text: str, machine: Machine, chunk: int = CHUNK) -> int:
    """Tokens of a text that is normalised already (spaces as the model writes them, one before the text)."""
    maps = [chunk_map(text[a : a + chunk], machine) for a in range(0, len(text), chunk)]
    while len(maps) > 1:  # the scan's upward sweep
        maps = [maps[i].then(maps[i + 1], machine) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    if not maps:
        return 0
    return maps[0].count + machine.run(machine.start, maps[0].head)[1]


@lru_cache(maxsize=2)
def compiled(path: str) -> tuple[Machine, sentencepiece.SentencePieceProcessor]:
    """The machine of a model file and the library, which normalises texts, once for each worker process."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return Machine({model.id_to_piece(i): model.get_score(i) for i in ids}), model


def counted(docs: DataFrame, path: str, limit: int = 4096, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    Null and empty texts have no bytes and tokens; repeated rows stay; an empty table gives an empty one. A text is counted where it lies, without a shuffle. Input columns of
    these names are replaced. The model file must be at the same path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, model = compiled(path)
        for part in slices(batches, text_col):
            counts = [count_tokens(model.normalize(t), machine, chunk) if t else 0 for t in part.column(text_col).to_pylist()]
            if len(machine.states) > MOST_STATES:
                machine.forget()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], names=[*part.schema.names, "n_tokens"])

    rows = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "n_tokens bigint"])
    return rows.mapInArrow(run, schema).withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    rows = counted(only(table(spark, sf_dir, "documents"), "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_bytes", "n_tokens", "over_limit")
