"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered through a template of control strings, encoded once by a byte-pair
tokenizer, and the byte offsets of its tokens are intersected with the byte spans of its turns by binary
search. Control strings are special tokens, so no token crosses the edge of a turn's text and the mask
covers exactly the texts of the trained roles.

Control strings inside texts (and roles) get a backslash behind their first character, one more where
backslashes stand there already, and lose it again on reading; so a text can never open or end a turn.

Defined cases: turns are ordered by turn (null first), ties by role and text; null role or text is empty;
rows without a conv_id form one conversation of that id; repeated rows are turns of their own; an empty
table gives no rows; other columns are not read. Texts are shuffled once, by conversation, and stream
through the task, which holds one conversation at a time (a conversation has to fit a task, as its
formatted text is one value).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the words that byte-pair merges stay inside of.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
TRAINED = ("assistant",)
#: Bytes of formatted text in one batch of results.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Template:
    """``open`` role ``middle`` text ``close`` for every turn; ``foreign``: strings of other templates that
    are escaped as well. No control string may hold a first character of one behind its own."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self) -> None:
        firsts = {c[0] for c in self.controls}
        if any("\\" in c or firsts & set(c[1:]) for c in self.controls):
            raise ValueError("control strings must not overlap and must not hold a backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.foreign)

    def pattern(self, backslashes: str) -> str:
        """Control strings with ``backslashes`` behind the first character; a group before and one behind that place."""
        firsts = sorted({c[0] for c in self.controls})
        rests = {f: "|".join(re.escape(c[1:]) for c in self.controls if c[0] == f) for f in firsts}
        return "|".join(rf"({re.escape(f)}){backslashes}(\\*(?:{rests[f]}))" for f in firsts)

    @cached_property
    def _plain(self) -> re.Pattern:
        return re.compile(self.pattern(""))

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(self.pattern(r"\\"))

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: "\\".join(g for g in m.groups() if g is not None), text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: "".join(g for g in m.groups() if g is not None), text)

    def render(self, turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
        """The formatted conversation, and for each turn its role and the byte span of its text."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.open}{self.escape(role)}{self.middle}", self.escape(text)
            begin = at + len(head.encode())
            end = begin + len(body.encode())
            parts += [head, body, self.close]
            spans.append((role, begin, end))
            at = end + len(self.close.encode())
        return "".join(parts), spans

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted conversation."""
        turns, at = [], 0
        while at < len(formatted):
            middle = formatted.index(self.middle, at)
            close = formatted.index(self.close, middle)
            turns.append((self.unescape(formatted[at + len(self.open) : middle]), self.unescape(formatted[middle + len(self.middle) : close])))
            at = close + len(self.close)
        return turns


@dataclass
class Encoder:
    """A byte-pair vocabulary with the template's markers as special tokens behind it."""

    vocabulary: bytes
    template: Template = field(default_factory=Template)
    pattern: str = PATTERN

    @cached_property
    def encoding(self) -> tiktoken.Encoding:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.vocabulary.splitlines())}
        markers = (self.template.open, self.template.middle, self.template.close)
        special = {m: max(ranks.values()) + 1 + k for k, m in enumerate(markers)}
        return tiktoken.Encoding("chat", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def widths(self) -> np.ndarray:
        """Bytes of each token."""
        tokens = self.encoding
        out = np.zeros(tokens.max_token_value + 1, np.int64)
        for token in tokens.token_byte_values():
            out[tokens.encode_single_token(token)] = len(token)
        for marker in tokens.special_tokens_set:
            out[tokens.encode_single_token(marker)] = len(marker.encode())
        return out

    def encode(self, formatted: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and the byte offsets between them (one more)."""
        ids = np.array(self.encoding.encode(formatted, allowed_special="all"), np.int32)
        return ids, np.concatenate([[0], np.cumsum(self.widths[ids])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode()


@lru_cache(maxsize=2)
def encoder_of(vocabulary: bytes, template: Template, pattern: str = PATTERN) -> Encoder:
    """An encoder that later tasks of the same worker find again."""
    return Encoder(vocabulary, template, pattern)


def masked_ranges(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each byte span the range of tokens inside it, by binary search; spans without a token are left out."""
    if not spans:
        return []
    begins, ends = np.array(spans, np.int64).T
    first = np.searchsorted(offsets[:-1], begins, "left")
    last = np.searchsorted(offsets[1:], ends, "right")
    return [(int(a), int(b)) for a, b in zip(first, last) if a < b]


_FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("tokens", pa.list_(pa.int32())),
        ("loss", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
    ]
)


def _batches(rows: Iterator[dict], schema: pa.Schema, weight: str | None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight]) if weight else 1024
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_conversations(
    conversations: DataFrame, vocabulary: str = VOCABULARY, template: Template | None = None, trained: tuple[str, ...] = TRAINED
) -> DataFrame:
    """``conv_id, formatted, tokens, loss``: ``loss`` holds the ranges of tokens (end exclusive) that are trained on."""
    template = template or Template()
    data = conversations.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a vocabulary file, about 1 MB

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = encoder_of(data.value, template)

        def row(conv: int | None, turns: list[tuple[str, str]]) -> dict:
            formatted, spans = template.render(turns)
            ids, offsets = encoder.encode(formatted)
            ranges = masked_ranges(offsets, [(a, b) for role, a, b in spans if role in trained])
            return {"conv_id": conv, "formatted": formatted, "tokens": ids, "loss": [{"first": a, "last": b} for a, b in ranges]}

        conv, turns = None, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if turns and c != conv:
                    yield row(conv, turns)
                    turns = []
                conv = c
                turns.append((role or "", text or ""))
        if turns:
            yield row(conv, turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), _FORMATTED, "formatted")

    read = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    dealt = read.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, formatted string, tokens array<int>, loss array<struct<first: int, last: int>>")


_READ = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY, template: Template | None = None) -> DataFrame:
    """What the formatted text and the tokens under the mask say: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``."""
    template = template or Template()
    data = formatted.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = encoder_of(data.value, template)
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("formatted")[k].as_py()
                turns = template.read(text)
                ids = batch.column("tokens")[k].values.to_numpy()
                loss = "".join(template.unescape(encoder.decode(ids[r["first"] : r["last"]])) for r in batch.column("loss")[k].as_py())
                yield {
                    "conv_id": batch.column("conv_id")[k].as_py(),
                    "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest(),
                    "loss_chars": len(loss),
                    "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                    "formatted_chars": len(text),
                }

    return formatted.mapInArrow(lambda batches: _batches(rows(batches), _READ, None), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
