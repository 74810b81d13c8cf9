r"""Chat formatting by token-level assembly.

Every turn's text is escaped and encoded on its own; the template's control
strings are spliced in as reserved ids above the vocabulary, so no text can
produce one.  A conversation is

    <s> turn turn ...           with turns
    [INST] text [/INST]                         user
    <<SYS>> text <</SYS>>                       system
    <|assistant|> text </s>                     assistant
    <|role|> role <|text|> text <|end|>         any other role

Escaping is reversible: a backslash is doubled, and a control string gets one
backslash after its first character; reading drops the backslash before any
character.  The formatted string thus holds control strings only where the
template put them.

The loss mask comes from prefix sums: +1 where a learned span begins, -1
after its end.  Assistant texts are learned, and with `learn_stop` the </s>
behind them.

Turns are encoded where they are read, then dealt by conversation and sorted
by turn.  A conversation is streamed in order and leaves as one row per turn
with its token offset, so a conversation of any length needs the memory of a
few turns.

Defined cases: a null text is empty, a null role is the empty role; turns
with equal numbers are ordered by role, then by hash of the text; rows with a
null conversation id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, list_array, pick

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|assistant|>", "<|role|>", "<|text|>", "<|end|>")
TURNS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<|assistant|>", "</s>")}
#: A longer text is encoded in pieces of so many characters (all of them).
PIECE = 8192
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """Text ids of a byte-level vocabulary, control ids above them."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("text", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first_control = max(ranks.values()) + 1
        self.control = {c: self.first_control + i for i, c in enumerate(CONTROLS)}
        self.name = {i: c for c, i in self.control.items()}

    def encode(self, text: str) -> list[int]:
        out = []
        for i in range(0, len(text), PIECE):
            out += self.encoding.encode_ordinary(text[i:i + PIECE])
        return out

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """(ids, begin, end of the text's ids)."""
        body = self.encode(escape(text))
        if role in TURNS:
            opening, closing = TURNS[role]
            head = [self.control[opening]]
        else:
            closing = "<|end|>"
            head = [self.control["<|role|>"], *self.encode(escape(role)), self.control["<|text|>"]]
        return head + body + [self.control[closing]], len(head), len(head) + len(body)


def _encode(ranks_file: bytes, pattern: str, learn_stop: bool):
    def run(batches):
        codec = Codec(ranks_file, pattern)
        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            turns = [codec.turn(r or "", t or "") for r, t in zip(roles, texts)]
            ptr = np.concatenate([[0], np.cumsum([len(x[0]) for x in turns])])
            mark = np.zeros(ptr[-1] + 1, np.int8)
            for at, role, (_, begin, end) in zip(ptr.tolist(), roles, turns):
                if role == "assistant":
                    mark[at + begin] += 1
                    mark[at + end + learn_stop] -= 1
            yield {"conv_id": b.column("conv_id"), "turn": b.column("turn"), "role": b.column("role"), "tie": b.column("tie"),
                   "ids": list_array(np.concatenate([x[0] for x in turns]).astype(np.int32), ptr),
                   "mask": list_array(np.cumsum(mark, dtype=np.int8)[:-1], ptr)}
    return run


def _assemble(begin_id: int):
    """Streams sorted turns: conversation starts get <s>, every row its place and token offset."""
    def run(batches):
        conv, place, offset = object(), 0, 0
        for b in batches:
            names = b.column("conv_id").to_pylist()
            lengths = np.diff(b.column("ids").offsets.to_numpy())
            places, offsets, starts = [], [], []
            for name, n in zip(names, lengths.tolist()):
                starts.append(name != conv or place == 0)
                if starts[-1]:
                    conv, place, offset = name, 0, 0
                places.append(place)
                offsets.append(offset)
                place, offset = place + 1, offset + n + starts[-1]
            starts = np.array(starts)
            ptr = np.concatenate([[0], np.cumsum(lengths)])
            at = ptr[:-1][starts]
            ids = np.insert(b.column("ids").flatten().to_numpy(), at, begin_id)
            mask = np.insert(b.column("mask").flatten().to_numpy(), at, 0)
            ptr = ptr + np.concatenate([[0], np.cumsum(starts)])
            yield {"conv_id": b.column("conv_id"), "place": places, "offset": offsets,
                   "ids": list_array(ids, ptr), "mask": list_array(mask, ptr)}
    return run


def _read_back(ranks_file: bytes, pattern: str):
    """Streams assembled rows; per conversation, what its ids and mask say."""
    def run(batches):
        codec = Codec(ranks_file, pattern)
        role_of = {codec.control[o]: r for r, (o, _) in TURNS.items()}
        conv, turns, loss, counts = None, None, None, None

        def row():
            return {"conv_id": [conv], "n_turns": [counts[0]], "turns_sha256": [turns.hexdigest()], "loss_chars": [counts[1]],
                    "loss_sha256": [loss.hexdigest()], "formatted_chars": [counts[2]]}

        for b in batches:
            for name, place, ids, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "ids", "mask"))):
                if place == 0:
                    if counts:
                        yield row()
                    conv, turns, loss, counts = name, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                # control ids part the row into texts
                at = [i for i, x in enumerate(ids) if x >= codec.first_control]
                counts[2] += sum(len(codec.name[ids[i]]) for i in at)
                texts = {ids[i]: codec.decode(ids[i + 1:j]) for i, j in zip(at, [*at[1:], len(ids)])}
                counts[2] += sum(map(len, texts.values()))
                opening = ids[at[1]] if ids[0] == codec.control["<s>"] else ids[0]
                if opening in role_of:
                    role, text = role_of[opening], texts[opening]
                else:
                    role, text = unescape(texts[codec.control["<|role|>"]]), texts[codec.control["<|text|>"]]
                turns.update(f"{role}\n{unescape(text)}\n".encode())
                learned = unescape(codec.decode([x for x, m in zip(ids, mask) if m and x < codec.first_control]))
                loss.update(learned.encode())
                counts[0] += 1
                counts[1] += len(learned)
        if counts:
            yield row()
    return run


def assemble(conversations: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, learn_stop: bool = True,
             conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn, in order within a partition: conv_id, place, offset (in tokens), ids, mask."""
    with open(tokenizer, "rb") as f:  # below 1 MB; read here, so executors need no path
        ranks_file = f.read()
    c = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text).withColumn("tie", F.xxhash64("text"))
    kind = {n: c.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}
    encoded = arrow_map(c, _encode(ranks_file, pattern, learn_stop),
                        f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, tie long, ids array<int>, mask array<tinyint>")
    dealt = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return arrow_map(dealt, _assemble(Codec(ranks_file, pattern).control["<s>"]),
                     f"conv_id {kind['conv_id']}, place long, offset long, ids array<int>, mask array<tinyint>")


def read_back(assembled: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the rows of `assemble`."""
    with open(tokenizer, "rb") as f:
        ranks_file = f.read()
    kind = assembled.schema["conv_id"].dataType.simpleString()
    return arrow_map(assembled, _read_back(ranks_file, pattern),
                     f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
