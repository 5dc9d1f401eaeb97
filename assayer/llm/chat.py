"""Chat formatting by token-level assembly: segments encoded apart, reserved ids spliced in, masks by prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.coding import coder
from assayer.llm.common import columns, slices

# Control strings in the order of their ids, which follow the tokenizer's own.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[BOT]", "[ROLE]", "[/ROLE]", "[/TURN]"]
# Opening and closing control strings of a turn by role; any other role is spelled out between [ROLE] and [/ROLE].
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[BOT]", "</s>")}
LEARNED = "assistant"

_TURN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("role_ids", pa.binary()), ("text_ids", pa.binary())])
_TURN_DDL = "conv_id long, turn long, role string, role_ids binary, text_ids binary"
_PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("first", pa.int64()), ("ids", pa.binary()), ("loss", pa.binary()), ("text", pa.string())])
_PIECE_DDL = "conv_id long, piece long, first long, ids binary, loss binary, text string"
_BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_BACK_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _control_pattern(added: list[str]) -> re.Pattern:
    return re.compile("|".join(re.escape(c) for c in sorted([*CONTROLS, *added], key=len, reverse=True)))


def escape(text: str, controls: re.Pattern) -> str:
    """Double every backslash and put one behind the first character of every control string."""
    return controls.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _encode(*vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(*vocabulary)
        controls = _control_pattern(code.added_strings)

        def ids(text: str) -> bytes:
            return np.frombuffer(code.encode(escape(text, controls)), dtype=code.dtype).astype("<u4").tobytes()

        for batch in batches:
            rows = [(c, t, r, b"" if r in MARKS else ids(r), ids(x)) for c, t, r, x in zip(*columns(batch, "conv_id", "turn", "role", "text"))]
            yield from slices(rows, _TURN, 512)

    return run


def _assemble(*vocabulary: str | None):
    """Splice reserved ids around the segments of each turn; the rows come sorted, one conversation after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(*vocabulary)
        reserved = {name: np.array([code.size + k], dtype="<u4") for k, name in enumerate(CONTROLS)}
        fresh, current, piece, position = True, None, 0, 0
        for batch in batches:
            out = []
            for conv_id, role, role_ids, text_ids in zip(*columns(batch, "conv_id", "role", "role_ids", "text_ids")):
                segments, learned = [], []
                if fresh or conv_id != current:
                    fresh, current, piece, position = False, conv_id, 0, 0
                    segments.append(reserved["<s>"])
                content = np.frombuffer(text_ids, dtype="<u4")
                if role in MARKS:
                    opening, closing = MARKS[role]
                    segments += [reserved[opening], content, reserved[closing]]
                else:
                    segments += [reserved["[ROLE]"], np.frombuffer(role_ids, dtype="<u4"), reserved["[/ROLE]"], content, reserved["[/TURN]"]]
                learned = [0] * len(segments)
                learned[-2] = int(role == LEARNED)
                # Where each segment begins, and from the steps at those places the mask: both are prefix sums.
                ends = np.cumsum([len(s) for s in segments])
                steps = np.zeros(int(ends[-1]) + 1, dtype=np.int8)
                np.add.at(steps, ends - [len(s) for s in segments], learned)
                np.add.at(steps, ends, [-v for v in learned])
                mask = np.cumsum(steps)[:-1].astype(np.uint8)
                ids = np.concatenate(segments)
                out.append((conv_id, piece, position, ids.tobytes(), mask.tobytes(), _spell(ids, code)))
                piece += 1
                position += len(ids)
            yield from slices(out, _PIECE, 512)

    return run


def _spell(ids: np.ndarray, code) -> str:
    """The text of ids, control strings for reserved ones."""
    at = np.flatnonzero(ids >= code.size)
    parts, start = [], 0
    for k in at:
        parts += [code.decode(ids[start:k]), CONTROLS[int(ids[k]) - code.size]]
        start = k + 1
    return "".join([*parts, code.decode(ids[start:])])


def _split(ids: np.ndarray, code) -> tuple[str, str]:
    """(role, text) of a turn's ids."""
    at = np.flatnonzero(ids >= code.size)
    names = [CONTROLS[int(ids[k]) - code.size] for k in at]
    if names[0] == "<s>":
        at, names = at[1:], names[1:]
    parts = [unescape(code.decode(ids[a + 1 : b])) for a, b in zip(at[:-1], at[1:])]
    if names[0] == "[ROLE]":
        return parts[0], parts[2] if len(parts) > 2 else parts[1]
    return next(role for role, (opening, _) in MARKS.items() if opening == names[0]), parts[0]


def _read_back(*vocabulary: str | None):
    """Digests of each conversation from the assembled ids and masks alone, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(*vocabulary)
        state: list | None = None

        def done() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for batch in batches:
            out = []
            for conv_id, piece, ids, loss, text in zip(*columns(batch, "conv_id", "piece", "ids", "loss", "text")):
                if piece == 0:
                    if state is not None:
                        out.append(done())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.frombuffer(ids, dtype="<u4"), np.frombuffer(loss, dtype=np.uint8).astype(bool)
                role, content = _split(ids, code)
                learned = unescape(_spell(ids[mask], code))
                state[1] += 1
                state[2].update(f"{role}\n{content}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(text)
            if out:
                yield from slices(out, _BACK)
        if state is not None:
            yield from slices([done()], _BACK)

    return run


def format_chats(turns: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The token ids, loss mask and text of every turn, in the order of its conversation.

    Turns are ordered by turn (null first), then role and text; null role and text are empty; a null conv_id is a
    conversation of its own; repeated rows are turns each; an empty table gives an empty result; other columns are
    ignored. A turn is ``<opening> text <closing>`` by MARKS; only the text of assistant turns is under the mask. Text is
    encoded apart from the control strings, so it never yields a reserved id, and escaped, so that the spelled text can
    be read back as well. Turns stream through sorted partitions: a conversation of any length takes no more memory than
    its longest turn.
    Result: conv_id, piece (from 0), first (tokens before it in the conversation), ids and loss (packed), text.
    """
    vocabulary = (tokenizer_path, ranks_path, pattern)
    text = F.coalesce("text", F.lit(""))
    read = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    encoded = read.mapInArrow(_encode(*vocabulary), _TURN_DDL)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_ids")
    return ordered.mapInArrow(_assemble(*vocabulary), _PIECE_DDL)


def read_chats(pieces: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """What format_chats wrote, read back from ids and masks; ``pieces`` must come in its order.

    Result: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    return pieces.mapInArrow(_read_back(tokenizer_path, ranks_path, pattern), _BACK_DDL)
