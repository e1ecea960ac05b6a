"""Chat formatting with loss masks aligned by character offsets.

A conversation is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn; inside roles and texts every
``<``, any number of ``!``, ``|`` gets one ``!`` more, so no control string can stand there and removing one gives the
text back. The rendering is encoded once, with offsets; the three control strings are single added tokens, so no token
reaches from a text into a mark. Turn spans and token spans are both sorted, and binary search gives the tokens under
each assistant text.

Rows of a conversation are ordered by turn, then role and text. They stream in that order through the tasks that own
the conversation, in pieces of ``piece_chars`` characters at most beside one turn, cut only before a mark, where the
encoder cuts as well: a conversation of any size takes bounded memory, and comes out as one row for each piece
(``piece`` counts from 0; nearly always the only one).

Null texts and roles are empty. A null conv_id is a conversation of its own and comes back as null. Repeated rows are
turns of their own. An empty table gives no conversations. Other columns aren't read, whatever their names. A turn isn't
split, so a very long one takes memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_PLAIN, _ESCAPED = re.compile(r"<(!*)\|"), re.compile(r"<!(!*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<!\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a rendering."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition(SEP)
        out.append((unescape(role), unescape(text.removesuffix(END))))
    return out


def render(turns: list[tuple[str, str]], learn: str) -> tuple[str, list[tuple[int, int]]]:
    """The text and the spans of the turns to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(spans: list[tuple[int, int]], begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Tokens that meet a span, by binary search over the sorted offsets, and the characters of each span under them."""
    out, covered = np.zeros(len(begin), bool), []
    top = np.maximum.accumulate(end) if len(end) else end  # tokens of one character may share its offsets
    for a, b in spans:
        i, j = int(np.searchsorted(top, a, "right")), int(np.searchsorted(begin, b, "left"))
        if a < b and i < j:
            out[i:j] = True
            covered.append((max(a, int(begin[i])), min(b, int(top[j - 1]))))
    return out, covered


def load_tokenizer(path: str):
    """A byte-level BPE tokenizer whose offsets leave out nothing, with the control strings added."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
    return t


def format_conversations(conversations: DataFrame, tokenizer: str, learn: str = "assistant", piece_chars: int = 4_000_000) -> DataFrame:
    """conv_id, piece, n_turns, formatted, ids, loss_mask, loss_spans ([start, end) characters of formatted)."""
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = load_tokenizer(tokenizer)
        ready: list[tuple] = []

        def flush() -> pd.DataFrame:
            made = [render(turns, learn) for _, _, turns in ready]
            rows = []
            for (conv, piece, turns), (text, spans), e in zip(ready, made, t.encode_batch([x for x, _ in made], add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                on, covered = mask(spans, offsets[:, 0], offsets[:, 1])
                rows.append((conv, piece, len(turns), text, np.array(e.ids, np.int32), on, [[a, b] for a, b in covered]))
            ready.clear()
            x = pd.DataFrame(rows, columns=["conv_id", "piece", "n_turns", "formatted", "ids", "loss_mask", "loss_spans"])
            x["conv_id"] = x["conv_id"].astype("Int64")
            return x

        now, piece, turns, size, held = object(), 0, [], 0, 0
        for x in frames:
            ids = [None if pd.isna(c) else int(c) for c in x["conv_id"]]
            for conv, role, text in zip(ids, x["role"], x["text"], strict=True):
                new = conv != now
                if turns and (new or size + len(text) > piece_chars):
                    ready.append((now, piece, turns))
                    held += size
                    turns, size, piece = [], 0, piece + 1
                    if held > piece_chars or len(ready) >= 512:
                        yield flush()
                        held = 0
                if new:
                    now, piece = conv, 0
                turns.append((role, text))
                size += len(role) + len(text)
        if turns:
            ready.append((now, piece, turns))
        if ready:
            yield flush()

    return dealt.mapInPandas(run, "conv_id long, piece int, n_turns long, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<array<long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens, all read back
    from the output. Pieces of a conversation follow each other, so digests go on from one to the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, rows = object(), None, []

        def row():
            n, h, chars, loss, size, tokens, learnt = state
            return now, n, h.hexdigest(), chars, loss.hexdigest(), size, tokens, learnt

        def out():
            x = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"])
            x["conv_id"] = x["conv_id"].astype("Int64")
            return x

        for x in frames:
            for conv, text, on, spans in zip(x["conv_id"], x["formatted"], x["loss_mask"], x["loss_spans"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != now:
                    if state:
                        rows.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in spans:
                    said = unescape(text[int(a) : int(b)])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += len(on)
                state[6] += int(np.sum(on))
            if len(rows) >= 1000:
                yield out()
                rows = []
        if state:
            rows.append(row())
        if rows:
            yield out()

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
