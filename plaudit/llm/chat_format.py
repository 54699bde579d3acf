"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is ``<|turn|>role<|text|>text<|end|>``.
Control strings inside roles and texts are escaped reversibly (a backslash code
replaces their first character, backslashes are doubled), so the marks of the output
are exactly the template's. The rendered text is encoded once with character
offsets; the sorted assistant spans are intersected with the sorted token spans by
binary search. A token that reaches into a span carries the loss, and the character
spans under the mask are the token spans clipped to it, so tokens that straddle a
mark never leak the mark.

Turns are ordered by (turn, role, text), null turns first. Null texts and roles are
empty strings. Rows without conv_id belong to no conversation: each is one of its
own. Repeated rows are repeated turns. One conversation is one output row, so the
largest conversation bounds the memory of a task.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: fixed values: control strings of common chat templates, never left bare in a text
CONTROLS = (TURN, TEXT, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>",
            "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>", "<pad>")
_CODES = {"<": "\\l", "[": "\\b", "\\": "\\\\"}
_BACK = {v: k for k, v in _CODES.items()}
_ESCAPE = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_UNESCAPE = re.compile(r"\\[\\lb]")
_PARSE = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(CLOSE)}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _CODES[m.group()], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m.group()], text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the character spans of the loss role's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _PARSE.findall(formatted)]


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]):
    """Loss mask per token and the character spans under it, by binary search of each
    span's ends among the sorted token spans."""
    mask = np.zeros(len(starts), bool)
    out: list[tuple[int, int]] = []
    for a, b in spans:
        lo = int(np.searchsorted(ends, a, side="right"))
        hi = int(np.searchsorted(starts, b, side="left"))
        mask[lo:hi] = True
        for s, e in zip(np.maximum(starts[lo:hi], a).tolist(), np.minimum(ends[lo:hi], b).tolist()):
            if out and s <= out[-1][1] and out[-1][1] > a:
                out[-1] = (out[-1][0], max(e, out[-1][1]))
            elif e > s:
                out.append((s, e))
    return mask, out


@lru_cache(2)
def encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer, processors

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    tok.post_processor = processors.ByteLevel(trim_offsets=False)  # spans cover every character
    return tok


def _format(path: str):
    def run(batches):
        tok = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [render([(t["role"] or "", t["text"] or "") for t in turns])
                        for turns in part.column(1).to_pylist()]
                ids, starts, ends, masks, loss = [], [], [], [], []
                for (_, spans), e in zip(done, tok.encode_batch([f for f, _ in done], add_special_tokens=False)):
                    off = np.array(e.offsets, np.int64).reshape(-1, 2)
                    mask, under = align(off[:, 0], off[:, 1], spans)
                    ids.append(e.ids), starts.append(off[:, 0]), ends.append(off[:, 1])
                    masks.append(mask), loss.append([{"start": s, "end": t} for s, t in under])
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f for f, _ in done], pa.string()), pa.array(ids, pa.list_(pa.int32())),
                     pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
                     pa.array(masks, pa.list_(pa.bool_())), pa.array(loss, span)],
                    ["conv_id", "formatted", "ids", "starts", "ends", "loss", "loss_spans"])
    return run


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, formatted, ids, starts, ends, loss (per token), loss_spans (characters)
    of ``rows(conv_id, turn, role, text)``."""
    kind = dict(rows.dtypes)["conv_id"]
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    convs = (rows.select("conv_id", own.alias("single"), F.struct("turn", "role", "text").alias("t"))
             .groupBy("conv_id", "single").agg(F.array_sort(F.collect_list("t")).alias("turns")))
    # the aggregate's own order of nulls differs from the stated one
    ordered = convs.select("conv_id", F.sort_array("turns").alias("turns"))
    return ordered.mapInArrow(_format(tokenizer), (
        f"conv_id {kind}, formatted string, ids array<int>, starts array<int>, ends array<int>, "
        "loss array<boolean>, loss_spans array<struct<start: long, end: long>>"))


def _read_back(batches):
    for batch in batches:
        n, th, lc, lh, size = [], [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
            n.append(len(turns))
            th.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            lc.append(len(loss))
            lh.append(hashlib.sha256(loss.encode()).hexdigest())
            size.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(th, pa.string()), pa.array(lc, pa.int64()),
             pa.array(lh, pa.string()), pa.array(size, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What an output row says when read back: turns by parsing the formatted text,
    loss text by the spans under the mask."""
    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long"))
