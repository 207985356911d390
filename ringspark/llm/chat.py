"""Chat formatting in budgeted windows.

A conversation is cut into windows of at most `budget` tokens, each a span of whole turns. Prefix sums of the turns' tokens
choose the spans: a window takes new turns as long as the difference of prefix sums fits. Every window begins with the
conversation's system turn and repeats the last turns before the span as far as `history` tokens allow. Loss is asked for on
assistant turns only, and only where they are new: repeated ones are masked, so each is a target exactly once.

The template marks turns by control strings. In texts, a backslash is put after the first character of each control
string, and backslashes are doubled; so no text can hold a control string, and the text can be read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringspark.llm.common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
# Strings that chat models give a meaning of their own.
CONTROL = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")
_CONTROL = re.compile(f"(?=(?:{'|'.join(map(re.escape, CONTROL))}))(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)
WINDOWS = "conv_id long, window long, formatted string, n_turns long, n_repeated long, tokens long, loss string, over boolean"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    """A role stands on the first line of its turn, so line ends are escaped as well."""
    return escape(role).replace("\n", "\\n").replace("\r", "\\r") if role else ""


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), role)


def turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text, and the span of the escaped text, of each turn of a formatted window."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


class Formatter:
    """Takes the turns of one conversation in order and gives its windows. Holds one window and its history."""

    def __init__(self, conv_id, budget: int, history: int, system: tuple[str, int] | None):
        self.conv_id, self.budget, self.history, self.system = conv_id, budget, history, system
        self.past: deque = deque()  # (text of the turn, prefix sum after it, tokens)
        self.number, self.span, self.repeated, self.begin, self.head = 0, [], [], 0, 0

    def _open(self, prefix: int, tokens: int) -> None:
        """A span begins with a turn of these tokens after this prefix sum: the system turn and the history that fits are repeated."""
        self.begin = prefix
        self.repeated, self.head = ([self.system[0]], self.system[1]) if self.system and self.number else ([], 0)
        kept = []
        for text, after, own, is_system in reversed(self.past):
            if is_system or prefix - (after - own) > self.history or self.head + own + tokens > self.budget:
                break
            kept.append(text)
            self.head += own
        self.repeated += reversed(kept)

    def add(self, role: str, text: str, tokens: int, prefix: int, is_system: bool) -> Iterator[tuple]:
        """prefix: the sum of tokens up to this turn, itself included."""
        if self.span and self.head + prefix - self.begin > self.budget:
            yield self.close()
        if not self.span:
            self._open(prefix - tokens, tokens)
        self.span.append((turn(role, text), role, tokens, is_system, prefix))

    def close(self) -> tuple:
        text, spans = "".join(self.repeated), []
        for formatted, role, _, _, _ in self.span:
            if role == "assistant":
                at = len(text) + len(START) + len(escape_role(role)) + 1
                spans.append([at, len(text) + len(formatted) - len(END) - 1])
            text += formatted
        tokens = self.head + self.span[-1][4] - self.begin
        row = (self.conv_id, self.number, text, len(self.span), len(self.repeated), tokens, json.dumps(spans), tokens > self.budget)
        for formatted, _, tokens, is_system, prefix in self.span:
            self.past.append((formatted, prefix, tokens, is_system))
        while self.past and self.past[-1][1] - (self.past[0][1] - self.past[0][2]) > self.history and len(self.past) > 1:
            self.past.popleft()
        self.number, self.span = self.number + 1, []
        return row


def counted(turns: DataFrame, vocabulary: str) -> DataFrame:
    """turns (conv_id, turn, role, text; nulls empty) with tokens: what the formatted turn takes in a public vocabulary."""
    small_batches(turns.sparkSession)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(vocabulary)
        coder.encode_special_tokens = True
        for roles, texts in batches:
            # only lengths are wanted, so no offsets are made
            coded = coder.encode_batch_fast([turn(r, t) for r, t in zip(roles, texts, strict=True)], add_special_tokens=False)
            yield pd.Series([len(c.ids) for c in coded], dtype="int64")

    full = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return full.withColumn("tokens", tokens("role", "text"))


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """The windows of all conversations, as in WINDOWS; loss is a JSON list of the spans of `formatted` under the loss mask.

    Turns come in order of turn, then role and text; null turns first. The system turn is the first turn if its role is
    system. Nothing is cut: a turn that is over the budget, alone or with the system turn, is a window of its own with the
    system turn and without history, and `over` marks such a window; all others keep to the budget. Rows with a null conv_id are
    one conversation. Repeated rows are turns that repeat. An empty table gives an empty one; other columns are ignored.
    Conversations are streamed in order, so even one with most of all rows takes the memory of a window.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sums = counted(turns, vocabulary).withColumn("prefix", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(order))
    dealt = sums.sortWithinPartitions("conv_id", "at").select(F.col("conv_id").cast("string").alias("conv_id"), "at", "role", "text", "tokens", "prefix")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in WINDOWS.split(", ")]
        now = None
        for b in batches:
            rows = []
            for conv, at, role, text, tokens, prefix in zip(*(b[c].tolist() for c in ("conv_id", "at", "role", "text", "tokens", "prefix")), strict=True):
                first = at == 1
                if first:
                    if now and now.span:
                        rows.append(now.close())
                    system = (turn(role, text), tokens) if role == "system" else None
                    now = Formatter(None if conv is None else int(conv), budget, history, system)
                rows += now.add(role, text, tokens, prefix, first and role == "system")
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)
        if now and now.span:
            yield pd.DataFrame([now.close()], columns=names, dtype=object)

    return dealt.mapInPandas(put, WINDOWS)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, read back from windows alone."""
    dealt = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "window", "formatted", "n_repeated", "loss")
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        now: list | None = None

        def row() -> tuple:
            conv, n, turns, chars, loss, size, count = now
            return None if conv is None else int(conv), n, turns.hexdigest(), chars, loss.hexdigest(), size, count

        for b in batches:
            rows = []
            for conv, number, text, repeated, loss in zip(*(b[c].tolist() for c in ("conv_id", "window", "formatted", "n_repeated", "loss")), strict=True):
                if number == 0:
                    if now:
                        rows.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said, _, _ in parse(text)[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for lo, hi in json.loads(loss):
                    said = unescape(text[lo:hi])
                    now[3] += len(said)
                    now[4].update(said.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
                now[6] += 1
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)
        if now:
            yield pd.DataFrame([row()], columns=names, dtype=object)

    return dealt.mapInPandas(put, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
