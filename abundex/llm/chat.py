"""Chat formatting: whole conversations rendered once, encoded once with offsets, masks cut on turn spans.

A conversation is one row of the output and is rendered as a whole. The template:

    <s>[INST] user text [/INST] assistant text </s><s>[ROLE] other role [TEXT] its text [/ROLE]

Control strings inside texts get a backslash before them (a run of backslashes before one grows by one), so a control
string without a backslash is always the template's, and parse() gives every turn back. Token spans come from the
tokenizer's offsets; sorted turn spans meet them by binary search. The loss mask marks the tokens that overlap the text
of assistant turns, and loss_spans holds the overlaps themselves, which together are each assistant text once.

Defined cases: null text or role is empty; turns sort by turn (null first), then role, then text, so ties and repeated
rows have one order; a null conv_id is a conversation of its own; empty texts are kept as empty turns; extra columns
are left out of the output; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]"]
_ANY = "|".join(map(re.escape, CONTROL))
_INSIDE = re.compile(rf"(\\*)({_ANY})")
_ESCAPED = re.compile(rf"\\(\\*)({_ANY})")
_TEMPLATE = re.compile(rf"(?<!\\)(?:{_ANY})")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "conv_id long, formatted string, turn_spans array<struct<role:string,start:int,end:int>>, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _INSIDE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted conversation, and (role, start, end) of each turn's escaped text."""
    parts, spans, at = [], [], 0

    def add(x: str) -> None:
        nonlocal at
        parts.append(x)
        at += len(x)

    for role, text in turns:
        before, after = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}.get(role) or (f"<s>[ROLE] {escape(role)} [TEXT] ", " [/ROLE]")
        add(before)
        body = escape(text)
        spans.append((role, at, at + len(body)))
        add(body)
        add(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    marks = [(m.start(), m.end(), m[0]) for m in _TEMPLATE.finditer(formatted)]
    for i, (start, end, mark) in enumerate(marks):
        if mark == "[/INST]":
            turns.append(("user", unescape(formatted[marks[i - 1][1] + 1 : start - 1])))
        elif mark == "</s>":
            turns.append(("assistant", unescape(formatted[at + 1 : start - 1])))
        elif mark == "[/ROLE]":
            turns.append((unescape(formatted[marks[i - 2][1] + 1 : marks[i - 1][0] - 1]), unescape(formatted[marks[i - 1][1] + 1 : start - 1])))
        if mark in ("[/INST]", "</s>", "[/ROLE]"):
            at = end
    return turns


def loss_overlaps(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The mask over tokens, and the parts of the spans that tokens cover (token spans are sorted)."""
    mask = np.zeros(len(starts), bool)
    covered = []
    for lo, hi in spans:
        if lo == hi:
            continue
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        mask[first:last] = True
        at = None
        for s, e in zip(np.maximum(starts[first:last], lo).tolist(), np.minimum(ends[first:last], hi).tolist()):
            if at is not None and s <= at[1]:
                at[1] = max(at[1], e)
            else:
                if at:
                    covered.append(tuple(at))
                at = [s, e]
        if at:
            covered.append(tuple(at))
    return mask, covered


_LOADED: dict = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
    return _LOADED[path]


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER, batch_chars: int = 1 << 20) -> DataFrame:
    """One row a conversation: formatted text, turn spans, token ids and offsets, loss mask and loss spans."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t")).select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: x["text"]).alias("texts"))
    span = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    loss = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def encode(group: list[tuple]) -> pa.RecordBatch:
        rendered = [render(list(zip(r, t))) for _, r, t in group]
        encoded = _tokenizer(tokenizer).encode_batch([x for x, _ in rendered], add_special_tokens=False)
        cols: list[list] = [[] for _ in range(8)]
        for (conv, _, _), (text, spans), e in zip(group, rendered, encoded):
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            mask, covered = loss_overlaps(offsets[:, 0], offsets[:, 1], [(s, t) for role, s, t in spans if role == "assistant"])
            for c, x in zip(cols, (conv, text, [{"role": r, "start": s, "end": t} for r, s, t in spans], e.ids, offsets[:, 0], offsets[:, 1], mask, [{"start": s, "end": t} for s, t in covered])):
                c.append(x)
        kinds = [pa.int64(), pa.string(), pa.list_(span), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(loss)]
        names = ["conv_id", "formatted", "turn_spans", "token_ids", "token_starts", "token_ends", "loss_mask", "loss_spans"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches):
        for b in batches:
            group, size = [], 0
            for row in zip(b["conv_id"].to_pylist(), b["roles"].to_pylist(), b["texts"].to_pylist()):
                group.append(row)
                size += sum(map(len, row[2]))
                if size >= batch_chars:
                    yield encode(group)
                    group, size = [], 0
            if group:
                yield encode(group)

    return grouped.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digest, from the formatted text and the loss spans alone."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, spans in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["loss_spans"].to_pylist()):
                turns = parse(text)
                learned = "".join(unescape(x) for x in _by_turn(text, spans))
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _by_turn(text: str, spans: list[dict]) -> list[str]:
    """The masked texts; spans that touch within a turn are one (an escape must not be cut)."""
    out: list[str] = []
    end = None
    for s in spans:
        if end == s["start"]:
            out[-1] += text[s["start"] : s["end"]]
        else:
            out.append(text[s["start"] : s["end"]])
        end = s["end"]
    return out


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra)))


#: The same digest from the table itself; formatted_chars follows from the template and the escapes.
ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') role_, coalesce(text, '') text_ from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (
  select *, length(text_) + len(regexp_extract_all(text_, '<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[TEXT\]|\[/ROLE\]')) esc,
    length(role_) + len(regexp_extract_all(role_, '<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[TEXT\]|\[/ROLE\]')) esc_role from t)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role_ || chr(10) || text_ || chr(10), '' order by turn nulls first, role_, text_)) turns_sha256,
  coalesce(sum(length(text_)) filter (role_ = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text_, '' order by turn nulls first, role_, text_) filter (role_ = 'assistant'), '')) loss_sha256,
  sum(esc + case role_ when 'user' then 18 when 'assistant' then 6 else esc_role + 26 end)::bigint formatted_chars
from n group by conv_id
"""
