"""Operator 7: chat formatting. Transcripts are parsed by a hidden Markov model and rendered as canonical turns.

A transcript is text in which turns follow each other, most often behind speaker markers (``User:``, ``### Assistant``,
``<|system|>``, ``[INST]``, ``**Human**:`` and the like). Each line is an observation: its marker, if it has one, and features of the
line. Hidden states are a role together with whether the line opens a turn or carries it on. Transition and emission weights
are set by hand below (no labelled transcripts are needed); Viterbi finds the likeliest path, turns are cut where an opening
state stands, and rendered as ``<|im_start|>role``, text, ``<|im_end|>``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
NAMES = {
    "system": "system|sys|instructions?|context|system prompt|developer",
    "user": "user|human|you|question|q|prompter|customer|client|me|student|usr|input|instruction",
    "assistant": "assistant|ai|bot|chatbot|gpt|chatgpt|model|answer|a|response|agent|teacher|output|helper",
    "tool": "tool|function|ipython|observation|tool output|environment",
}
_any = "|".join(NAMES.values())
#: A marker opens a line: framed by tokens or brackets, as a heading, or as a name and a colon.
MARKER = re.compile(rf"^\s*(?:<\|(?:im_start\|>)?\s*(?P<a>{_any})\s*(?:\|>)?|\[(?P<b>{_any})\]\s*:?|#{{1,4}}\s*(?P<c>{_any})\s*:?(?=\s|$)|\*\*(?P<d>{_any}):?\*\*\s*:?|<(?P<e>{_any})>|(?P<f>{_any})\s*(?::|>{{1,2}})(?=\s|$))[ \t]*", re.I)
END = re.compile(r"\s*(?:<\|im_end\|>|<\|end\|>|<\|eot_id\|>|</s>|</(?:user|assistant|system|tool)>)\s*$", re.I)
ROLE_OF = {n: r for r, names in NAMES.items() for n in names.replace("s?", "").split("|")} | {"instructions": "system"}
S = 2 * len(ROLES)  # state 2 r opens a turn of role r, 2 r + 1 carries it on
QUESTION = re.compile(r"\?\s*$|^\s*(?:who|what|when|where|why|how|can|could|please|is|are|do|does|write|explain|tell)\b", re.I)
REPLY = re.compile(r"^\s*(?:sure|certainly|of course|here(?:'s| is| are)|i'm sorry|as an ai|yes|no|```|\d+\.)", re.I)
POLICY = re.compile(r"^\s*(?:you are|you're|act as|your task|always|never)\b", re.I)


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Log weights of the first state, and of one state after another."""
    first = np.full(S, -20.0)
    first[[0, 2, 4, 6]] = np.log([0.25, 0.6, 0.14, 0.01])
    turn = np.array([[0.02, 0.9, 0.06, 0.02], [0.02, 0.08, 0.88, 0.02], [0.02, 0.86, 0.06, 0.06], [0.01, 0.09, 0.88, 0.02]])
    t = np.full((S, S), -30.0)
    for r in range(len(ROLES)):
        for at in (2 * r, 2 * r + 1):
            t[at, 2 * r + 1] = np.log(0.7)
            for q in range(len(ROLES)):
                t[at, 2 * q] = np.log(0.3 * turn[r, q])
    return first, t


FIRST, NEXT = transitions()


def marker(line: str) -> tuple[str | None, str, bool]:
    """The role that a line's marker names, what follows the marker, and whether the marker is framed (not just a name and a colon)."""
    m = MARKER.match(line)
    if not m:
        return None, line, False
    name = next(v for v in m.groups() if v is not None).lower()
    return ROLE_OF.get(name), line[m.end() :], m["f"] is None


def emissions(lines: list[str]) -> np.ndarray:
    """Log weights of each line under each state."""
    out = np.zeros((len(lines), S))
    for i, line in enumerate(lines):
        role, rest, framed = marker(line)
        if role is None:
            out[i, ::2] = -7.0  # a turn that opens without a marker is rare
            blank = i and not lines[i - 1].strip()
            if blank:
                out[i, ::2] += 1.0
            for k, pattern in ((1, QUESTION), (2, REPLY), (0, POLICY)):
                if pattern.search(rest):
                    out[i, 2 * k] += 1.0
        else:
            k = ROLES.index(role)
            out[i, 1::2] = -9.0 if framed else -6.0  # a marker inside a turn is a quotation
            out[i, ::2] = -8.0
            out[i, 2 * k] = -0.1
    return out


def viterbi(e: np.ndarray) -> list[int]:
    """The likeliest path; of equals, the first state."""
    score, back = FIRST + e[0], []
    for row in e[1:]:
        all_ = score[:, None] + NEXT
        back.append(all_.argmax(0))
        score = all_.max(0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def parse(transcript: str | None) -> list[tuple[str, str]]:
    """(role, text) of each turn; none for a null or blank transcript. A role may follow itself."""
    if not transcript or not transcript.strip():
        return []
    lines = transcript.split("\n")
    turns: list[tuple[str, list[str]]] = []
    for state, line in zip(viterbi(emissions(lines)), lines):
        if state % 2 == 0 or not turns:
            role, rest, _ = marker(line)
            turns.append((ROLES[state // 2], [rest if role else line]))
        else:
            turns[-1][1].append(line)
    return [(r, END.sub("", "\n".join(ls)).strip()) for r, ls in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def format_transcripts(rows: DataFrame, key: list[str], text: str = "transcript") -> DataFrame:
    """Parse a transcript column: the key columns, n_turns, roles (comma-joined) and chat (the canonical rendering)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [parse(t) for t in f[text]]
            out = f[key].copy()
            out["n_turns"], out["roles"], out["chat"] = [len(g) for g in got], [",".join(r for r, _ in g) for g in got], [render(g) for g in got]
            yield out

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    return rows.select(*key, text).mapInPandas(run, f"{kinds}, n_turns long, roles string, chat string")


#: How the markers of a transcript are written; a conversation's style goes by its id.
STYLES = (("", ": "), ("### ", ":\n"), ("<|", "|>\n"), ("[", "] "), ("**", ":** "))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Write conversation rows as raw transcripts: (conv_id, n_rows, transcript), one for each conversation, whole.

    Rows are in order of turn, then role and text; a null turn counts as turn 0, a null text as empty, a null role as user. A row
    without a conv_id belongs to no other: it is a conversation of its own, so such rows never meet in one task. A conversation
    is one row of the result, as a text is; a task holds the ones it works on, one at a time beside the batch.
    """
    style = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(len(STYLES)))
    pick = lambda k: F.element_at(F.array(*(F.lit(s[k]) for s in STYLES)), (style + 1).cast("int"))
    line = F.concat(pick(0), F.initcap(F.coalesce("role", F.lit("user"))), pick(1), F.coalesce("text", F.lit("")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "role", "text")
    rows = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), line.alias("line")).alias("r"))
    g = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    g = g.unionByName(rows.filter("conv_id is null").select("conv_id", F.array("r").alias("r")))
    return g.select("conv_id", F.size("r").cast("long").alias("n_rows"), F.array_join(F.col("r")["line"], "\n").alias("transcript"))


def chats(conversations: DataFrame) -> DataFrame:
    """Conversations through their raw transcripts: (conv_id, n_rows, n_turns, roles, chat), one row each, by one Viterbi path."""
    return format_transcripts(transcripts(conversations), ["conv_id", "n_rows"])


ORACLE = """
select conv_id, count(*)::bigint as n_rows, count(*)::bigint as n_turns, string_agg(role, ',' order by turn, role, text) as roles,
  string_agg('<|im_start|>' || role || chr(10) || trim(text, chr(32) || chr(9) || chr(10) || chr(13)) || '<|im_end|>' || chr(10), '' order by turn, role, text) as chat
from conversations group by 1
"""
