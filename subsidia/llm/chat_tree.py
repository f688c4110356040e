"""Chat formatting with a prefix tree.

A node is a turn after a certain sequence of turns; conversations with equal first turns share its nodes. Nodes are
named by a digest of their path, so they are found by an aggregation and no tree is gathered in one task. The least
conversation through a node owns it. A conversation's nodes fall into runs of one owner, and the last run is what its
branch adds. Each node's text is emitted once, with the position of its first token, and with what its tokens attend
to besides themselves: runs of positions of the branches above. (tree, branches, depth) is the depth-first order.
Tokens are code points of the formatted text here; positions count from the root.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, materialise, tidy

#: The marks around a turn. Inside roles and texts a backslash precedes every "<", ">" and backslash, so
#: an unescaped "<" begins a mark and nothing in a text can look like one.
OPEN, SHUT, CLOSE = "<turn ", ">", "</turn>\n"
_ESCAPE = re.compile(r"[\\<>]")
_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)
LEARNT = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int | None, int | None]:
    """The formatted turn, and where in it the text to learn begins and ends (null unless the assistant speaks)."""
    head, body = f"{OPEN}{escape(role)}{SHUT}", escape(text)
    span = (len(head), len(head) + len(body)) if role == LEARNT else (None, None)
    return head + body + CLOSE, *span


def parse_turn(formatted: str) -> tuple[str, str]:
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError(f"not a formatted turn: {formatted[:80]!r}")
    return unescape(found[1]), unescape(found[2])


@tidy
def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names, positions and texts of the nodes of each conversation; rows come by conversation and turn."""
    names = ["conv_id", "depth", "node", "parent", "start", "n_tokens", "formatted", "loss_from", "loss_to"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now, depth, node, start = None, 0, None, 0
    for batch in batches:
        out: list[tuple] = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now:
                now, depth, node, start = conv, 0, None, 0
            formatted, *span = format_turn(role, text)
            own = hashlib.blake2b((node or b"") + formatted.encode(), digest_size=16).digest()
            out.append((conv, depth, own, node, start, len(formatted), formatted, *span))
            depth, node, start = depth + 1, own, start + len(formatted)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)


def chat_tree(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Formats turns(conv_id, turn, role, text): (nodes in depth-first order, paths).

    nodes: tree, branches, depth, node, parent, branch, start, n_tokens, formatted, loss_from, loss_to, attends; the
    position ids of a node are start .. start + n_tokens - 1, attends lists (branch, from, to) of positions, to
    excluded. paths: conv_id, depth, node. A null role or text is empty, a null turn comes first, rows of one turn come
    by role and text, repeated rows are turns of their own; rows with a null conv_id belong to no conversation. An empty
    table gives empty tables, and other columns are not looked at.
    """
    bounded_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id is not null")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    chain = materialise(ordered.mapInArrow(_chain, "conv_id long, depth int, node binary, parent binary, start long, n_tokens long, formatted string, loss_from long, loss_to long"), "chain")
    owners = materialise(chain.groupBy("node").agg(F.min("conv_id").alias("branch")), "owners")
    walked = chain.select("conv_id", "depth", "node", "start", "n_tokens").join(owners, "node")
    runs = walked.groupBy("conv_id", "branch").agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("n_tokens")).alias("hi"), F.min("depth").alias("top"))
    above = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "top", "branch"))).alias("runs"))
    nodes = chain.join(owners.withColumnRenamed("branch", "conv_id"), ["node", "conv_id"]).join(above, "conv_id")
    nodes = nodes.select(
        F.col("runs")[0]["branch"].alias("tree"),
        F.transform(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), lambda r: F.struct((-r["top"]).alias("leaves"), r["branch"].alias("branch"))).alias("branches"),
        "depth", "node", "parent", F.col("conv_id").alias("branch"), "start", "n_tokens", "formatted", "loss_from", "loss_to",
        F.transform(F.filter("runs", lambda r: r["lo"] < F.col("start")), lambda r: F.struct(r["branch"].alias("branch"), r["lo"].alias("from"), F.least(r["hi"], "start").alias("to"))).alias("attends"),
    )
    return nodes.orderBy("tree", "branches", "depth"), chain.select("conv_id", "depth", "node")


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the emitted nodes alone."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, turns, learnt, loss, size = None, 0, None, None, 0, 0
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["conv_id"] != now:
                    if now is not None:
                        out.append((now, n, turns.hexdigest(), loss, learnt.hexdigest(), size))
                    now, n, turns, learnt, loss, size = x["conv_id"], 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                if x["start"] != size or x["n_tokens"] != len(x["formatted"]):
                    raise ValueError(f"conversation {now}: position {x['start']} instead of {size}")
                role, text = parse_turn(x["formatted"])
                turns.update(f"{role}\n{text}\n".encode())
                if x["loss_from"] is not None:
                    part = unescape(x["formatted"][x["loss_from"] : x["loss_to"]])
                    learnt.update(part.encode())
                    loss += len(part)
                n, size = n + 1, size + x["n_tokens"]
            yield rows(out)
        if now is not None:
            yield rows([(now, n, turns.hexdigest(), loss, learnt.hexdigest(), size)])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    bounded_batches(nodes.sparkSession)
    read = paths.join(nodes.select("node", "start", "n_tokens", "formatted", "loss_from", "loss_to"), "node")
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "start", "n_tokens", "formatted", "loss_from", "loss_to")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_sql(extra: str = "") -> str:
    """DuckDB SQL of read_back() over the view conversations; extra: more rows, as UNION ALL SELECT conv_id, turn, role, text."""
    esc = lambda x: f"replace(replace(replace({x}, '\\', '\\\\'), '<', '\\<'), '>', '\\>')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations {extra}) WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
 coalesce(string_agg(CASE WHEN role = '{LEARNT}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS l,
 CAST(sum(length({esc('role')}) + length({esc('text')}) + {len(OPEN) + len(SHUT) + len(CLOSE)}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g"""
