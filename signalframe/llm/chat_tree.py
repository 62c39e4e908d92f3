r"""Chat formatting with a prefix tree.

Each turn is written as ``### role: text</turn>\n``; a backslash before ``\``, ``###`` and ``</turn>`` (and before ``:`` in a role) keeps
texts from looking like marks, and is taken away when reading. Conversations that begin with the same
turns share the nodes of these turns. The nodes of a tree are emitted once each, depth first, into one sequence
of code points; a node has its place in the sequence, position ids that go on from its parent's, and the
intervals of the sequence that its ancestors occupy, which are what its code points may attend to besides themselves.
The loss mask covers the escaped texts of the learned role. A conversation is read back from the sequence, which is laid out in
blocks: the intervals of its last node say which places, and text, positions and mask come from these places.

Depth-first order comes from sorting conversations by their paths of node hashes: a node belongs to the first conversation that
has it, and what a conversation adds follows what the ones before it added. Places are running totals over a range-partitioned
sort, so a tree of any size, even of a third of all conversations, is spread over tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.common import running_total, table
from signalframe.operators.windows import exact_rank
from signalframe.session import durable, ship_package

OPEN, CLOSE, LEARNED = "### ", "</turn>", "assistant"
#: Code points of a block of the emitted sequence.
BLOCK = 1024
_escaped = re.compile(r"\\|###|</turn>")
_escaped_role = re.compile(r"\\|###|</turn>|:")
_unescape = re.compile(r"\\(\\|###|</turn>|:)")
_marks = re.compile(r"\\(?:\\|###|</turn>|:)|### |: |</turn>")


def format_turn(role: str, text: str) -> str:
    return OPEN + _escaped_role.sub(r"\\\g<0>", role) + ": " + _escaped.sub(r"\\\g<0>", text) + CLOSE + "\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    turns: list[tuple[str, str]] = []
    begin, role = 0, None
    opened = False
    for mark in _marks.finditer(formatted):
        kind = mark[0]
        if kind[0] == "\\":
            continue
        if kind == OPEN and not opened:
            opened, role, begin = True, None, mark.end()
        elif kind == ": " and opened and role is None:
            role, begin = formatted[begin : mark.start()], mark.end()
        elif kind == CLOSE and opened:
            body = formatted[begin : mark.start()]
            turns.append((_unescape.sub(r"\1", role or ""), _unescape.sub(r"\1", body)))
            opened = False
    return turns


def conversation_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, tree (its first node), nodes (array of node, parent, depth, segment, length, position, loss, loss_from, loss_to)."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        ).alias("turn"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    node = pa.struct(
        [("node", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("segment", pa.string()), ("length", pa.int64()), ("position", pa.int64()), ("loss", pa.bool_()), ("loss_from", pa.int64()), ("loss_to", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, nodes = [], []
            for turns in batch.column(1).to_pylist():
                own, parent, position = [], "", 0
                for depth, t in enumerate(turns):
                    segment = format_turn(t["role"], t["text"])
                    name = hashlib.sha256(f"{parent}{segment}".encode()).hexdigest()[:32]
                    learned = t["role"] == LEARNED
                    begin, end = (len(OPEN) + len(LEARNED) + 2, len(segment) - len(CLOSE) - 1) if learned else (0, 0)
                    own.append({"node": name, "parent": parent, "depth": depth, "segment": segment, "length": len(segment), "position": position, "loss": learned, "loss_from": begin, "loss_to": end})
                    position += len(segment)
                    parent = name
                trees.append(own[0]["node"])
                nodes.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string()), pa.array(nodes, pa.list_(node))], names=["conv_id", "tree", "nodes"])

    kind = dict(turns.dtypes)[conv_col]
    fields = "node:string,parent:string,depth:int,segment:string,length:bigint,position:bigint,loss:boolean,loss_from:bigint,loss_to:bigint"
    return grouped.mapInArrow(run, f"conv_id {kind}, tree string, nodes array<struct<{fields}>>")


def prefix_tree(turns: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The emitted nodes, and the nodes of each conversation.

    Nodes: tree, node, parent, depth, segment, loss, owner (rank of the conversation that brings it), begin and end (place in the
    tree's sequence, in code points; order by begin to get the sequence), loss_from and loss_to (the places that the loss mask
    covers, none if equal), position (id of the first code point). Visits: conv_id, tree, rank, depth, node.

    Turns are ordered by turn, role and text; null roles and texts count as empty; repeated rows are repeated turns;
    conversations with a null id are one conversation. An empty table gives empty results. Other columns are not read.
    """
    ship_package(turns.sparkSession)
    convs = durable(conversation_paths(turns, **columns))
    narrow = convs.select("conv_id", "tree", F.transform("nodes", lambda n: n["node"]).alias("path"), F.transform("nodes", lambda n: n["position"] + n["length"]).alias("ends"))
    ranked = exact_rank(narrow, [F.col("path"), F.col("conv_id").asc_nulls_last()], ("tree",), "rank")
    # In the order of paths, what a conversation shares with any before it, it shares with the one before it.
    before = ranked.select("tree", (F.col("rank") + 1).alias("rank"), F.col("path").alias("_before"))
    same = F.zip_with("path", F.coalesce("_before", F.array().cast("array<string>")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")
    told = ranked.join(before, ["tree", "rank"], "left").withColumn("shared", shared)
    told = told.withColumn("_skip", F.coalesce(F.get("ends", F.col("shared") - 1), F.lit(0))).select(
        "conv_id", "tree", "rank", "shared", "_skip", (F.element_at("ends", -1) - F.col("_skip")).alias("_new")
    )
    places = durable(running_total(told, ("tree",), [F.col("rank")], "_new", "_to").drop("tree"))
    placed = convs.alias("c").join(places.alias("p"), F.col("c.conv_id").eqNullSafe(F.col("p.conv_id"))).drop(F.col("p.conv_id"))
    nodes = placed.select("tree", "rank", "_to", "_new", "_skip", F.explode(F.slice("nodes", F.col("shared") + 1, F.size("nodes"))).alias("n"))
    begin = F.col("_to") - F.col("_new") - F.col("_skip") + F.col("n.position")
    mask = {c: begin + F.col(f"n.{c}") for c in ("loss_from", "loss_to")}
    nodes = nodes.select("tree", "n.*", F.col("rank").alias("owner"), begin.alias("begin"), (begin + F.col("n.length")).alias("end"), F.struct(*[v.alias(c) for c, v in mask.items()]).alias("_mask"))
    nodes = nodes.drop("length", "loss_from", "loss_to").select("*", "_mask.*").drop("_mask")
    visits = placed.select("conv_id", "tree", "rank", F.explode(F.transform("nodes", lambda n: F.struct(n["depth"].alias("depth"), n["node"].alias("node")))).alias("n"))
    return nodes, visits.select("conv_id", "tree", "rank", "n.*")


def attention(nodes: DataFrame, visits: DataFrame) -> DataFrame:
    """node, ancestors, begin, end: the merged intervals [begin, end) of the tree's sequence before each node on its path, and its own place."""
    found = visits.join(nodes.select("node", "owner", "begin", "end"), "node")
    places = found.groupBy("conv_id", "tree", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "begin", "end", "owner"))).alias("path"))
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, spans, begins, ends = [], [], [], []
            for rank, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: list[dict] = []
                for n in path:
                    if n["owner"] == rank:
                        names.append(n["node"])
                        spans.append([dict(x) for x in own])
                        begins.append(n["begin"])
                        ends.append(n["end"])
                    if own and own[-1]["end"] == n["begin"]:
                        own[-1]["end"] = n["end"]
                    else:
                        own.append({"begin": n["begin"], "end": n["end"]})
            columns = [pa.array(names, pa.string()), pa.array(spans, kind), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "ancestors", "begin", "end"])

    return places.select("rank", "path").mapInArrow(run, "node string, ancestors array<struct<begin:bigint,end:bigint>>, begin long, end long")


def sequence_blocks(nodes: DataFrame) -> DataFrame:
    """The emitted sequence, BLOCK code points in a row: tree, block, pieces (at, text, position, loss_from, loss_to).

    A node that reaches over several blocks is cut; no group is longer than a block, whatever the size of a tree.
    """
    blocks = F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    cut = nodes.filter(F.col("end") > F.col("begin")).withColumn("block", F.explode(blocks))
    at = F.greatest(F.col("begin"), F.col("block") * BLOCK)
    to = F.least(F.col("end"), (F.col("block") + 1) * BLOCK)
    piece = F.struct(
        at.alias("at"),
        F.substring("segment", (at - F.col("begin") + 1).cast("int"), (to - at).cast("int")).alias("text"),
        (F.col("position") + at - F.col("begin")).alias("position"),
        "loss_from",
        "loss_to",
    )
    return cut.select("tree", "block", piece.alias("piece")).groupBy("tree", "block").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))


def read_back(nodes: DataFrame, visits: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_text, attended, last_position, in_order: each conversation as its last node's intervals have it.

    ``formatted`` is the text at the places of the intervals and of the node itself, ``loss_text`` the part of it under the loss mask,
    still escaped; ``attended`` counts the code points of the ancestors' intervals; ``in_order`` tells whether the
    position ids found there are 0, 1, 2 and so on, ``last_position`` is the last of them.
    """
    last = visits.groupBy("conv_id", "tree").agg(F.max_by("node", "depth").alias("node"))
    own = last.join(attention(nodes, visits), "node")
    spans = F.concat("ancestors", F.array(F.struct("begin", "end")))
    length = F.aggregate("ancestors", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    wanted = own.select("conv_id", "tree", length.alias("attended"), F.inline(spans))
    blocks = F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    wanted = wanted.withColumn("block", F.explode(blocks)).select(
        "conv_id", "tree", "attended", "block",
        F.greatest(F.col("begin"), F.col("block") * BLOCK).alias("_from"),
        F.least(F.col("end"), (F.col("block") + 1) * BLOCK).alias("_to"),
    )
    # Of each block only what was asked for goes on.
    size = lambda p: F.char_length(p["text"])
    skipped = lambda p: F.greatest(F.col("_from") - p["at"], F.lit(0).cast("long"))
    pieces = F.transform(
        F.filter("pieces", lambda p: (p["at"] < F.col("_to")) & (p["at"] + size(p) > F.col("_from"))),
        lambda p: F.struct(
            (p["at"] + skipped(p)).alias("at"),
            F.substring(p["text"], (skipped(p) + 1).cast("int"), (F.least(p["at"] + size(p), F.col("_to")) - p["at"] - skipped(p)).cast("int")).alias("text"),
            (p["position"] + skipped(p)).alias("position"),
            p["loss_from"].alias("loss_from"),
            p["loss_to"].alias("loss_to"),
        ),
    )
    found = wanted.join(sequence_blocks(nodes), ["tree", "block"]).select("conv_id", "tree", "attended", "block", "_from", pieces.alias("pieces"))
    grouped = found.groupBy("conv_id", "tree").agg(F.max("attended").alias("attended"), F.sort_array(F.collect_list(F.struct("_from", "pieces"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, losses, lasts, orders = [], [], [], []
            for parts in batch.column(1).to_pylist():
                text, loss, position, in_order = [], [], 0, True
                for piece in (p for part in parts for p in part["pieces"]):
                    at, said = piece["at"], piece["text"]
                    text.append(said)
                    loss.append(said[max(piece["loss_from"] - at, 0) : max(piece["loss_to"] - at, 0)])
                    in_order = in_order and piece["position"] == position
                    position = piece["position"] + len(said)
                texts.append("".join(text))
                losses.append("".join(loss))
                lasts.append(position - 1)
                orders.append(in_order)
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(losses, pa.string()), batch.column(2), pa.array(lasts, pa.int64()), pa.array(orders, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "loss_text", "attended", "last_position", "in_order"])

    kind = dict(visits.dtypes)["conv_id"]
    return grouped.select("conv_id", "parts", "attended").mapInArrow(
        run, f"conv_id {kind}, formatted string, loss_text string, attended long, last_position long, in_order boolean"
    )


def op3_chat_tree(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.sql(
        r"""select cast(-7 as bigint) as conv_id, cast(n as bigint) as turn, if(n = 0, 'user', 'assistant') as role,
                   r'\### Assistant: </turn> ok' as text from values (0), (1) as t(n)"""
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    found = read_back(*prefix_tree(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, escaped in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                loss = _unescape.sub(r"\1", escaped)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = [pa.array([r[i] for r in out], pa.string() if i in (1, 3) else pa.int64()) for i in range(5)]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attended_chars", "last_position", "in_order"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[3:]], names=names)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attended_chars long, last_position long, in_order boolean"
    return found.mapInArrow(run, kinds)


OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e as (
  select *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))
            + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) + 14 as n
  from t
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(n) as bigint) as formatted_chars, cast(sum(n) - arg_max(n, (turn, role, text)) as bigint) as attended_chars,
       cast(sum(n) - 1 as bigint) as last_position, true as in_order
from e group by conv_id
"""
