"""Chat formatting as prefix trees.

The template marks turns with control strings. Inside texts every ``\\``,
``<`` and ``[`` gets a backslash behind it, so no control string can occur
there, and dropping those backslashes gives the text back.

Conversations that begin with the same turns share tree nodes. A tree is
emitted once, depth first, as one sequence: each node has its span in the
sequence, the position of its first token on the path from the root, and the
spans of its ancestors, which it attends to besides its own earlier tokens.
Tokens are code points here.

Equal conversations are one leaf. Trees are built in blocks of about ``limit``
conversations. A node that more than ``limit`` conversations share is a stem: it
is emitted once, as a sequence of its own, and what grows from it below that
size stands in sequences that name the stems of their path. Those are attended
to whole, so no shared token is repeated however many conversations begin alike.
"""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import written

LIMIT = 512
#: Stems (16 + 16 bytes and a flag each) that a join may broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000
BEGIN = "<s>"
# role -> marks before and after a turn's text
MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("<<ROLE ", ">> ", " <</ROLE>>")
_ESCAPED = str.maketrans({c: c + "\\" for c in "\\<["})


def escape(text: str) -> str:
    return text.translate(_ESCAPED)


def unescape(text: str) -> str:
    out, i = [], 0
    while (j := min((k for k in (text.find(c, i) for c in "\\<[") if k >= 0), default=-1)) >= 0:
        if text[j + 1:j + 2] != "\\":
            raise ValueError(f"a bare {text[j]!r} at {j}")
        out.append(text[i:j + 1])
        i = j + 2
    return "".join(out) + text[i:]


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted, start and end of the escaped text in it)."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Formatted conversation -> (role, text) turns."""
    if not formatted.startswith(BEGIN):
        raise ValueError("no begin mark")
    at, turns = len(BEGIN), []
    while at < len(formatted):
        role = next((r for r, (b, _) in MARKS.items() if formatted.startswith(b, at)), None)
        if role is None:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn at {at}")
            end = formatted.index(OTHER[1], at + len(OTHER[0]))
            role, at, after = unescape(formatted[at + len(OTHER[0]):end]), end + len(OTHER[1]), OTHER[2]
        else:
            at, after = at + len(MARKS[role][0]), MARKS[role][1]
        # an escaped text has no bare bracket, so the first closing mark is the turn's own;
        # blanks before it may belong to the text
        mark = formatted.index(after.lstrip(), at)
        end = mark - (len(after) - len(after.lstrip()))
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(after)
    return turns


def _chain(turns):
    """Digest of each prefix of a conversation."""
    out, last = [], b""
    for t in turns:
        h = hashlib.blake2b(last, digest_size=16)
        for part in (t["role"].encode(), t["text"].encode()):
            h.update(len(part).to_bytes(8, "little"))
            h.update(part)
        last = h.digest()
        out.append(last)
    return out


def _digests():
    schema = pa.schema([("conv_id", pa.int64()), ("leaf", pa.binary()), ("path", pa.list_(pa.binary())),
                        ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                turns = some.column(1).to_pylist()
                chains = [_chain(t) for t in turns]
                yield pa.record_batch([some.column(0), pa.array([c[-1] for c in chains], pa.binary()),
                                       pa.array(chains, pa.list_(pa.binary())),
                                       pa.array(turns, schema.field("turns").type)], schema=schema)
    return run


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, leaf, path, turns: one row per conversation, turns by (turn,
    role, text), the digest of every prefix and of the whole. Null roles and
    texts are empty; rows with a null conv_id are one conversation, made in one
    task like any other; repeated rows are repeated turns. Texts may be of any
    length. An empty table gives no rows; other columns are not read."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.expr("transform(sort_array(collect_list(t)), "
                                                "t -> struct(t.role as role, t.text as text))").alias("turns"))
    return whole.mapInArrow(_digests(), "conv_id long, leaf binary, path array<binary>, "
                                        "turns array<struct<role:string,text:string>>")


_NODES = pa.schema([
    ("block", pa.int64()), ("tree", pa.int64()), ("seq", pa.binary()), ("stems", pa.list_(pa.binary())),
    ("shared", pa.bool_()), ("node", pa.int32()), ("parent", pa.int32()), ("role", pa.string()),
    ("text", pa.string()), ("seq_start", pa.int64()), ("seq_end", pa.int64()), ("position_start", pa.int64()),
    ("ancestors", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("leaf", pa.binary())])
_NODES_SQL = ("block long, tree long, seq binary, stems array<binary>, shared boolean, node int, parent int, role string, "
              "text string, seq_start long, seq_end long, position_start long, ancestors array<struct<start:long,end:long>>, "
              "loss_start long, loss_end long, leaf binary")


def _node_text(turn, first: bool) -> tuple[str, int, int]:
    formatted, a, b = format_turn(turn["role"], turn["text"])
    return (BEGIN + formatted, a + len(BEGIN), b + len(BEGIN)) if first else (formatted, a, b)


def _trees(key, table):
    """Conversations of one block -> stems that are theirs to emit, and the
    nodes below stems, depth first, children in order of their digests, so
    that a retried task emits the same trees."""
    block = key[0].as_py()
    tree_of = lambda root: int.from_bytes(root[:8], "little", signed=True)
    rows, leaves, out = {}, {}, []
    children: dict[bytes, set] = {}
    tops: dict[bytes, tuple[list, int, set]] = {}  # last stem -> stems, their tokens, first nodes below

    def emit(seq, stems, shared, node, parent, d, at, position, above, leaf):
        turn = rows[d]
        formatted, a, b = _node_text(turn, not stems and parent < 0)
        loss = turn["role"] == "assistant"
        out.append((block, tree_of(stems[0] if stems else seq), seq, stems, shared, node, parent, turn["role"], formatted,
                    at, at + len(formatted), position, above, at + a if loss else None, at + b if loss else None, leaf))
        return at + len(formatted)

    for r in table.to_pylist():
        chain, turns, depth = _chain(r["turns"]), r["turns"], r["depth"]
        rows |= zip(chain, turns)
        starts = [0]
        for i in range(depth):
            starts.append(starts[-1] + len(_node_text(turns[i], i == 0)[0]))
        for stem in r["stems"] or ():
            i = stem["at"]
            emit(chain[i], chain[:i], True, 0, -1, chain[i], 0, starts[i], [], chain[i] if stem["ends"] else None)
        if depth < len(turns):
            top = chain[depth - 1] if depth else b""
            tops.setdefault(top, (chain[:depth], starts[depth], set()))[2].add(chain[depth])
            for parent, d in zip(chain[depth:], chain[depth + 1:]):
                children.setdefault(parent, set()).add(d)
            leaves[chain[-1]] = r["leaf"]
    for top in sorted(tops):
        stems, base, firsts = tops[top]
        # a root has a sequence of its own; the block's branches of one stem share one
        for group in ([sorted(firsts)] if stems else [[d] for d in sorted(firsts)]):
            seq = top + block.to_bytes(8, "little", signed=True) if stems else group[0]
            at, node = 0, 0
            stack = [(d, -1, base, []) for d in reversed(group)]
            while stack:
                d, parent, position, above = stack.pop()
                end = emit(seq, stems, False, node, parent, d, at, position, above, leaves.get(d))
                if above and above[-1]["end"] == at:  # a first child follows its parent: one span
                    path = above[:-1] + [{"start": above[-1]["start"], "end": end}]
                else:
                    path = above + [{"start": at, "end": end}]
                for child in sorted(children.get(d, ()), reverse=True):
                    stack.append((child, node, position + end - at, path))
                at, node = end, node + 1
    columns = zip(*out) if out else [[]] * len(_NODES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _NODES.types)], schema=_NODES)


def prefix_trees(convs: DataFrame, limit: int = LIMIT, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Nodes of the trees over the distinct conversations of ``convs`` (as
    ``conversation_turns`` gives them): block, tree, seq, stems, shared, node,
    parent, role, text (formatted), seq_start, seq_end, position_start,
    ancestors, loss_start, loss_end, and leaf where a conversation ends.

    ``seq`` names a sequence, ``stems`` the sequences that all its nodes attend
    to whole, from the root on; ``shared`` marks a stem. Spans count within the
    sequence, positions from the root. Every node is emitted once. Neighbouring
    ancestor spans are merged, so a conversation that shares nothing has one
    span per node. An empty table gives no nodes.
    """
    kinds = written(convs.select("leaf", "path", "turns").dropDuplicates(["leaf"]), "conversations")
    blocks = 1 + kinds.count() // limit
    prefixes = kinds.select("leaf", F.size("path").alias("n"), F.posexplode("path").alias("at", "digest"))
    stems = written(prefixes.groupBy("digest")
                    .agg(F.count("*").alias("convs"), F.min("leaf").alias("emitter"),
                         F.max((F.col("at") == F.col("n") - 1).cast("int")).alias("ends"))
                    .filter(F.col("convs") > limit).select("digest", "emitter", F.col("ends").cast("boolean")), "stems")
    few = stems.count() <= max_broadcast
    # conversations below a node are no more than those of its parent, so the stems of a path are its first turns
    depths = (prefixes.join(F.broadcast(stems) if few else stems, "digest").groupBy("leaf")
              .agg(F.count("*").alias("depth"),
                   F.collect_list(F.when(F.col("emitter") == F.col("leaf"), F.struct("at", "ends"))).alias("stems")))
    cut = F.element_at("path", F.least(F.col("depth") + 1, F.size("path")).cast("int"))
    return (kinds.join(depths, "leaf", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
            .select(F.pmod(F.xxhash64(cut), F.lit(blocks)).cast("long").alias("block"), "leaf", "turns", "depth", "stems")
            .groupBy("block").applyInArrow(_trees, _NODES_SQL))


def _read(key, table):
    """Each conversation again from the emitted sequences, by its spans."""
    rows = {(r["seq"], r["seq_start"]): r for r in table.to_pylist()}
    texts, losses = {}, {}
    for (seq, _), r in sorted(rows.items(), key=lambda x: x[0]):
        texts.setdefault(seq, []).append(r["text"])
        if r["loss_start"] is not None:
            losses.setdefault(seq, []).append((r["loss_start"], r["loss_end"]))
    texts = {k: "".join(v) for k, v in texts.items()}
    out = []
    for r in table.to_pylist():
        if r["leaf"] is None:
            continue
        spans = [(s, 0, len(texts[s])) for s in r["stems"]]
        spans += [(r["seq"], s["start"], s["end"]) for s in r["ancestors"]] + [(r["seq"], r["seq_start"], r["seq_end"])]
        formatted = "".join(texts[s][a:b] for s, a, b in spans)
        turns = parse(formatted)
        learned = []
        for s, a, b in spans:
            marked = losses.get(s, [])
            learned += [unescape(texts[s][x:y]) for x, y in
                        marked[bisect.bisect_left(marked, (a, 0)):bisect.bisect_left(marked, (b, 0))]]
        learned = "".join(learned)
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        out.append((r["leaf"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned),
                    hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
    schema = pa.schema([("leaf", pa.binary()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, schema.types)], schema=schema)


def read_back(nodes: DataFrame) -> DataFrame:
    """leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of
    every conversation, from the emitted sequences alone. A block reads each
    stem that its conversations begin with once. No nodes give no rows."""
    columns = ("seq", "seq_start", "seq_end", "text", "ancestors", "stems", "loss_start", "loss_end")
    begun = nodes.filter("leaf is not null").select("block", F.explode("stems").alias("seq")).distinct()
    lent = begun.join(nodes.filter("shared").select(*columns), "seq").withColumn("leaf", F.lit(None).cast("binary"))
    return (nodes.select("block", "leaf", *columns).unionByName(lent).groupBy("block")
            .applyInArrow(_read, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long"))
