"""Roles in chat transcripts by a hidden Markov model, and canonical rendering.

A transcript is lines of text in order; nothing but the lines says where turns begin or who speaks. Hidden states are
(role, begins a turn or goes on). What is seen of a line is its speaker marker ("User:", "[assistant]", "<|system|>" and the
like, or none), whether a blank line stands before it, whether it ends in a question mark, and its length class. Start,
transition and emission probabilities come from grouped counts over labelled lines; only those counts, a few hundred numbers
whatever the tables, reach the driver. Viterbi recovers the states, and turns are rendered from them.

A conversation of any length is spread over tasks. Lines are dealt by ranges of (conversation, place) and cut into blocks of
`block` lines; each block's (max, +) matrix from entering to leaving state is computed on its own, the matrices of a
conversation are chained, which gives each block its best entering and leaving states, and blocks then trace their own path.
Many blocks are worked on at once, in arrays. The result is that of one pass over the whole conversation. Scores are exact
sums, with a nudge below 1e-4 by line and state, which decides between paths that would tie. Only the finished rendering of a
conversation is put together in one row, as long as its text is.

Defined results: a null text is an empty piece. Blank lines are no lines: one or several before a line that goes on with a
turn are rendered as one, those before a turn are dropped. Rows with a null conv_id form one conversation; a null turn comes
first; rows of one turn number are ordered by the hash of their text, so that ties are equal texts. Repeated rows are lines of
their own. A very long turn is many lines, cut into blocks like others. Roles outside ROLES are no labels. A conversation
without lines gives no row, an empty table none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize, read_table
from corpusflow.llm.wordhash import mix

# Speaker words by role.
ROLES = ("user", "assistant", "system")
SPEAKERS = {
    "user": "user human you q question customer client me prompt instruction",
    "assistant": "assistant ai bot a answer model response agent chatbot gpt",
    "system": "system sys context instructions note",
}
_BY_WORD = {w: r for r, words in SPEAKERS.items() for w in words.split()}
MARKER = re.compile(r"\s*(?:<\|([A-Za-z]{1,12})\|>|\[([A-Za-z]{1,12})\]:?|(?:#{1,4}\s*|\*{1,2}|>\s*)?([A-Za-z]{1,12})(?:\*{1,2})?\s*[:：](?:\*{1,2})?)\s*")
STATES = [(r, b) for r in range(len(ROLES)) for b in (1, 0)]
N = len(STATES)
LENGTHS = (4, 12, 40, 120)
#: Values of each feature: marker (none, or a role's), blank line before, question, length class.
SIZES = (1 + len(ROLES), 2, 2, 1 + len(LENGTHS))
NO_ID = -(2**62)
KEYS = ["conv", "part", "block"]


@dataclass(frozen=True)
class Chat:
    block: int = 256
    mix: float = 0.02


def strip_marker(line: str) -> tuple[str, int]:
    """The line without its speaker marker, and the marker's class: 0 none, 1.. the role it names."""
    m = MARKER.match(line)
    role = m and _BY_WORD.get((m[1] or m[2] or m[3]).lower())
    return (line[m.end() :], 1 + ROLES.index(role)) if role else (line, 0)


def seen(line: str, after_blank: bool) -> int:
    """The features of a line as one number."""
    body, marker = strip_marker(line)
    n = len(body.split())
    out = 0
    for size, value in zip(SIZES, (marker, int(after_blank), int(body.rstrip().endswith("?")), sum(n > x for x in LENGTHS))):
        out = out * size + value
    return out


@dataclass
class Model:
    """Log probabilities: start, move (state to state), see (state, by features as one number)."""

    start: np.ndarray
    move: np.ndarray
    see: np.ndarray


def fit(moves: list[tuple], views: list[tuple], p: Chat) -> Model:
    """moves: (state before or -1, state, count); views: (state, features, count).

    Every distribution is mixed with a uniform one, so what no state has shown counts the same against each. A marker names
    its speaker nearly always, also where the labelled lines have few markers or none.
    """
    start, move, see = np.zeros(N), np.zeros((N, N)), [np.zeros((N, k)) for k in SIZES]
    for before, state, n in moves:
        if before < 0:
            start[state] += n
        else:
            move[before, state] += n
    for state, code, n in views:
        for table, value in zip(see, np.unravel_index(code, SIZES)):
            table[state, value] += n

    def mixed(x: np.ndarray) -> np.ndarray:
        total, k = x.sum(axis=-1, keepdims=True), x.shape[-1]
        return (1 - p.mix) * np.where(total > 0, x / np.maximum(total, 1), 1 / k) + p.mix / k

    start, move, see = mixed(start), mixed(move), [mixed(t) for t in see]
    for s, (role, begins) in enumerate(STATES):
        own = np.full(SIZES[0], 0.02)
        own[0], own[1 + role] = 0.0, 1 - 0.02 * (len(ROLES) - 1)
        see[0][s] = 0.9 * see[0][s] + 0.1 * own if begins else np.where(np.arange(SIZES[0]) == 0, see[0][s], np.minimum(see[0][s], 1e-3))
        if not begins:
            start[s] = 1e-9
            for t, (other, _) in enumerate(STATES):
                if other != role:
                    move[t, s] = 1e-9  # only its own role goes on
    # multiples of 2^-24, so that sums are exact and their order does not matter
    norm = lambda x: np.round(np.log(x / x.sum(axis=-1, keepdims=True)) * 2**24) / 2**24
    tables, code = [norm(t) for t in see], np.array(np.unravel_index(np.arange(np.prod(SIZES)), SIZES))
    return Model(norm(start), norm(move), sum(t[:, code[i]] for i, t in enumerate(tables)))


def pieces(turns: DataFrame, text: Column | None = None) -> DataFrame:
    """Pieces of transcripts from turns (conv_id, turn, text[, role]): conv, turn, tie, role, lines (array).

    text: what stands in the transcript instead of the turn's text.
    """
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.col("role").cast("string") if "role" in turns.columns else F.lit(None).cast("string")
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"),
        F.xxhash64(own).alias("tie"), role.alias("role"), F.split(own if text is None else text, "\n").alias("lines"),
    )


def plain_transcript(turns: DataFrame) -> DataFrame:
    """Pieces of plain transcripts of labelled turns, as people write them: a conversation keeps to one style of speaker marker
    or has a blank line between turns, or both, and one turn in five has no marker. The pieces' edges say nothing."""
    style, bare = F.pmod(F.xxhash64(F.col("conv_id")), F.lit(6)), F.pmod(F.xxhash64(F.col("conv_id"), F.col("turn"), F.lit(1)), F.lit(5)) == 0
    role = F.coalesce(F.col("role").cast("string"), F.lit("note"))
    name = F.when(style % 2 == 0, role).otherwise(F.when(role == "user", "human").when(role == "assistant", "ai").otherwise(role))
    marker = F.when(style == 0, F.concat(F.initcap(name), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), F.initcap(name), F.lit(": "))).when(style == 2, F.concat(F.lit("["), name, F.lit("] ")))
    marker = marker.when(style == 3, F.concat(F.upper(name), F.lit(": "))).when(style == 4, F.concat(F.lit("<|"), name, F.lit("|> "))).otherwise(F.concat(F.lit("**"), F.initcap(name), F.lit(":** ")))
    gap = F.when(F.pmod(F.xxhash64(F.col("conv_id"), F.lit(2)), F.lit(2)) == 0, F.lit("\n")).otherwise(F.lit(""))
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return pieces(turns, F.concat(gap, F.when(bare, F.lit("")).otherwise(marker), own))


def numbered_lines(of: DataFrame, p: Chat) -> DataFrame:
    """Lines that are not blank, in order: conv, part, block, idx, line, blank (one before it), seen, state (of the label, or
    -1), before (state of the line before; -1 at the start of a conversation, -2 unknown), given. A piece of a labelled transcript begins a turn.

    Lines are dealt by ranges, so a part holds a stretch of one or more conversations, in order, and a conversation's parts
    ascend.
    """
    spark = of.sparkSession
    solid = lambda x: F.trim(x) != ""
    each = F.transform("lines", lambda x, i: F.struct(x.alias("line"), (~solid(F.coalesce(F.get("lines", i - 1), F.lit("x")))).alias("blank")))
    lines = of.withColumn("head", F.array_position(F.transform("lines", solid), True) - 1)  # of a piece's lines the first that is not blank
    lines = lines.select("conv", "turn", "tie", "head", "role", F.posexplode(each).alias("pos", "x"))
    lines = lines.select("conv", "turn", "tie", "pos", (F.col("pos") == F.col("head")).alias("begins"), "role", "x.line", "x.blank").where(solid(F.col("line")))
    parts = max(spark.sparkContext.defaultParallelism, of.rdd.getNumPartitions())
    order = ["conv", "turn", "tie", "pos"]
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    role_of = {r: i for i, r in enumerate(ROLES)}

    def number(batches):
        part, last, idx, before = TaskContext.get().partitionId(), None, 0, -2
        for batch in batches:
            conv, begins, role, lines, blank = (batch.column(i).to_pylist() for i in (0, 4, 5, 6, 7))
            out = [[], [], [], []]
            for c, begun, r in zip(conv, begins, role):
                if c != last:
                    before, idx = -1 if last is not None else -2, 0
                    last = c
                state = 2 * role_of[r] + (0 if begun else 1) if r in role_of else -1
                for column, value in zip(out, (idx // p.block, idx, state, before)):
                    column.append(value)
                idx, before = idx + 1, state if state >= 0 else -2
            codes = [seen(x, b) for x, b in zip(lines, blank)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(conv), pa.int32()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), batch.column(6), batch.column(7), pa.array(codes, pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), batch.column(5)],
                _LINES,
            )

    return materialize(dealt.mapInArrow(number, "conv long, part int, block long, idx long, line string, blank boolean, seen int, state int, before int, given string"), "chat-lines")


_LINES = ["conv", "part", "block", "idx", "line", "blank", "seen", "state", "before", "given"]


def _fold() -> Column:
    return F.pmod(F.xxhash64("conv", F.lit(7)), F.lit(2)).cast("int")


def fitted(lines: DataFrame, p: Chat, halves: bool) -> list[Model]:
    """One model for each hash half of the conversations, fitted on the labelled lines of the other half; or both the same."""
    known = lines.where("state >= 0").withColumn("fold", _fold() if halves else F.lit(0))
    moves = known.where("before >= -1").groupBy("fold", "before", "state").count().collect()  # a row a pair of states
    views = known.groupBy("fold", "state", "seen").count().collect()  # a row a state and kind of line
    of = lambda rows, fold: [tuple(r)[1:] for r in rows if not halves or r["fold"] != fold]
    return [fit(of(moves, fold), of(views, fold), p) for fold in (0, 1)]


def _blockwise(work):
    """A mapInArrow function: work(table) for stretches of whole blocks; rows come sorted by block."""

    def run(batches):
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([kept, table]) if kept is not None else table).combine_chunks()
            if not table.num_rows:
                continue
            key = [table.column(c).to_numpy() for c in KEYS]
            same = np.ones(table.num_rows, bool)
            for k in key:
                same &= k == k[-1]
            cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from work(table.slice(0, cut)).to_batches()
            kept = table.slice(cut)
        if kept is not None and kept.num_rows:
            yield from work(kept).to_batches()

    return run


def _edges(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in KEYS:
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], table.num_rows)


def _scores(table: pa.Table, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Emission scores of lines, and the fold of each."""
    fold, code = table.column("fold").to_numpy(), table.column("seen").to_numpy()
    see = np.stack([m.see.T for m in models])
    place = table.column("idx").to_numpy().astype(np.uint64) * np.uint64(N) + (table.column("part").to_numpy().astype(np.uint64) << np.uint64(40))
    nudge = mix(place[:, None] + np.arange(N, dtype=np.uint64)) % np.uint64(1024)
    return see[fold, code] + nudge / 2**24, fold


def block_matrices(table: pa.Table, models: list[Model]) -> pa.Table:
    """Of each block: scores from the state before it to its last one, and those where it opens a conversation."""
    scores, fold = _scores(table, models)
    begin, end = _edges(table)
    move, start = np.stack([m.move for m in models])[fold[begin]], np.stack([m.start for m in models])[fold[begin]]
    m = np.concatenate([move, start[:, None, :]], axis=1) + scores[begin][:, None, :]  # the last row: it opens
    for t in range(1, int((end - begin).max())):
        on = np.flatnonzero(end - begin > t)
        m[on] = (m[on][:, :, :, None] + move[on][:, None, :, :]).max(axis=2) + scores[begin[on] + t][:, None, :]
    keys = {c: table.column(c).take(pa.array(begin)) for c in KEYS}
    return pa.table(keys | {"matrix": pa.array(list(m.reshape(len(m), -1)), pa.list_(pa.float64()))})


def chained(table: pa.Table) -> pa.Table:
    """Entering and leaving state of each block on the best path; matrices of whole conversations, in order."""
    conv = table.column("conv").to_numpy()
    m = table.column("matrix").combine_chunks().flatten().to_numpy().reshape(-1, N + 1, N)
    entering, leaving = np.zeros(len(conv), np.int32), np.zeros(len(conv), np.int32)
    cut = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    ends = np.append(cut[1:], len(conv))
    final = np.zeros(len(conv), bool)
    final[ends - 1] = True
    alone = cut[ends - cut == 1]
    entering[alone], leaving[alone] = -1, m[alone, N].argmax(axis=1)
    for a, z in zip(cut, ends):
        if z - a == 1:
            continue
        score, back = m[a, N], np.zeros((z - a, N), np.int32)
        for i in range(a + 1, z):
            every = score[:, None] + m[i, :N]
            back[i - a], score = every.argmax(axis=0), every.max(axis=0)
        state = int(score.argmax())
        for i in range(z - 1, a - 1, -1):
            leaving[i] = state
            state = int(back[i - a][state]) if i > a else -1
            entering[i] = state
    return pa.table({c: table.column(c) for c in KEYS} | {"entering": pa.array(entering), "leaving": pa.array(leaving), "final": pa.array(final)})


def _whole(work):
    """As _blockwise, for stretches of whole conversations."""

    def run(batches):
        kept: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            conv = table.column("conv").to_numpy()
            cut = int(np.searchsorted(conv, conv[-1])) if (np.diff(conv) >= 0).all() else int(np.flatnonzero(np.diff(conv))[-1]) + 1
            if kept and (cut or kept[-1].column("conv")[-1].as_py() != conv[0]):
                yield from work(pa.concat_tables([*kept, table.slice(0, cut)]).combine_chunks()).to_batches()
                kept = []
            elif cut:
                yield from work(table.slice(0, cut).combine_chunks()).to_batches()
            kept.append(table.slice(cut))
        if kept:
            yield from work(pa.concat_tables(kept).combine_chunks()).to_batches()

    return run


def traced(table: pa.Table, models: list[Model], entering: np.ndarray, leaving: np.ndarray) -> np.ndarray:
    """The state of each line, from the states before and at the end of its block."""
    scores, fold = _scores(table, models)
    begin, end = _edges(table)
    move, start = np.stack([m.move for m in models])[fold[begin]], np.stack([m.start for m in models])[fold[begin]]
    score = np.where((entering < 0)[:, None], start, move[np.arange(len(begin)), np.maximum(entering, 0)]) + scores[begin]
    back, longest = np.zeros((table.num_rows, N), np.int32), int((end - begin).max())
    for t in range(1, longest):
        on = np.flatnonzero(end - begin > t)
        every = score[on][:, :, None] + move[on]
        back[begin[on] + t], score[on] = every.argmax(axis=1), every.max(axis=1) + scores[begin[on] + t]
    states, at = np.zeros(table.num_rows, np.int32), leaving.astype(np.int32)
    for t in range(longest - 1, -1, -1):
        on = np.flatnonzero(end - begin > t)
        states[begin[on] + t] = at[on]
        at[on] = back[begin[on] + t, at[on]]
    return states


def recovered(lines: DataFrame, models: list[Model]) -> DataFrame:
    """Blocks with their path and rendering: conv_id, part, block, states (array), n_turns, n_lines, n_agreeing, rendered.

    A conversation's rendering is that of its blocks in order, joined by line feeds.
    """
    spark = lines.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, lines.rdd.getNumPartitions())
    lines = lines.withColumn("fold", _fold())
    by_block = lines.select(*KEYS, "idx", "seen", "fold").repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "idx")
    matrices = by_block.mapInArrow(_blockwise(lambda t: block_matrices(t, models)), "conv long, part int, block long, matrix array<double>")
    ends = matrices.repartition(parts, "conv").sortWithinPartitions(*KEYS).mapInArrow(_whole(chained), "conv long, part int, block long, entering int, leaving int, final boolean")
    ends = materialize(ends, "chat-blocks")
    # a block's ends come before its lines, in one stream
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    head = ends.select(*KEYS, F.lit(-1).cast("long").alias("idx"), none("line", "string"), none("blank", "boolean"), none("seen", "int"), none("given", "string"), none("fold", "int"), "entering", "leaving", "final")
    body = lines.select(*KEYS, "idx", "line", "blank", "seen", "given", "fold", none("entering", "int"), none("leaving", "int"), none("final", "boolean"))
    stream = head.unionByName(body).repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "idx")

    def render(table: pa.Table) -> pa.Table:
        idx = table.column("idx").to_numpy()
        ends, own = table.filter(pa.array(idx < 0)), table.filter(pa.array(idx >= 0)).combine_chunks()
        states = traced(own, models, ends.column("entering").to_numpy(), ends.column("leaving").to_numpy())
        begin, end = _edges(own)
        text, blank, given = (own.column(c).to_pylist() for c in ("line", "blank", "given"))
        out: list[list] = [[], [], [], []]
        for a, z, entering, final in zip(begin.tolist(), end.tolist(), ends.column("entering").to_pylist(), ends.column("final").to_pylist()):
            shown, turns, agreeing = [], 0, 0
            for i in range(a, z):
                role, begins = STATES[states[i]]
                # a path may open a conversation, or change its role, within a turn only at a price; it is a turn all the same
                before = STATES[states[i - 1]][0] if i > a else STATES[entering][0] if entering >= 0 else -1
                if begins or role != before:
                    shown += ["<|end|>"] * (before >= 0) + [f"<|{ROLES[role]}|>", strip_marker(text[i])[0]]
                    turns += 1
                else:
                    shown += [""] * blank[i] + [text[i]]
                agreeing += ROLES[role] == given[i]
            for column, value in zip(out, (states[a:z].tolist(), turns, agreeing, "\n".join(shown + ["<|end|>"] * final))):
                column.append(value)
        return pa.table({
            "conv_id": pa.array([None if c == NO_ID else c for c in ends.column("conv").to_pylist()], pa.int64()), "part": ends.column("part"), "block": ends.column("block"), "states": pa.array(out[0], pa.list_(pa.int32())),
            "n_turns": pa.array(out[1], pa.int64()), "n_lines": pa.array((end - begin).tolist(), pa.int64()), "n_agreeing": pa.array(out[2], pa.int64()), "rendered": pa.array(out[3], pa.string()),
        })

    return stream.mapInArrow(_blockwise(render), "conv_id long, part int, block long, states array<int>, n_turns long, n_lines long, n_agreeing long, rendered string")


def format_chat(transcripts: DataFrame, labelled: DataFrame | None = None, p: Chat = Chat()) -> DataFrame:
    """conv_id, n_turns, n_lines, n_agreeing (lines whose role is the given one) and rendered of every conversation, each turn as
    a `<|role|>` line, its lines and an `<|end|>` line.

    transcripts, labelled: pieces of transcripts (see `pieces`); labelled ones have roles. Without labelled, each hash half
    of the conversations is decoded by a model that was fitted on the other half, so that no label is used on its own line.
    """
    lines = numbered_lines(transcripts, p)
    models = fitted(lines if labelled is None else numbered_lines(labelled, p), p, labelled is None)
    blocks = recovered(lines, models)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "rendered"))), lambda x: x["rendered"]), "\n")
    return blocks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("n_turns", "n_lines", "n_agreeing")), text.alias("rendered"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all conversations down as plain transcripts, recover turns and roles from the lines, and render them canonically."""
    found = format_chat(plain_transcript(read_table(spark, sf_dir, "conversations")))
    return found.withColumn("rendered_sha256", F.sha2("rendered", 256))
