"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A state is a role and whether the line opens a turn. Lines are seen through their speaker mark (``User:``, ``**A**:``,
``<|assistant|>`` ..), length, closing question mark and list look; transition and emission counts come from labelled
conversations, in Spark. Viterbi decoding is split at fixed numbers of lines: each chunk is reduced to the best log
probability from every state to every state, the chunks of a conversation are chained on these small matrices, and
every chunk is decoded between its known borders, so a conversation of any length is spread over tasks with the same
result as in one piece.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.operators.ranking import group_rank
from spoorline.session import cut

ROLES = ("system", "user", "assistant")
CHUNK_LINES = 4096
# speaker words of each role; any other short name before a colon is the mark of an unknown speaker
SPEAKERS = {
    "system": "system instruction instructions context".split(),
    "user": "user human question customer client prompt q me".split(),
    "assistant": "assistant ai bot answer response model agent a".split(),
}
_role_of = {word: role for role, words in SPEAKERS.items() for word in words}
MARK = re.compile(
    r"\s*(?:#{1,6}\s*|[-*>]\s+)?(?:<\|(?P<a>\w+)\|>|\[(?P<b>\w+)\]\s*:?|\*\*(?P<c>\w+)\s*:?\*\*\s*:?|(?P<d>\w+)\s*:)\s*", re.A)
OTHER = re.compile(r"\s*[A-Z][\w.'-]*(?: [A-Z][\w.'-]*){0,2}\s*:\s")
LIST = re.compile(r"\s*(?:[-*+]|\d{1,3}[.)])\s")
FEATURES = ("mark", "length", "question", "list")
VALUES = (5, 5, 2, 2)  # how many values each feature has


def speaker(line: str) -> tuple[str, int]:
    """Role of the line's speaker mark, or ``none`` / ``other``, and the number of characters it takes."""
    m = MARK.match(line)
    if m:
        role = _role_of.get(next(x for x in m.groups() if x).lower())
        if role:
            return role, m.end()
    m = OTHER.match(line)
    return ("other", 0) if m else ("none", 0)


def observe(line: str) -> tuple[str, str, str, str]:
    """The features of a line."""
    role, at = speaker(line)
    rest = line[at:].strip()
    length = "0" if not rest else "short" if len(rest) < 40 else "line" if len(rest) < 160 else "long" if len(rest) < 640 else "very"
    return role, length, str(rest.endswith("?")), str(bool(LIST.match(rest)))


@dataclass
class Model:
    """Log probabilities: ``start[s]``, ``step[s, t]``, ``emit[s][feature][value]``; states are (role, opens a turn)."""

    start: np.ndarray
    step: np.ndarray
    emit: list[list[dict[str, float]]]

    def emission(self, line: str) -> np.ndarray:
        seen = observe(line)
        return np.array([sum(own[f].get(v, own[f][""]) for f, v in enumerate(seen)) for own in self.emit])


STATES = [(role, opens) for role in ROLES for opens in (True, False)]


def _features(batches):
    for batch in batches:
        rows = [observe(x) for x in batch.column("line").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("state"), *[pa.array([r[i] for r in rows], pa.string()) for i in range(4)]], ["state", *FEATURES])


def _state(role: Column, opens: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), role).cast("int") * 2 - 2 + F.when(opens, 0).otherwise(1)


def learn(lines: DataFrame) -> Model:
    """Model from labelled lines ``(conv_id, turn, line_no, role, line)``; counts of all rows, add-one smoothed.

    Rows of other roles or without an id, turn or role are left out. Only counts reach the driver, a few per state.
    """
    known = lines.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    known = known.select("conv_id", "turn", "line_no", "role", F.coalesce("line", F.lit("")).alias("line"))
    seen = known.select(_state(F.col("role"), F.col("line_no") == 0).alias("state"), "line").mapInArrow(_features, "state int, " + ", ".join(f"{f} string" for f in FEATURES))
    stacked = seen.select("state", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("v")) for i, f in enumerate(FEATURES)])).alias("x"))
    counts = stacked.groupBy("state", "x.f", "x.v").agg(F.count(F.lit(1)).alias("n")).collect()
    emit = []
    for s in range(len(STATES)):
        own = []
        for f in range(len(FEATURES)):
            values = {r["v"]: r["n"] for r in counts if r["state"] == s and r["f"] == f}
            total = sum(values.values()) + VALUES[f]
            own.append({v: np.log((n + 1) / total) for v, n in values.items()} | {"": np.log(1 / total)})
        emit.append(own)
    turns = known.groupBy("conv_id", "turn", "role").agg((F.max("line_no") + 1).alias("n"))
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("following"))
    pairs = turns.join(later, ["conv_id", "turn"], "left").groupBy("role", "following").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("long")).collect()
    inner = {r["role"]: (r["a"], r["b"]) for r in turns.groupBy("role").agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("a"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("b")).collect()}
    first = {r["role"]: r["n"] for r in turns.where("turn = 0").groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    step = np.full((len(STATES), len(STATES)), 0.0)
    for i, role in enumerate(ROLES):
        opened, went_on = inner.get(role, (0, 0))
        step[2 * i, 2 * i + 1] = opened + 1
        step[2 * i + 1, 2 * i + 1] = went_on + 1
        for j, other in enumerate(ROLES):
            rows = [r for r in pairs if r["role"] == role and r["following"] == other]
            total, long = sum(r["turns"] for r in rows), sum(r["long"] for r in rows)
            step[2 * i, 2 * j] = total - long + 0.1
            step[2 * i + 1, 2 * j] = long + 0.1
    start = np.array([first.get(role, 0) + 1.0 if opens else 0.0 for role, opens in STATES])
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), emit)


def _groups(batches, keys: list[str]):
    """Consecutive rows of equal keys as lists of dicts; rows arrive sorted by them."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current and rows:
                yield current, rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield current, rows


def _matrices(shared):
    """Per chunk the best log probability of its lines from the state before it to its last state."""

    def run(batches):
        m: Model = shared.value
        out = []
        for (conv, chunk), rows in _groups(batches, ["conv", "chunk"]):
            emissions = [m.emission(r["line"]) for r in rows]
            if chunk == 0:
                best = np.tile(m.start + emissions[0], (len(STATES), 1))
            else:
                best = m.step + emissions[0]
            for e in emissions[1:]:
                best = (best[:, :, None] + m.step[None]).max(axis=1) + e
            out.append((conv, chunk, best.ravel().tolist()))
            if len(out) >= 2000:
                yield _batch(out, ["conv", "chunk", "best"], [pa.string(), pa.int64(), pa.list_(pa.float64())])
                out = []
        if out:
            yield _batch(out, ["conv", "chunk", "best"], [pa.string(), pa.int64(), pa.list_(pa.float64())])

    return run


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _borders(batches):
    """Per chunk the state before it and its last state on the best path of the conversation."""
    out = []
    for (conv,), rows in _groups(batches, ["conv"]):
        score, back = np.zeros(len(STATES)), []
        for i, r in enumerate(rows):
            best = np.array(r["best"]).reshape(len(STATES), -1)
            if i == 0:
                score = best[0]
                back.append(np.zeros(len(STATES), int))
            else:
                total = score[:, None] + best
                back.append(total.argmax(axis=0))
                score = total.max(axis=0)
        state = int(score.argmax())
        for r, pointer in zip(reversed(rows), reversed(back)):
            before = int(pointer[state])
            out.append((conv, r["chunk"], before, state))
            state = before
        if len(out) >= 2000:
            yield _batch(out, ["conv", "chunk", "enter", "leave"], [pa.string(), pa.int64(), pa.int32(), pa.int32()])
            out = []
    if out:
        yield _batch(out, ["conv", "chunk", "enter", "leave"], [pa.string(), pa.int64(), pa.int32(), pa.int32()])


def viterbi(m: Model, emissions: list[np.ndarray], enter: int | None, leave: int | None) -> list[int]:
    """Best states of a run of lines after the state ``enter`` (None: the start), ending in ``leave`` (None: any)."""
    score, back = (m.start if enter is None else m.step[enter]) + emissions[0], []
    for e in emissions[1:]:
        total = score[:, None] + m.step
        back.append(total.argmax(axis=0))
        score = total.max(axis=0) + e
    state = int(score.argmax()) if leave is None else leave
    path = [state]
    for pointer in reversed(back):
        state = int(pointer[state])
        path.append(state)
    return path[::-1]


def _decode(shared):
    def run(batches):
        m: Model = shared.value
        out = []
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
        names = ["conv", "chunk", "pos", "role", "opens", "line"]
        for (conv, chunk), rows in _groups(batches, ["conv", "chunk"]):
            path = viterbi(m, [m.emission(r["line"]) for r in rows], None if chunk == 0 else rows[0]["enter"], rows[0]["leave"])
            for r, s in zip(rows, path):
                role, opens = STATES[s]
                mark, at = speaker(r["line"])
                out.append((conv, chunk, r["pos"], role, opens, r["line"][at:] if opens and mark == role else r["line"]))
            if len(out) >= 5000:
                yield _batch(out, names, kinds)
                out = []
        if out:
            yield _batch(out, names, kinds)

    return run


def recover_lines(lines: DataFrame, model: Model) -> DataFrame:
    """``(conv_id, pos, role, opens, line)``: the best role of every line, its own role's mark taken off.

    ``lines`` is ``(conv_id, at, line)``; ``at`` orders the lines of a conversation, ties by text. Null ids form one
    conversation, null lines are empty. ``pos`` counts from 0.
    """
    spark = lines.sparkSession
    # ids as text: null is the one text without the leading mark
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    known = lines.select(conv.alias("conv"), "at", F.coalesce("line", F.lit("")).alias("line"))
    ranked = group_rank(known.withColumn("__tie", F.monotonically_increasing_id()), ["conv"], ["at", "line", "__tie"], "pos").select("conv", "pos", "line")
    placed = cut(ranked.withColumn("chunk", F.floor(F.col("pos") / CHUNK_LINES).cast("long")))
    shared = spark.sparkContext.broadcast(model)
    in_chunks = placed.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos")
    matrices = in_chunks.mapInArrow(_matrices(shared), "conv string, chunk long, best array<double>")
    borders = cut(matrices.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_borders, "conv string, chunk long, enter int, leave int"))
    decoded = (
        placed.join(borders, ["conv", "chunk"]).repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos")
        .mapInArrow(_decode(shared), "conv string, chunk long, pos long, role string, opens boolean, line string")
    )
    kind = lines.schema["conv_id"].dataType
    return decoded.select(F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id"), "conv", "chunk", "pos", "role", "opens", "line")


def canonical_turns(recovered: DataFrame) -> DataFrame:
    """``(conv_id, first_pos, role, n_lines, text, rendered)`` per recovered turn, numbered by its first line.

    A turn may run over chunk borders: the first line of the open turn is carried from chunk to chunk.
    """
    frozen = cut(recovered)
    opened = frozen.where("opens").groupBy("conv", "chunk").agg(F.max("pos").alias("last"))
    chunks = frozen.select("conv", "chunk").distinct().join(opened, ["conv", "chunk"], "left")
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("conv", "chunk", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = frozen.join(carried, ["conv", "chunk"]).withColumn("first_pos", F.coalesce(F.max(F.when(F.col("opens"), F.col("pos"))).over(inside), "carried", F.lit(0)))
    turns = placed.groupBy("conv_id", "conv", "first_pos").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "line"))).alias("lines"))
    text = F.trim(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    role = F.col("lines")[0]["role"]
    return turns.select("conv_id", "first_pos", role.alias("role"), F.size("lines").cast("long").alias("n_lines"), text.alias("text")).withColumn(
        "rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


def plain_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as the plain lines of a transcript: ``(conv_id, turn, line_no, role, line)``.

    The style of the speaker marks varies with the conversation, and one turn in eight has none, as in pasted logs.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit("bare")), F.lit(8)) == 0
    text = F.coalesce("text", F.lit(""))
    who = F.create_map(*[F.lit(x) for pair in (("user", "Human"), ("assistant", "AI"), ("system", "System")) for x in pair])
    short = F.create_map(*[F.lit(x) for pair in (("user", "Q"), ("assistant", "A"), ("system", "Context")) for x in pair])
    role = F.coalesce("role", F.lit(""))
    marked = (
        F.when(bare | (role == ""), text)
        .when(style == 0, F.concat(F.initcap(role), F.lit(": "), text))
        .when(style == 1, F.concat(F.coalesce(who[role], role), F.lit(": "), text))
        .when(style == 2, F.concat(F.coalesce(short[role], role), F.lit(": "), text))
        .when(style == 3, F.concat(F.lit("**"), role, F.lit("**: "), text))
        .otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n"), text))
    )
    lines = conversations.select("conv_id", "turn", "role", F.posexplode(F.split(marked, "\n")).alias("line_no", "line"))
    return lines.select("conv_id", "turn", "line_no", "role", "line")
