"""Chat formatting: a hidden Markov model recovers who speaks each line.

States are (role, first line of a turn or not) for the roles system, user and assistant.
A line shows a speaker marker in its text ("User:", "### Assistant", "<|user|>", ...), the
marker of its row (the role column, with its many spellings), its length class, whether it
ends as a question, and whether a row begins with it.  Transitions, length classes and
questions are counted over all rows with a known role; markers are right with probability
``TRUST``.  Viterbi gives the most likely states; runs of one turn are rendered in one
canonical form.

Rows are range-sorted by conversation and turn and written in blocks of bounded size, so a
conversation may span any number of blocks and no task gathers one.  For the first and the
last conversation of a block, the block's best path scores between all pairs of states are
a small max-plus matrix.  Products of these matrices along a conversation give the states
at the block borders; then every block decodes its own lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .common import ready, shuffle_partitions, staged, tidy
from .files import NewFile, pack_rows, read_file, task_name, unpack_table

ROLES = ("system", "user", "assistant")
N_ROLES = len(ROLES)
STATES = 2 * N_ROLES  # role r: r begins a turn, N_ROLES + r goes on
LENGTHS = (0, 20, 40, 80, 160, 320, 640, 1280)
TRUST = 0.97
#: Share of speaker markers among the later lines of turns.
LATER = 1e-5
BLOCK_BYTES = 4 << 20

# Spellings of the roles.
SPELLINGS = {
    "system": ("system", "sys", "instructions", "instruction", "context", "developer"),
    "user": ("user", "human", "customer", "client", "question", "prompter", "prompt", "you", "q"),
    "assistant": ("assistant", "gpt", "bot", "ai", "chatgpt", "model", "answer", "agent", "chatbot", "response", "a"),
}
_ROLE = {w: i for i, r in enumerate(ROLES) for w in SPELLINGS[r]}
_NAMES = "|".join(sorted((w for w in _ROLE), key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*({_NAMES})\s*(?:\|>)?:?|\[({_NAMES})\]:?|(?:#{{1,6}}|\*{{1,2}})?\s*({_NAMES})\s*(?:\*{{1,2}})?:(?:\*{{1,2}})?|#{{2,6}}\s*({_NAMES})\s*$)\s*", re.I)


def role_number(marker: str | None) -> int:
    """Role of a marker's text; -1 if unknown."""
    return _ROLE.get(re.sub(r"[^a-z]", "", (marker or "").lower()), -1)


def line_marker(line: str) -> tuple[int, str]:
    """(role of the speaker marker a line begins with or -1, the line without it)."""
    m = _MARKER.match(line)
    if not m:
        return -1, line
    return _ROLE[next(g for g in m.groups() if g).lower()], line[m.end():]


def observe(rows: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Lines of (role, text) rows, whole and without their marker.  Columns: row, row begins,
    row's marker, line's marker, length class, question."""
    out, lines = [], []
    for i, (role, text) in enumerate(rows):
        marker = role_number(role)
        for k, line in enumerate((text or "").split("\n")):
            mine, rest = line_marker(line)
            out.append((i, k == 0, marker, mine, int(np.searchsorted(LENGTHS, len(rest), "left")), rest.rstrip().endswith("?")))
            lines.append((line, rest))
    return np.array(out, np.int64).reshape(-1, 6), lines


class Counts:
    """Sums that the parameters follow from: initial roles, role after role, length class and
    question by state.  One flat vector, so that Spark can add them up."""

    SHAPES = ((N_ROLES,), (N_ROLES, N_ROLES), (STATES, len(LENGTHS) + 1), (STATES, 2))

    @staticmethod
    def split(flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in Counts.SHAPES])
        return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), Counts.SHAPES, strict=True)]

    SIZE = N_ROLES + N_ROLES**2 + STATES * (len(LENGTHS) + 3)


class Hmm:
    def __init__(self, counts: np.ndarray, trust: float = TRUST):
        initial, after, length, question = Counts.split(counts.astype(np.float64))
        with np.errstate(divide="ignore"):
            self.initial = np.log((initial + 1) / (initial + 1).sum())
            next_role = np.log((after + 1) / (after + 1).sum(axis=1, keepdims=True))
            self.length = np.log((length + 1) / (length + 1).sum(axis=1, keepdims=True))
            self.question = np.log((question + 1) / (question + 1).sum(axis=1, keepdims=True))
        other = (1 - trust) / (N_ROLES - 1)
        # row marker seen: right with probability trust; the last column is no marker
        self.row = np.log(np.concatenate([np.full((N_ROLES, N_ROLES), other) + np.eye(N_ROLES) * (trust - other), np.ones((N_ROLES, 1))], axis=1))
        self.row = np.concatenate([self.row, self.row])
        # a marker in the text: on the first line of a turn, hardly ever on a later one
        first = np.concatenate([0.5 * (np.full((N_ROLES, N_ROLES), other) + np.eye(N_ROLES) * (trust - other)), np.full((N_ROLES, 1), 0.5)], axis=1)
        later = np.concatenate([np.full((N_ROLES, N_ROLES), LATER / N_ROLES), np.full((N_ROLES, 1), 1 - LATER)], axis=1)
        self.text = np.log(np.concatenate([first, later]))
        # inside a row a new turn needs a reason: a marker
        stay, turn = np.log(0.99), np.log(0.01)
        self.inside = np.full((STATES, STATES), -np.inf)
        self.across = np.full((STATES, STATES), -np.inf)  # a row begins: so does a turn
        for s in range(STATES):
            r = s % N_ROLES
            self.inside[s, N_ROLES + r] = stay
            self.inside[s, :N_ROLES] = turn + next_role[r]
            self.across[s, :N_ROLES] = next_role[r]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Log probability of every line (rows) in every state."""
        return self.row[:, x[:, 2]].T + self.text[:, x[:, 3]].T + self.length[:, x[:, 4]].T + self.question[:, x[:, 5]].T

    def step(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[:, 1][:, None, None] == 1, self.across, self.inside)

    def start(self) -> np.ndarray:
        return np.concatenate([self.initial, np.full(N_ROLES, -np.inf)])

    def matrix(self, x: np.ndarray, begins: bool) -> np.ndarray:
        """Best scores over the lines ``x`` from the state before (rows; all alike if the
        conversation begins here) to the last state (columns)."""
        e, t = self.emissions(x), self.step(x)
        m = np.broadcast_to(self.start(), (STATES, STATES)) + e[0] if begins else t[0] + e[0]
        for k in range(1, len(x)):
            m = (m[:, :, None] + t[k][None]).max(axis=1) + e[k]
        return m

    def decode(self, x: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """Viterbi states of the lines ``x`` between the state before them (none: the
        conversation begins) and their last state (none: the best)."""
        e, t = self.emissions(x), self.step(x)
        score = (self.start() if before is None else t[0][before]) + e[0]
        back = np.zeros((len(x), STATES), np.int8)
        for k in range(1, len(x)):
            paths = score[:, None] + t[k]
            back[k] = paths.argmax(axis=0)
            score = paths[back[k], np.arange(STATES)] + e[k]
        states = np.empty(len(x), np.int64)
        states[-1] = score.argmax() if last is None else last
        for k in range(len(x) - 1, 0, -1):
            states[k - 1] = back[k][states[k]]
        return states


def render(role: str, lines: list[str]) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n" + "\n".join(lines).strip() + "\n<|end|>\n"


# --- blocks of sorted rows ------------------------------------------------------------------


def _sorted_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(part, seq, path) of files with columns conv, turn, role, text in global order."""
    folder = new_path(rows.sparkSession, "chat")
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("tie")]
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys, "row").sortWithinPartitions(*keys, F.asc_nulls_first("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            path = f"{folder}/{task_name()}-{seq:06d}.arrow"
            f = NewFile(path)
            f.write(pack_rows(held))
            f.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([path])], names=["part", "seq", "path"])

        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                held.append(b.slice(lo, 1000))
                size += held[-1].nbytes
                if size >= block_bytes:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return staged(ranged.select("conv", "turn", "role", "text").mapInArrow(tidy(run), "part int, seq int, path string"), "chat")


def _conversations(path: str) -> list[tuple[object, list[tuple]]]:
    """Runs of rows (turn, role, text) of one conversation, in order."""
    out: list[tuple[object, list[tuple]]] = []
    t = unpack_table(read_file(path))
    for conv, *row in zip(*[c.to_pylist() for c in t.columns], strict=True):
        if not out or out[-1][0] != conv:
            out.append((conv, []))
        out[-1][1].append(tuple(row))
    return out


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Counts of the known roles of each block, and its first and last conversation with
    their known roles, for the transitions between blocks."""
    for b in batches:
        for part, seq, path in zip(*[c.to_pylist() for c in b.columns], strict=True):
            flat = np.zeros(Counts.SIZE, np.int64)
            initial, after, length, question = Counts.split(flat)
            runs = _conversations(path)
            for conv, rows in runs:
                roles = [role_number(r) for _, r, _ in rows]
                if roles[0] >= 0 and conv != runs[0][0]:
                    initial[roles[0]] += 1
                for a, c in zip(roles, roles[1:], strict=False):
                    if a >= 0 and c >= 0:
                        after[a, c] += 1
                x, _ = observe([(r, t) for _, r, t in rows])
                x = x[x[:, 2] >= 0]
                state = x[:, 2] + N_ROLES * (1 - x[:, 1])
                np.add.at(length, (state, x[:, 4]), 1)
                np.add.at(question, (state, x[:, 5]), 1)
            ends = [(runs[0], 1), (runs[-1], 0)] if runs else []
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([flat.tolist()], pa.list_(pa.int64())),
                pa.array([[c for (c, _), _ in ends]], pa.list_(pa.string())), pa.array([[role_number(rows[0 if k else -1][1]) for (_, rows), k in ends]], pa.list_(pa.int32())),
            ], names=["part", "seq", "flat", "convs", "roles"])


def _edges(shared):
    """Max-plus matrices of the conversations at the borders of each block."""

    def run(batches):
        model = shared.value
        for b in batches:
            for part, seq, path in zip(*[c.to_pylist() for c in b.columns], strict=True):
                runs = _conversations(path)
                picked = {0, len(runs) - 1}
                for k in sorted(picked):
                    x, _ = observe([(r, t) for _, r, t in runs[k][1]])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([runs[k][0]], pa.string()), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([k > 0], pa.bool_()),
                        pa.array([model.matrix(x, True).tobytes()], pa.binary()), pa.array([model.matrix(x, False).tobytes()], pa.binary()),
                    ], names=["conv", "part", "seq", "last", "begin", "go"])

    return run


def _borders(pieces: pa.Table) -> pa.Table:
    """The best state at the end of each piece of one conversation."""
    t = pieces.sort_by([("part", "ascending"), ("seq", "ascending")])
    parts, seqs, lasts, begin, go = (t.column(c).to_pylist() for c in ("part", "seq", "last", "begin", "go"))
    n = len(parts)
    score, back = np.frombuffer(begin[0]).reshape(STATES, STATES)[0], []
    for k in range(1, n):
        paths = score[:, None] + np.frombuffer(go[k]).reshape(STATES, STATES)
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0)
    state = int(score.argmax())
    ends = [state]
    for b in reversed(back):
        state = int(b[state])
        ends.append(state)
    ends.reverse()
    return pa.table([pa.array(parts, pa.int32()), pa.array(seqs, pa.int32()), pa.array(lasts, pa.bool_()), pa.array([None, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())],
                    names=["part", "seq", "last", "before", "end"])


_TURNS = "conv string, turn long, piece int, role string, n_lines int, rendered string"


def _decode(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            for path, borders in zip(b.column("path").to_pylist(), b.column("borders").to_pylist(), strict=True):
                runs = _conversations(path)
                known = {len(runs) - 1 if x["last"] else 0: x for x in borders or []}
                out: list[tuple] = []
                for k, (conv, rows) in enumerate(runs):
                    x, lines = observe([(r, t) for _, r, t in rows])
                    border = known.get(k)
                    states = model.decode(x, border["before"] if border else None, border["end"] if border else None)
                    # a marker is one only where a turn of its role begins; elsewhere it is text
                    lines = [rest if s == mine else line for (line, rest), s, mine in zip(lines, states.tolist(), x[:, 3].tolist(), strict=True)]
                    first = np.flatnonzero(states < N_ROLES)
                    row = x[first, 0]
                    piece = np.arange(len(first)) - np.searchsorted(row, row)
                    for a, z, r, p in zip(first.tolist(), [*first[1:].tolist(), len(x)], row.tolist(), piece.tolist(), strict=True):
                        role = ROLES[states[a]]
                        out.append((conv, rows[r][0], p, role, z - a, render(role, lines[a:z])))
                    if len(out) >= 2000 or k == len(runs) - 1:
                        c = list(zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string()),
                                                          pa.array(c[4], pa.int32()), pa.array(c[5], pa.string())], names=["conv", "turn", "piece", "role", "n_lines", "rendered"])
                        out = []

    return run


def chat_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per recovered turn: conv (as text), turn (of the row it lies in), piece (its
    place among the turns of that row), role, n_lines and rendered, the canonical form.

    Null and empty texts are one empty line.  A null or unknown role is no evidence.  Rows
    are ordered by turn, then role and text; repeated rows are turns of their own.  Rows of
    null conversation are one conversation.  An empty table gives an empty result."""
    spark = ready(conversations.sparkSession)
    rows = conversations.select(F.col(conv_id).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    stored = _sorted_blocks(rows, block_bytes)
    many = shuffle_partitions(spark)  # few rows, with a block of work behind each
    counted = staged(stored.repartition(many, "path").mapInArrow(tidy(_count), "part int, seq int, flat array<long>, convs array<string>, roles array<int>"), "chat")
    total = np.array(counted.agg(*[F.sum(F.col("flat")[k]) for k in range(Counts.SIZE)]).first(), dtype=object)
    total = np.array([int(x or 0) for x in total], np.int64)
    # what happens between blocks: a conversation begins, or goes on from the block before
    ends = counted.select("part", "seq", F.posexplode(F.arrays_zip("convs", "roles")).alias("k", "x")).select(
        F.coalesce("x.convs", F.lit("\0")).alias("conv"), "part", "seq", "k", "x.roles")
    pairs = ends.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "k", "roles"))).alias("p"))
    begins = pairs.where("p[0].k = 0").groupBy(F.col("p")[0]["roles"].alias("r")).agg(F.count("*").alias("n"))
    going = pairs.select(F.explode(F.filter(F.transform("p", lambda x, i: F.struct(x["k"].alias("k"), x["roles"].alias("r"), F.get("p", i + 1)["k"].alias("k2"), F.get("p", i + 1)["roles"].alias("r2"))),
                                            lambda x: (x["k"] == 1) & (x["k2"] == 0))).alias("x")).groupBy("x.r", "x.r2").agg(F.count("*").alias("n"))
    initial, after, _, _ = Counts.split(total)
    for r in begins.collect():
        if r["r"] >= 0:
            initial[r["r"]] += r["n"]
    for r in going.collect():
        if r["r"] >= 0 and r["r2"] >= 0:
            after[r["r"], r["r2"]] += r["n"]
    shared = spark.sparkContext.broadcast(Hmm(total))
    edges = stored.repartition(many, "path").mapInArrow(tidy(_edges(shared)), "conv string, part int, seq int, last boolean, begin binary, go binary")
    borders = edges.groupBy("conv").applyInArrow(_borders, "part int, seq int, last boolean, before int, end int")
    borders = borders.groupBy("part", "seq").agg(F.collect_list(F.struct("last", "before", "end")).alias("borders"))
    return stored.join(borders.hint("shuffle_merge"), ["part", "seq"], "left").repartition(many).select("path", "borders").mapInArrow(tidy(_decode(shared)), _TURNS)
