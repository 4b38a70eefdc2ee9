import itertools

import numpy as np
import pytest

from lonewood.llm.chat import N_ROLES, STATES, Counts, Hmm, chat_turns, line_marker, observe, role_number
from llm_cases import ODD

ROWS = "conv_id long, turn long, role string, text string"


def model(seed=0):
    return Hmm(np.random.default_rng(seed).integers(0, 50, Counts.SIZE))


def best_path(m, x, before=None):
    e, t = m.emissions(x), m.step(x)

    def score(path):
        s = (m.start() if before is None else t[0][before])[path[0]] + e[0][path[0]]
        return s + sum(t[k][path[k - 1], path[k]] + e[k][path[k]] for k in range(1, len(path)))

    return max(itertools.product(range(STATES), repeat=len(x)), key=score), score


def test_viterbi_by_brute_force():
    rows = [("user", "hello there?"), (None, "Assistant: yes\nindeed"), ("??", "short")]
    x, _ = observe(rows)
    for seed in range(5):
        m = model(seed)
        want, score = best_path(m, x)
        assert np.isclose(score(tuple(m.decode(x))), score(want))
        assert np.isclose(m.matrix(x, True)[0].max(), score(want))
        # in two parts, by the matrices of the parts
        a, b = x[:2], x[2:]
        joint = (m.matrix(a, True)[0][:, None] + m.matrix(b, False)).max()
        assert np.isclose(joint, score(want))


def test_markers():
    assert [role_number(r) for r in ("User", "GPT", " ai ", "tool", None, "")] == [1, 2, 2, -1, -1, -1]
    for line, want in (("User: hi", (1, "hi")), ("### Assistant", (2, "")), ("**Human:** a: b", (1, "a: b")), ("[SYSTEM] x", (0, "x")), ("<|user|>", (1, "")),
                       ("<|im_start|>assistant", (2, "")), ("Note: x", (-1, "Note: x")), ("usher: x", (-1, "usher: x")), ("a", (-1, "a"))):
        assert line_marker(line) == want, line


def talk(n=60):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(2, 9))):
            user = t % 2 == 0
            text = "what is it like to be there?" if user else "\n".join(["it is a long answer with many words " * 5] * int(rng.integers(2, 6)))
            rows.append((c, t, "user" if user else "assistant", text))
    return rows


@pytest.mark.parametrize("hidden", [0, 2])
def test_roles_come_back(spark, hidden):
    rows = talk()
    shown = [(c, t, None if hidden and (7 * c + t) % hidden == 0 else r, x) for c, t, r, x in rows]
    out = chat_turns(spark.createDataFrame(shown, ROWS).repartition(5)).collect()
    got = {(int(r.conv), r.turn): r for r in out}
    assert len(out) == len(rows)
    assert np.mean([got[c, t].role == r for c, t, r, _ in rows]) > (0.97 if hidden else 0.999)
    assert got[0, 0].rendered == "<|user|>\nwhat is it like to be there?\n<|end|>\n"


def test_markers_inside_a_text_begin_turns(spark):
    rows = talk() + [(900, 0, None, "User: what is this?\nAssistant: an answer\nwith two lines\nUser: thanks")]
    out = [r for r in chat_turns(spark.createDataFrame(rows, ROWS)).collect() if r.conv == "900"]
    assert [(r.piece, r.role, r.n_lines) for r in sorted(out, key=lambda r: r.piece)] == [(0, "user", 1), (1, "assistant", 2), (2, "user", 1)]


def test_markers_that_begin_no_turn_of_their_role_are_text(spark):
    long = "it is a long answer with many words " * 5
    rows = talk() + [(c, 0, "user", "what is it like to be there?") for c in (900, 901)]
    rows += [(900, 1, "assistant", f"{long}\nContext: {long}"), (901, 1, "assistant", f"Question: {long}\n{long}"), (902, 0, "user", "User: what is it like to be there?")]
    got = {(r.conv, r.turn, r.piece): r.rendered for r in chat_turns(spark.createDataFrame(rows, ROWS)).collect() if r.conv >= "900"}
    assert got["900", 1, 0] == f"<|assistant|>\n{long}\nContext: {long.strip()}\n<|end|>\n"
    assert got["901", 1, 0] == f"<|assistant|>\nQuestion: {long}\n{long.strip()}\n<|end|>\n"
    assert got["902", 0, 0] == "<|user|>\nwhat is it like to be there?\n<|end|>\n"


def test_conversations_over_many_blocks(spark):
    rows = [(1 if c < 30 else c, 100 * c + t, r if (c + t) % 3 else None, x) for c, t, r, x in talk()]
    df = spark.createDataFrame(rows, ROWS)
    key = lambda r: (r.conv, r.turn, r.piece)
    one, many = sorted(chat_turns(df).collect(), key=key), sorted(chat_turns(df, block_bytes=200).collect(), key=key)
    assert one == many and len(one) == len(rows)


def test_edge_cases(spark):
    odd = [(None, None, None, t) for t in ODD] + [(5, 1, "user", "same"), (5, 1, "user", "same"), (6, 0, "x" * 50, None)]
    out = chat_turns(spark.createDataFrame(odd, ROWS)).collect()
    assert len([r for r in out if r.conv is None]) >= len(ODD) and len([r for r in out if r.conv == "5"]) == 2
    assert sum(r.n_lines for r in out) == sum(len((t or "").split("\n")) for *_, t in odd)
    assert chat_turns(spark.createDataFrame([], ROWS)).count() == 0
    assert N_ROLES * 2 == STATES
