"""Chat formatting: round trips, the machine across tasks, markers and odd tables."""

from __future__ import annotations

import hashlib
import random

import pytest

from locengine.llm.chat import INSTRUCT, Marks, Template, digest, format_turns, read_turns, validate

SCHEMA = "conv_id long, turn long, role string, text string, segments int, valid string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]"]
PIECES += ["\\", "\\\\", "<", "</", "[", "]", "s>", " ", "\n", "é", "\U0001f600", "a$1", "<\\/s>", "INST"]


def hostile(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for conv in range(80):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "[TEXT]\\", "", None])
            out.append((conv, turn, role, rng.choice([hostile(rng), hostile(rng), "", None]), 1, "x"))
    out += [(None, 0, "user", "no id", 1, None), (None, 1, "assistant", "none", 1, None)]
    out += [(200, None, "user", "first", 1, None), (200, 5, "assistant", "tie b", 1, None)]
    out += [(200, 5, "assistant", "tie a", 1, None), (200, 5, "assistant", "tie a", 1, None)]
    out += [(201, 0, "user", "<s>" * 200_000, 1, None), (201, 1, "assistant", "x\\" * 500_000, 1, None)]
    return out


@pytest.fixture(scope="module")
def turns(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7).cache()


def expected(rows):
    """Turns per conversation in order; no tie of this table depends on escapes."""
    out = {}
    for key, turn, role, text, *_ in rows:
        out.setdefault(key, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [(r, t) for *_, r, t in sorted(v)] for k, v in out.items()}


def test_turns_come_back(turns, rows):
    back = {}
    for r in read_turns(format_turns(turns)).collect():
        back.setdefault(r.conv_id, []).append((r.position, r.role, r.text, r.trained))
    want = expected(rows)
    assert set(back) == set(want)
    for key, made in back.items():
        made.sort()
        assert [(r, t) for _, r, t, _ in made] == want[key]
        assert [x for *_, x in made] == [t if r == "assistant" else "" for r, t in want[key]]


def test_no_text_holds_a_control_string(turns):
    for row in format_turns(turns).collect():
        body = row.segments[1].text
        assert not any(c in body for c in INSTRUCT.all_controls)
        assert [s.loss for s in row.segments] == [False, row.role == "assistant", False]


def test_digest(turns, rows):
    made = {r.conv_id: r for r in digest(format_turns(turns)).collect()}
    sizes = {}
    for r in format_turns(turns).collect():
        sizes[r.conv_id] = sizes.get(r.conv_id, 0) + sum(len(s.text) for s in r.segments)
    for key, want in expected(rows).items():
        whole = "".join(f"{r}\n{t}\n" for r, t in want)
        loss = "".join(t for r, t in want if r == "assistant")
        got = made.pop(key)
        assert got.n_turns == len(want) and got.loss_chars == len(loss)
        assert got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got.formatted_chars == sizes[key]
    assert not made


def walk(roles):
    state = "start"
    wrong = None
    for i, role in enumerate(roles):
        to = INSTRUCT.moves.get((state, role))
        if to is None:
            wrong = i if wrong is None else wrong
            to = INSTRUCT.after(role) or state
        state = to
    return len(roles) if wrong is None and state not in INSTRUCT.ends else wrong


def test_machine(spark, turns, rows):
    made = {r.conv_id: r for r in validate(turns).collect()}
    for key, want in expected(rows).items():
        wrong = walk([r for r, _ in want])
        assert (made[key].n_turns, made[key].valid, made[key].wrong_turn) == (len(want), wrong is None, wrong)
    # One conversation over all tasks, its only fault in the middle.
    long = [(7, i, "user" if i % 2 == 0 else "assistant") for i in range(4000)]
    long[2001] = (7, 2001, "user")
    df = spark.createDataFrame([(*r, "t", 1, "x") for r in long], SCHEMA).repartition(6)
    got = validate(df).collect()
    assert [(r.n_turns, r.wrong_turn) for r in got] == [(4000, 2001)]
    good = [(7, i, "user" if i % 2 == 0 else "assistant", "t", 1, "x") for i in range(4000)]
    assert validate(spark.createDataFrame(good, SCHEMA)).first().valid


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    for made in (format_turns(none), validate(none), digest(format_turns(none)), read_turns(format_turns(none))):
        assert made.collect() == []


def test_templates_that_cannot_be_read_back():
    fine = dict(moves={("a", "u"): "a"}, ends=frozenset("a"), start="a", controls=("<u>", "</u>"))
    Template(roles={"u": Marks("<u>", "</u>")}, **fine)
    for roles in (
        {"u": Marks("<u>", "\n")},  # no control string ends the text
        {"u": Marks("<u>", "</u>"), "v": Marks("<u>v", "</u>")},  # one head of another
        {"u": Marks("<u><", "</u>")},  # a text "u>" would make a control string
    ):
        with pytest.raises(ValueError):
            Template(roles=roles, **fine)
    with pytest.raises(ValueError):
        Template(roles={"u": Marks("<u>", "</u>")}, **{**fine, "controls": ("<u>", "\\u")})
