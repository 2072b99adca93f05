r"""Chat formatting: a finite-state machine over roles, and a template that says what it emits.

A `Template` names, per role, the markers around a text, whether the text is trained on (its
loss flag), and the machine: which roles a state takes and the state after each. Every turn
becomes three segments, marker, text, marker; only texts of trained roles carry the flag.
`format_turns` emits them with column expressions, row by row and without a shuffle. `validate`
runs the machine. Turns are sorted in ranges, so that one conversation may lie in many tasks;
each task sums up its run of a conversation as a function of the state at its start, and the
functions, one per task, are chained per conversation. `read_turns` parses formatted text back,
and `digest` hashes it in one pass, with one turn in memory.

A text never holds a control string: escape characters are doubled, and one is put behind the
first character of every control string. Undoing both gives the text back, whatever it is.

Defined results:
- a null text or role is empty; a role that the template does not name is framed by name, with
  the markers of `other`, and is never trained on;
- rows of a conversation go by turn (null first), equal turns by role, then by escaped text;
  repeated rows are turns of their own; a null id is a conversation;
- turns out of order are formatted all the same; `validate` marks their conversations, with the
  position of the first turn that the machine does not take; it then goes on in the state
  that this role leads to (of a role unknown: it stays);
- an empty table gives no rows; other columns of the input are not returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type


@dataclass(frozen=True)
class Marks:
    """What stands before and after a text, and whether the text is trained on."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: markers per role. moves: (state, role) -> state. ends: states to end in."""

    roles: dict[str, Marks]
    moves: dict[tuple[str, str], str]
    ends: frozenset[str]
    start: str
    controls: tuple[str, ...]
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    escape: str = "\\"
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        if len(self.escape) != 1 or any(self.escape in c or len(c) < 2 for c in self.all_controls):
            raise ValueError("control strings have two characters or more, none the escape character")
        befores = [m.before for m in self.roles.values()] + [self.other[0]]
        afters = [m.after for m in self.roles.values()] + [self.other[1], self.other[2]]
        for i, a in enumerate(befores):
            if any(b.startswith(a) for j, b in enumerate(befores) if i != j):
                raise ValueError(f"a turn's first marker {a!r} is the head of another's")
        for marker in afters:
            if not any(c in marker for c in self.all_controls):
                raise ValueError(f"{marker!r} ends a text and needs a control string")
        for c in self.all_controls:
            for k in range(1, len(c)):
                if any(m.endswith(c[:k]) for m in [*befores, self.other[1]]) or any(
                    m.startswith(c[k:]) for m in afters
                ):
                    raise ValueError(f"{c!r} could form at the edge of a text")
        names = dict.fromkeys([self.start, *(s for s, _ in self.moves), *self.moves.values()])
        object.__setattr__(self, "states", tuple(names))

    @property
    def all_controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.controls, *self.other]))

    def after(self, role: str) -> str | None:
        """The state that a role leads to, used to go on behind a turn out of order."""
        return next((to for (_, r), to in self.moves.items() if r == role), None)

    def escaped(self, text: Column) -> Column:
        """The text without control strings."""
        here = "|".join(re.escape(c) for c in sorted(self.all_controls, key=len, reverse=True))
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        mark = self.escape.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(doubled, rf"(?s)(?=(?:{here}))(.)", rf"$1{mark}")

    def unescaped(self, text: str) -> str:
        if self.escape not in text:
            return text
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}?)", r"\1", text)


INSTRUCT = Template(
    roles={
        "system": Marks("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Marks("<s>[INST] ", " [/INST]"),
        "assistant": Marks(" ", " </s>", loss=True),
    },
    moves={
        ("start", "system"): "told",
        ("start", "user"): "asked",
        ("told", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    ends=frozenset({"start", "answered"}),
    start="start",
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
)


def format_turns(df: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, turn, role, segments: an array of (text, loss) per turn, in reading order."""
    role = F.coalesce("role", F.lit(""))
    text = template.escaped(F.coalesce("text", F.lit("")))
    segment = lambda c, loss: F.struct(c.alias("text"), F.lit(loss).alias("loss"))
    first, middle, last = (F.lit(m) for m in template.other)
    named = F.concat(first, template.escaped(role), middle)
    made = F.array(segment(named, False), segment(text, False), segment(last, False))
    for name, m in template.roles.items():
        parts = [segment(F.lit(m.before), False), segment(text, m.loss), segment(F.lit(m.after), False)]
        made = F.when(role == name, F.array(*parts)).otherwise(made)
    return df.select("conv_id", "turn", role.alias("role"), made.alias("segments"))


def validate(df: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, n_turns, valid, wrong_turn: position of the first turn out of order, from 0.

    wrong_turn is n_turns where only the end is missing, null where valid.
    """
    number = {s: i for i, s in enumerate(template.states)}
    moves = {(number[s], r): number[to] for (s, r), to in template.moves.items()}
    lead = {r: number[template.after(r)] for r in {r for _, r in template.moves}}
    skinny = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    order = ["conv_id", "turn", "role"]
    id_type, turn_type = (dict(skinny.dtypes)[c] for c in order[:2])
    schema = f"conv_id {id_type}, turn {turn_type}, role string, n long, ends array<int>, wrong array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None

        def flushed():
            batch = pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows.clear()
            return batch

        for batch in batches:
            for key, turn, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now["conv_id"]:
                    now = {"conv_id": key, "turn": turn, "role": role, "n": 0}
                    now |= {"ends": [*range(len(number))], "wrong": [None] * len(number)}
                    rows.append(now)
                for i, state in enumerate(now["ends"]):
                    to = moves.get((state, role))
                    if to is None and now["wrong"][i] is None:
                        now["wrong"][i] = now["n"]
                    now["ends"][i] = lead.get(role, state) if to is None else to
                now["n"] += 1
            if len(rows) > 4096:
                last = rows.pop()
                yield flushed()
                rows.append(last)
        if rows:
            yield flushed()

    empty = df.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(empty.schema)
    runs = skinny.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    parts = runs.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "n", "ends", "wrong"))).alias("parts")
    )
    begin = F.struct(
        F.lit(number[template.start]).alias("state"),
        F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("long").alias("wrong"),
    )

    def chain(have: Column, part: Column) -> Column:
        wrong = F.coalesce(have["wrong"], have["n"] + F.get(part["wrong"], have["state"]))
        return F.struct(
            F.get(part["ends"], have["state"]).alias("state"),
            (have["n"] + part["n"]).alias("n"),
            wrong.alias("wrong"),
        )

    done = parts.select("conv_id", F.aggregate("parts", begin, chain).alias("m"))
    ends = [number[s] for s in template.states if s in template.ends]
    wrong = F.coalesce("m.wrong", F.when(~F.col("m.state").isin(ends), F.col("m.n")))
    return done.select(
        "conv_id", F.col("m.n").alias("n_turns"), wrong.isNull().alias("valid"), wrong.alias("wrong_turn")
    )


class Reader:
    """Turns of one conversation from its segments, as they come in."""

    def __init__(self, template: Template):
        self.template, self.text, self.flags, self.position = template, "", [], 0
        self.frames = [(m.before, m.after, role) for role, m in template.roles.items()]
        self.frames.append((template.other[0], template.other[2], None))

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str, int]]:
        """(role, text, text under the loss mask, formatted length) of each turn that ends here."""
        if loss and text:
            self.flags.append((len(self.text), len(self.text) + len(text)))
        self.text += text
        while found := self._turn():
            yield found

    def _turn(self) -> tuple[str, str, str, int] | None:
        for before, after, role in self.frames:
            if self.text.startswith(before):
                end = self.text.find(after, len(before))
                if end < 0:
                    return None
                whole, start = self.text, len(before)
                if role is None:
                    middle = whole.index(self.template.other[1], start)
                    role = self.template.unescaped(whole[start:middle])
                    start = middle + len(self.template.other[1])
                after_end = end + len(after)
                masked = "".join(whole[a:b] for a, b in self.flags if b <= after_end)
                self.text = whole[after_end:]
                self.flags = [(a - after_end, b - after_end) for a, b in self.flags if b > after_end]
                un = self.template.unescaped
                return role, un(whole[start:end]), un(masked), after_end
        return None


def _conversations(df: DataFrame) -> DataFrame:
    """Segments with every conversation's turns in order, in one task."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segments")


def read_turns(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, position, role, text, trained, chars: turns parsed from the formatted text."""
    id_type = dict(segments.dtypes)["conv_id"]
    schema = f"conv_id {id_type}, position long, role string, text string, trained string, chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _read(batches, template):
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["conv_id", "position", "role", "text", "trained", "chars"],
                )

    id_arrow = to_arrow_type(segments.schema["conv_id"].dataType)
    types = [id_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return _conversations(segments).select("conv_id", "segments").mapInArrow(run, schema)


def _read(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[list[tuple]]:
    """Turns per batch, each after key and position; a conversation that breaks off raises."""
    key, reader = None, None
    for batch in batches:
        rows = []
        for k, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if reader is None or k != key:
                _ended(reader, key)
                key, reader = k, Reader(template)
            for part in parts:
                for turn in reader.feed(part["text"], part["loss"]):
                    rows.append((key, reader.position, *turn))
                    reader.position += 1
        yield rows
    _ended(reader, key)


def _ended(reader: Reader | None, key) -> None:
    if reader is not None and reader.text:
        raise ValueError(f"conversation {key} ends within a turn")


def digest(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, from its formatted text alone: turns, hashes and lengths.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end, per turn), loss_chars and
    loss_sha256 (of the text under the loss mask, unescaped) and formatted_chars. A hash is
    sequential: one task reads a conversation, but holds one turn of it.
    """
    id_type = dict(segments.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [id_type, "long", "string", "long", "string", "long"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    types = [to_arrow_type(segments.schema["conv_id"].dataType)]
    types += [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def ended():
            key, n, turns, trained, loss, size = now
            done.append((key, n, turns.hexdigest(), trained, loss.hexdigest(), size))

        def batch_of():
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
            )

        for rows in _read(batches, template):
            for key, position, role, text, trained, chars in rows:
                if position == 0:
                    if now:
                        ended()
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(trained)
                now[4].update(trained.encode())
                now[5] += chars
            if done:
                yield batch_of()
        if now:
            ended()
            yield batch_of()

    return _conversations(segments).select("conv_id", "segments").mapInArrow(run, schema)
