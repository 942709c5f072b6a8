"""The answer grammar: its rules, a transition table compiled from them, and the fold of a text over that table.

Rules are compiled once, on the driver, to a small deterministic table over the atoms that the rules' literals are made of.  A text is cut
into the same atoms and folded over the table by ``aggregate``: one lookup an atom, no Python and no backtracking.  A state knows which rules
are open in it, so the place where a text leaves the grammar comes with the stack of rules there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The grammar in GBNF.
RULES = r'''root ::= think answer
think ::= "<think>\n" register_sequence "\n</think>"
register_sequence ::= bypass_branch | reasoning_branch
bypass_branch ::= "<reg:bypass>" [^<]+ "</reg:bypass>"
reasoning_branch ::= plan_block "\n" deduce_block ( "\n" verify_block )?
plan_block ::= "<reg:plan>" [^<]+ "</reg:plan>"
deduce_block ::= "<reg:deduce>" [^<]+ "</reg:deduce>"
verify_block ::= "<reg:verify>" [^<]+ "</reg:verify>"
answer ::= "\n<ans>" [^<]+ "</ans>"
'''
#: Atoms of a text: tags, line feeds, a stray ``<``, and runs of anything else.
ATOM = r"</?[a-z]+(?::[a-z]+)?>|\n|<|[^<\n]+"
_WORD = re.compile(r'\s*(?:(?P<name>[a-z_]+)|"(?P<text>(?:[^"\\]|\\.)*)"|\[\^(?P<but>[^\]]+)\]|(?P<mark>[()|?*+]))')
_OTHER = "other"


@dataclass(frozen=True)
class Table:
    """``atoms`` are numbered from 1 (0: any other run); ``go[state * width + atom]`` is the next state, -1 for none; ``open`` are the rules open in a state."""

    atoms: tuple[str, ...]
    go: tuple[int, ...]
    accepting: tuple[bool, ...]
    open: tuple[tuple[str, ...], ...]

    @property
    def width(self) -> int:
        return len(self.atoms) + 1


class _Net:
    """A nondeterministic net: steps (from, atom or None for free, to); every place has the stack of rules that it is in."""

    def __init__(self, rules: dict[str, list], atoms: list[str]):
        self.rules, self.atoms, self.steps, self.stacks = rules, atoms, [], []

    def place(self, stack: tuple[str, ...]) -> int:
        self.stacks.append(stack)
        return len(self.stacks) - 1

    def step(self, a: int, atom: str | None, b: int) -> None:
        self.steps.append((a, atom, b))

    def build(self, node, a: int, b: int, stack: tuple[str, ...]) -> None:
        """Lay ``node`` between the places ``a`` and ``b``."""
        kind, value = node
        if kind == "rule":
            if value in stack:
                raise ValueError(f"rule {value} is open already: a nested grammar has no finite table")
            inner = stack + (value,)
            c, d = self.place(inner), self.place(inner)
            self.step(a, None, c)
            self.step(d, None, b)
            self.build(self.rules[value], c, d, inner)
        elif kind == "text":
            for atom in value[:-1]:
                c = self.place(stack)
                self.step(a, atom, c)
                a = c
            self.step(a, value[-1], b)
        elif kind == "but":
            for atom in [_OTHER, *self.atoms]:
                if not set(atom) & set(value) or atom == _OTHER:
                    self.step(a, atom, b)
        elif kind == "all":
            for part in value[:-1]:
                c = self.place(stack)
                self.build(part, a, c, stack)
                a = c
            self.build(value[-1], a, b, stack)
        elif kind == "any":
            for part in value:
                self.build(part, a, b, stack)
        else:  # a mark behind its part
            c, d = self.place(stack), self.place(stack)
            self.step(a, None, c)
            self.step(d, None, b)
            self.build(value, c, d, stack)
            if kind in "?*":
                self.step(c, None, d)
            if kind in "*+":
                self.step(d, None, c)


def _read(body: str):
    """The tree of a rule's body: alternatives of sequences of parts."""
    words, at = [m for m in _WORD.finditer(body)], 0

    def alternatives():
        nonlocal at
        found = [sequence()]
        while at < len(words) and words[at]["mark"] == "|":
            at += 1
            found.append(sequence())
        return found[0] if len(found) == 1 else ("any", found)

    def sequence():
        nonlocal at
        parts = []
        while at < len(words) and words[at]["mark"] not in (")", "|"):
            word = words[at]
            at += 1
            if word["name"]:
                parts.append(("rule", word["name"]))
            elif word["text"] is not None:
                parts.append(("text", re.findall(ATOM, word["text"].replace(r"\n", "\n"))))
            elif word["but"]:
                parts.append(("but", word["but"]))
            elif word["mark"] == "(":
                parts.append(alternatives())
                at += 1
            else:
                parts.append((word["mark"], parts.pop()))
        return parts[0] if len(parts) == 1 else ("all", parts)

    return alternatives()


@lru_cache
def compile_rules(rules: str = RULES, root: str = "root") -> Table:
    """The deterministic table of ``rules``; rules may not contain themselves."""
    bodies = dict(line.split(" ::= ", 1) for line in rules.splitlines() if " ::= " in line)
    trees = {name: _read(body) for name, body in bodies.items()}
    atoms = sorted({a for body in bodies.values() for m in _WORD.finditer(body) if m["text"] is not None for a in re.findall(ATOM, m["text"].replace(r"\n", "\n"))})
    net = _Net(trees, atoms)
    begin, end = net.place(()), net.place(())
    net.build(("rule", root), begin, end, ())

    def reach(places: frozenset[int]) -> frozenset[int]:
        seen, todo = set(places), list(places)
        while todo:
            p = todo.pop()
            for a, atom, b in net.steps:
                if a == p and atom is None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    def shared(places: frozenset[int]) -> tuple[str, ...]:
        """The rules open in all places that can go on; where none can, in none."""
        stacks = [net.stacks[p] for p in places if any(a == p and atom is not None for a, atom, _ in net.steps)]
        out = []
        for level in zip(*stacks):
            if len(set(level)) > 1:
                break
            out.append(level[0])
        return tuple(out)

    states, go = [reach(frozenset([begin]))], []
    for state in states:
        for atom in (_OTHER, *atoms):
            to = reach(frozenset(b for a, on, b in net.steps if a in state and on == atom))
            if to and to not in states:
                states.append(to)
            go.append(states.index(to) if to else -1)
    return Table(tuple(atoms), tuple(go), tuple(end in s for s in states), tuple(map(shared, states)))


def fold_states(text: Column, table: Table | None = None) -> Column:
    """struct(state, read, stuck) of a text: the last state reached, the letters read up to there, and whether text was left over."""
    table = table or compile_rules()
    go, atoms = F.lit(list(table.go)), F.lit(list(table.atoms))
    cut = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ATOM), F.lit(0))
    begin = F.struct(F.lit(0).alias("state"), F.lit(0).alias("read"), F.lit(False).alias("stuck"))

    def step(s: Column, atom: Column) -> Column:
        number = F.when(F.length(atom) > 1, F.array_position(atoms, atom)).when(atom == "\n", F.array_position(atoms, atom)).otherwise(F.lit(0).cast("long"))
        # A stray "<" and a tag that no rule has are no atoms of a run.
        known = (number > 0) | ~F.startswith(atom, F.lit("<"))
        to = F.when(known & ~s["stuck"], F.element_at(go, (s["state"] * table.width + number + 1).cast("int"))).otherwise(F.lit(-1))
        moved = F.struct(to.alias("state"), (s["read"] + F.length(atom)).alias("read"), F.lit(False).alias("stuck"))
        return F.when(to >= 0, moved).otherwise(F.struct(s["state"].alias("state"), s["read"].alias("read"), F.lit(True).alias("stuck")))

    return F.aggregate(cut, begin, step)


def parsed(text: Column, table: Table | None = None) -> Column:
    """struct(accepted, read, open_rules, expects): whether the whole text is of the grammar; else how far it got, in which rules, and what could follow."""
    table = table or compile_rules()
    names = ["/".join(rules) for rules in table.open]
    awaited = [" ".join(["text"] * (row[0] >= 0) + [a.replace("\n", "\\n") for a, to in zip(table.atoms, row[1:]) if to >= 0]) for row in (table.go[k : k + table.width] for k in range(0, len(table.go), table.width))]
    of = lambda values, s: F.element_at(F.lit(values), s["state"] + 1)
    made = F.transform(F.array(fold_states(text, table)), lambda s: F.struct(
        (~s["stuck"] & of(list(table.accepting), s)).alias("accepted"), s["read"].alias("read"), of(names, s).alias("open_rules"), of(awaited, s).alias("expects"),
    ))
    return F.element_at(made, 1)


def export_rules(spark: SparkSession, path: str, rules: str = RULES) -> str:
    """Write the grammar as one text file ``path`` through Hadoop's file system, so any store will do; returns the text."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(rules.encode()))
    finally:
        out.close()
    return rules
