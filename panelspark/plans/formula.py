"""Formulas: a small language for responses, regressors, absorbed effects and instruments.

    y ~ x1 + x2 + fe(g) + fe(g)&fe(h) + fe(g)&x3 + log(x4) + a*b + (endo ~ inst)

Text is parsed into terms; terms can also be built in Python with var(), fe(), fn() and the operators +, & and *.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"


class FormulaError(ValueError):
    """A formula that cannot be read or has no meaning."""


# ---- terms ----------------------------------------------------------------------------------------------------


class Term:
    """Sums of interactions. + joins sums, & interacts, * is both with all main effects."""

    def parts(self) -> list[tuple]:
        """The interactions of a sum, each a tuple of factors; () is the intercept."""
        return [(self,)]

    def __add__(self, other) -> Sum:
        return Sum([*self.parts(), *_term(other).parts()])

    __radd__ = lambda self, other: _term(other) + self if other != 0 else Sum(self.parts())

    def __and__(self, other) -> Sum:
        return Sum([_cross(a, b) for a in self.parts() for b in _term(other).parts()])

    def __mul__(self, other) -> Sum:
        return self + other + (self & other)


def _cross(a: tuple, b: tuple) -> tuple:
    return a + tuple(x for x in b if x not in a)


@dataclass(frozen=True, eq=True)
class Sum(Term):
    items: list = field(default_factory=list)

    def parts(self) -> list[tuple]:
        return list(self.items)


@dataclass(frozen=True)
class Constant(Term):
    value: int


@dataclass(frozen=True)
class Var(Term):
    name: str

    def column(self, functions: dict) -> Column:
        return F.col(f"`{self.name}`")

    def variables(self) -> list[str]:
        return [self.name]

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Fn(Term):
    """A function of columns, by name or as a Python callable on columns."""

    name: str
    args: tuple
    call: Callable | None = None

    def column(self, functions: dict) -> Column:
        values = [a.column(functions) if isinstance(a, (Var, Fn)) else F.lit(float(a)) for a in self.args]
        if self.call is not None:
            return self.call(*values)
        known = {**FUNCTIONS, **functions}
        if self.name not in known:
            raise FormulaError(f"unknown function {self.name}; pass it in functions={{...}}")
        return known[self.name](*values)

    def variables(self) -> list[str]:
        return [v for a in self.args if isinstance(a, (Var, Fn)) for v in a.variables()]

    def __str__(self) -> str:
        if self.name in "+-*/^" and len(self.args) == 2:
            return f"{self.args[0]} {self.name} {self.args[1]}"
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Fe(Term):
    """A marker: the levels of a column are absorbed."""

    name: str

    def variables(self) -> list[str]:
        return [self.name]

    def __str__(self) -> str:
        return f"fe({self.name})"


@dataclass(frozen=True)
class Iv(Term):
    endo: tuple
    inst: tuple


def var(name: str) -> Var:
    return Var(name)


def fe(name: str | Var) -> Fe:
    return Fe(name.name if isinstance(name, Var) else name)


def fn(call: Callable, *names: str, name: str | None = None) -> Fn:
    """A term from a Python function of columns."""
    return Fn(name or getattr(call, "__name__", "f"), tuple(Var(n) for n in names), call)


def iv(endo, inst) -> Iv:
    return Iv(tuple(_term(endo).parts()), tuple(_term(inst).parts()))


def _term(x) -> Term:
    if isinstance(x, Term):
        return x
    if isinstance(x, int):
        return Constant(x)
    if isinstance(x, str):
        return Var(x)
    raise FormulaError(f"not a term: {x!r}")


def _ln(base: Callable) -> Callable:
    # the logarithm of zero is minus infinity and of less is no number, as in floating point; not null
    return lambda x: F.when(x > 0, base(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(x)


#: Functions that a formula's text may name.
FUNCTIONS: dict[str, Callable] = {
    "log": _ln(F.log),
    "log2": _ln(F.log2),
    "log10": _ln(F.log10),
    "log1p": lambda x: _ln(F.log)(x + 1),
    "exp": F.exp,
    "expm1": F.expm1,
    "sqrt": F.sqrt,
    "abs": F.abs,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "tanh": F.tanh,
    "sign": F.signum,
    "floor": F.floor,
    "ceil": F.ceil,
    "+": lambda *x: x[0] + x[1] if len(x) == 2 else x[0],
    "-": lambda *x: x[0] - x[1] if len(x) == 2 else -x[0],
    "*": lambda x, y: x * y,
    "/": lambda x, y: F.when(y != 0, x / y).otherwise(F.when(x == 0, F.lit(float("nan"))).otherwise(x * float("inf"))),
    "^": lambda x, y: F.pow(x, y),
}


# ---- text -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*)|`(?P<quoted>[^`]+)`|(?P<sign>[~+&*()^,/-]))")


class _Parser:
    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(f"cannot read {text[at:]!r}")
            self.items.append(next((k, v) for k, v in m.groupdict().items() if v is not None))
            at = m.end()
        self.items.append(("end", ""))
        self.at = 0

    @property
    def next(self) -> str:
        kind, value = self.items[self.at]
        return value if kind == "sign" else ""

    def take(self, sign: str | None = None) -> tuple[str, str]:
        item = self.items[self.at]
        if sign is not None and item != ("sign", sign):
            raise FormulaError(f"expected {sign!r}, found {item[1]!r}")
        self.at += 1
        return item

    # terms, loosest first
    def sum(self) -> Term:
        out = self.product()
        while self.next in ("+", "-") and self.next:
            if self.take()[1] == "-":
                other = self.product()
                if isinstance(other, Constant) and other.value == 1:
                    out = out + Constant(0)
                else:
                    drop = other.parts()
                    out = Sum([p for p in out.parts() if set(p) not in map(set, drop)])
            else:
                out = out + self.product()
        return out

    def product(self) -> Term:
        out = self.interaction()
        while self.next == "*":
            self.take()
            out = out * self.interaction()
        return out

    def interaction(self) -> Term:
        out = self.factor()
        while self.next == "&":
            self.take()
            out = out & self.factor()
        return out

    def factor(self) -> Term:
        if self.next == "(":
            self.take()
            inner = self.sum()
            if self.next == "~":
                self.take()
                inner = iv(inner, self.sum())
            self.take(")")
            return inner
        kind, value = self.take()
        if kind == "number":
            if value not in ("0", "1"):
                raise FormulaError(f"a formula's constants are 0 and 1, not {value}")
            return Constant(int(value))
        if kind not in ("name", "quoted"):
            raise FormulaError(f"unexpected {value or 'end'!r}")
        out: Term = Var(value)
        if kind == "name" and self.next == "(":
            if value == "fe":
                self.take("(")
                inside = self.take()[1]
                self.take(")")
                return Fe(inside)
            out = self.call(value)
        if self.next in ("^", "/"):
            out = Fn(self.take()[1], (out, self.power()))
        return out

    # plain arithmetic, inside calls
    def call(self, name: str) -> Fn:
        self.take("(")
        args = [self.arithmetic()]
        while self.next == ",":
            self.take()
            args.append(self.arithmetic())
        self.take(")")
        return Fn(name, tuple(args))

    def arithmetic(self):
        out = self.scaled()
        while self.next in ("+", "-") and self.next:
            out = Fn(self.take()[1], (out, self.scaled()))
        return out

    def scaled(self):
        out = self.power()
        while self.next in ("*", "/") and self.next:
            out = Fn(self.take()[1], (out, self.power()))
        return out

    def power(self):
        if self.next == "-":
            self.take()
            return Fn("-", (self.power(),))
        if self.next == "(":
            self.take()
            out = self.arithmetic()
            self.take(")")
        else:
            kind, value = self.take()
            if kind == "number":
                out = float(value) if "." in value or "e" in value.lower() else int(value)
            elif kind == "name" and self.next == "(":
                out = self.call(value)
            elif kind in ("name", "quoted"):
                out = Var(value)
            else:
                raise FormulaError(f"unexpected {value or 'end'!r}")
        return Fn("^", (out, self.power())) if self.next == "^" and self.take() else out


# ---- formulas -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Effect:
    """One set of absorbed effects: the key columns, and the factors whose product multiplies them (none: levels)."""

    keys: tuple[str, ...]
    slope: tuple = ()

    @property
    def name(self) -> str:
        return "&".join([*(f"fe_{k}" for k in self.keys), *map(str, self.slope)])

    def variables(self) -> list[str]:
        return [*self.keys, *(v for s in self.slope for v in s.variables())]


@dataclass(frozen=True)
class Formula:
    responses: tuple
    exogenous: tuple
    endogenous: tuple
    instruments: tuple
    effects: tuple[Effect, ...]
    intercept: bool
    text: str

    @property
    def has_iv(self) -> bool:
        return bool(self.endogenous)

    @property
    def has_fe(self) -> bool:
        return bool(self.effects)

    @property
    def absorbs_intercept(self) -> bool:
        return any(not e.slope for e in self.effects)

    def variables(self) -> list[str]:
        terms = [*((r,) for r in self.responses), *self.exogenous, *self.endogenous, *self.instruments]
        names = [v for t in terms for f in t for v in f.variables()] + [v for e in self.effects for v in e.variables()]
        return list(dict.fromkeys(names))

    def __str__(self) -> str:
        return self.text


def has_iv(formula) -> bool:
    return parse(formula).has_iv


def has_fe(formula) -> bool:
    return parse(formula).has_fe


def parse_fixed_effects(formula) -> tuple[list[Effect], list[str], list[str]]:
    """The absorbed effects of a formula, their names and their key columns; for use by other packages."""
    f = parse(formula)
    return list(f.effects), [e.name for e in f.effects], list(dict.fromkeys(k for e in f.effects for k in e.keys))


def _once(parts: list[tuple]) -> list[tuple]:
    """Interactions without repeats, main effects before interactions, else in order."""
    seen, out = set(), []
    for p in parts:
        if frozenset(p) not in seen:
            seen.add(frozenset(p))
            out.append(p)
    return sorted(out, key=len)


def formula(response, terms) -> Formula:
    """A formula from terms built in Python."""
    lhs = _term(response).parts()
    if not lhs or any(len(p) != 1 or not isinstance(p[0], (Var, Fn)) for p in lhs):
        raise FormulaError("a response is a column or a function of columns")
    plain, blocks, effects, intercept = [], [], [], None
    for part in _term(terms).parts():
        if any(isinstance(x, Iv) for x in part):
            if len(part) > 1:
                raise FormulaError("an instrument block cannot be interacted")
            blocks.append(part[0])
        elif any(isinstance(x, Fe) for x in part):
            e = Effect(tuple(x.name for x in part if isinstance(x, Fe)), tuple(x for x in part if not isinstance(x, (Fe, Constant))))
            if not any(set(e.keys) == set(o.keys) and set(e.slope) == set(o.slope) for o in effects):
                effects.append(e)
        elif part == () or isinstance(part[0], Constant):
            if len(part) > 1:
                raise FormulaError("a constant cannot be interacted")
            intercept = part == () or part[0].value == 1
        else:
            plain.append(part)
    if len(blocks) > 1:
        raise FormulaError("a formula has one instrument block at most")
    endo, inst = (list(blocks[0].endo), list(blocks[0].inst)) if blocks else ([], [])
    both = [p for p in endo if frozenset(p) in {frozenset(q) for q in inst}]
    if blocks:
        plain += both
        endo, inst = ([p for p in x if p not in both and not isinstance(p[0], Constant)] for x in (endo, [q for q in inst if frozenset(q) not in {frozenset(b) for b in both}]))
        if not endo:
            raise FormulaError("no endogenous variable is left in the instrument block")
        if len(inst) < len(endo):
            raise FormulaError(f"not identified: {len(endo)} endogenous terms need as many instruments, there are {len(inst)}")
    f = Formula(tuple(p[0] for p in lhs), tuple(_once(plain)), tuple(_once(endo)), tuple(_once(inst)), tuple(effects), True if intercept is None else intercept, "")
    object.__setattr__(f, "text", _text(f, intercept))
    return f


def _text(f: Formula, intercept: bool | None) -> str:
    show = lambda parts: " + ".join("&".join(map(str, p)) for p in parts)
    right = ([] if intercept is None else [str(int(intercept))]) + ([show(f.exogenous)] if f.exogenous else [])
    right += ["&".join([*(f"fe({k})" for k in e.keys), *map(str, e.slope)]) for e in f.effects]
    right += [f"({show(f.endogenous)} ~ {show(f.instruments)})"] if f.endogenous else []
    return f"{' + '.join(map(str, f.responses))} ~ {' + '.join(right) or '1'}"


def parse(text) -> Formula:
    """Reads a formula; a Formula passes through."""
    if isinstance(text, Formula):
        return text
    p = _Parser(text)
    left = p.sum()
    p.take("~")
    out = formula(left, p.sum())
    if p.items[p.at][0] != "end":
        raise FormulaError(f"unexpected {p.items[p.at][1]!r}")
    object.__setattr__(out, "text", " ".join(text.split()))
    return out
