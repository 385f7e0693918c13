"""Array programs as DataFrame plans.

A program is text, a statement a line: func, arg, ret, var, op, const, fill, set, setb, call, call2, for, while, if, else, break,
return, fail, end, unmapped, reject. Its variables are tensor columns; a statement is a column step over all rows at once. Branches
become masks: both sides are planned and each row takes the side that its condition picks. Loops with constant bounds are
unrolled; others run as rounds over the rows still in the loop, with a hard cap. What can't be mapped is an outcome: a
function that was rejected gives status "rejected", one with unmapped lines "unmapped", and neither is guessed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import tensor as T
from loomspan.operators.graph import cut

UNROLL, ROUNDS, DEPTH = 512, 100_000, 64
CONDITIONS = {"gt": 0, "ge": 1, "lt": 2, "le": 3, "eq": 4, "ne": 5}


@dataclass
class Function:
    name: str
    args: list[str] = field(default_factory=list)
    rets: list[str] = field(default_factory=list)
    body: list[tuple] = field(default_factory=list)
    unmapped: list[str] = field(default_factory=list)
    reject: str = ""


def parse(text: str) -> dict[str, Function]:
    """Functions by name. A line that isn't known is an error, and so is a block that isn't closed."""
    found: dict[str, Function] = {}
    here: Function | None = None
    blocks: list[list[tuple]] = []
    open_blocks: list[tuple] = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#") or line.startswith("version"):
            continue
        word, _, rest = line.partition(":")
        rest, parts = rest.strip(), [p.strip() for p in rest.split(":")]
        if word == "func":
            here = found[rest] = Function(rest)
            blocks, open_blocks = [here.body], []
            continue
        if here is None:
            raise ValueError(f"line {number}: {word!r} before a function")
        if word in ("arg", "ret"):
            (here.args if word == "arg" else here.rets).append(parts[0])
        elif word == "var":
            pass
        elif word in ("for", "while", "if"):
            block: tuple = (word, parts, [], [])
            blocks[-1].append(block)
            open_blocks.append(block)
            blocks.append(block[2])
        elif word == "else":
            if not open_blocks or open_blocks[-1][0] != "if":
                raise ValueError(f"line {number}: else without if")
            blocks[-1] = open_blocks[-1][3]
        elif word == "end":
            if open_blocks:
                open_blocks.pop()
                blocks.pop()
        elif word in ("op", "const", "fill", "set", "setb", "call", "call2", "break", "return", "fail"):
            blocks[-1].append((word, parts))
        elif word == "unmapped":
            here.unmapped.append(rest)
        elif word == "reject":
            here.reject = rest
        else:
            raise ValueError(f"line {number}: unknown statement {word!r}")
        if word == "func" and open_blocks:
            raise ValueError(f"line {number}: a block isn't closed")
    if open_blocks:
        raise ValueError("a block isn't closed")
    return found


def _code(x: str) -> int:
    return CONDITIONS[x] if x in CONDITIONS else int(x)


class _Run:
    """One execution: the DataFrame so far, and where each variable is."""

    def __init__(self, df: DataFrame, functions: dict[str, Function]) -> None:
        self.df, self.functions, self.fresh, self.depth = df, functions, 0, 0

    def column(self, value: Column) -> str:
        self.fresh += 1
        name = f"__p{self.fresh}"
        self.df = self.df.withColumn(name, value)
        return name

    def value(self, env: dict[str, str], x: str) -> Column:
        if x in env:
            return F.col(env[x])
        try:
            return T.scalar(F.lit(float(x)))
        except ValueError:
            raise ValueError(f"{x!r} isn't a variable or a number") from None

    def number(self, env: dict[str, str], x: str) -> Column:
        return T.at(self.value(env, x)["data"], F.lit(0))

    def put(self, env: dict[str, str], name: str, value: Column, mask: str | None) -> None:
        if mask is not None:
            old = F.col(env[name]) if name in env else F.lit(None)
            value = F.when(F.col(mask), value).otherwise(old)
        env[name] = self.column(value)

    def condition(self, env: dict[str, str], parts: list[str]) -> Column:
        return T.ieee.COMPARE[_code(parts[1])](self.number(env, parts[0]), self.number(env, parts[2]))

    def operate(self, env: dict[str, str], op: str, args: list[str]) -> Column:
        if op not in T.CATALOGUE:
            raise ValueError(f"unknown operator {op}")
        v, n = (lambda i: self.value(env, args[i])), (lambda i: self.number(env, args[i]).cast("long"))
        f: dict[str, Callable[[], Column]] = {
            "OP-INDEX": lambda: T.index(v(0), n(1)), "OP-IDX2": lambda: T.idx2(v(0), n(1), n(2)), "OP-ROW": lambda: T.row(v(0), n(1)), "OP-COL": lambda: T.col(v(0), n(1)),
            "OP-SLICE": lambda: T.slice_(v(0), int(args[1]), int(args[2])), "OP-COLRANGE": lambda: T.colrange(v(0), int(args[1]), int(args[2])),
            "OP-MASK": lambda: T.mask(v(0), _code(args[1]), float(args[2])), "OP-FIND": lambda: T.find(v(0), _code(args[1]), float(args[2])),
            "OP-FIND2": lambda: T.find2(v(0), v(1), _code(args[2])), "OP-FIND3": lambda: T.find(v(0), _code(args[1]), float(args[2]), int(args[3])),
            "OP-FILLA": lambda: T.fill(float(args[0]), n(1), n(2)), "OP-RANGE": lambda: T.range_(n(0), n(1)), "OP-ISEQUALK": lambda: T.isequalk(v(0), float(args[1])),
            "OP-SIZE": lambda: T.size(v(0), int(args[1])) if len(args) > 1 else T.size_all(v(0)),
        }
        return f[op]() if op in f else T.CATALOGUE[op](*(v(i) for i in range(len(args))))

    def block(self, env: dict[str, str], body: list[tuple], mask: str | None, stop: list[str]) -> None:
        """stop: columns that are true where a row has left the block by break or return."""

        def live() -> str | None:
            gone = [~F.col(s) for s in stop]
            if not gone:
                return mask
            c = F.lit(True) if mask is None else F.col(mask)
            for g in gone:
                c = c & g
            return self.column(c)

        for s in body:
            word, p = s[0], s[1]
            on = live()
            if word == "op" and p[0] == "OP-SETIDX":
                self.put(env, p[1], T.setidx(F.col(env[p[1]]), self.number(env, p[3]).cast("long"), self.number(env, p[2])), on)
            elif word == "op" and p[0] == "OP-SETIDX2":
                self.put(env, p[1], T.setidx2(F.col(env[p[1]]), self.number(env, p[3]).cast("long"), self.number(env, p[4]).cast("long"), self.number(env, p[2])), on)
            elif word == "op":
                self.put(env, p[1], self.operate(env, p[0], [x for x in p[2:] if x]), on)
            elif word == "const":
                self.put(env, p[0], T.scalar(F.lit(float(p[1]))), on)
            elif word == "fill":
                shape = [int(x) for x in p[1].split(",")]
                self.put(env, p[0], T.fill(float(p[2]), *(shape if len(shape) == 2 else (1, shape[0]))), on)
            elif word == "set":
                self.put(env, p[0], self.value(env, p[1]), on)
            elif word == "setb":
                f = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": T.ieee.ieee_div}[p[1]]
                self.put(env, p[0], T.scalar(f(self.number(env, p[2]), self.number(env, p[3]))), on)
            elif word in ("call", "call2"):
                names = [x.strip() for x in p[0].split(",")]
                for n, v in zip(names, self.call(p[1], [self.value(env, x) for x in p[2:] if x], on), strict=True):
                    self.put(env, n, F.col(v), on)
            elif word == "if":
                yes = self.condition(env, p)
                base = F.lit(True) if on is None else F.col(on)
                then_mask, else_mask = self.column(base & F.coalesce(yes, F.lit(False))), self.column(base & ~F.coalesce(yes, F.lit(False)))
                self.block(env, s[2], then_mask, stop)
                self.block(env, s[3], else_mask, stop)
            elif word in ("for", "while"):
                self.loop(env, word, p, s[2], on, stop)
            elif word in ("break", "return"):
                at = stop[-1] if word == "break" else stop[0]
                stop[stop.index(at)] = self.column(F.col(at) | (F.lit(True) if on is None else F.col(on)))
            elif word == "fail":
                self.put(env, "__fail", F.when(F.lit(True), F.raise_error(F.lit(":".join(p) or "fail"))).otherwise(F.lit(None)).cast("string"), on)

    def loop(self, env: dict[str, str], word: str, p: list[str], body: list[tuple], mask: str | None, stop: list[str]) -> None:
        stop.append(self.column(F.lit(False)))
        constant = word == "for" and all(x.lstrip("-").isdigit() for x in p[1:3])
        if constant and int(p[2]) - int(p[1]) < UNROLL:
            for k in range(int(p[1]), int(p[2]) + 1):
                self.put(env, p[0], T.scalar(F.lit(float(k))), mask)
                self.block(env, body, mask, stop)
        else:
            if word == "for":
                counter, last = self.column(self.number(env, p[1])), self.column(self.number(env, p[2]))
            for rounds in range(ROUNDS + 1):
                going = F.col(counter) <= F.col(last) if word == "for" else F.coalesce(self.condition(env, p), F.lit(False))
                going = going & ~F.col(stop[-1]) & ~F.col(stop[0]) & (F.lit(True) if mask is None else F.col(mask))
                on = self.column(going)
                self.df = cut(self.df)
                if self.df.where(F.col(on)).isEmpty():
                    break
                if rounds == ROUNDS:
                    raise RuntimeError(f"a loop took more than {ROUNDS} rounds")
                if word == "for":
                    self.put(env, p[0], T.scalar(F.col(counter)), on)
                self.block(env, body, on, stop)
                if word == "for":
                    counter = self.column(F.col(counter) + 1)
        stop.pop()

    def call(self, name: str, args: list[Column], mask: str | None) -> list[str]:
        f = self.functions.get(name)
        if f is None or f.reject or f.unmapped:
            raise ValueError(f"{name} can't be called")
        if self.depth >= DEPTH:
            raise ValueError("calls are nested too deeply")
        if len(args) != len(f.args):
            raise ValueError(f"{name} takes {len(f.args)} arguments")
        self.depth += 1
        env = {a: self.column(v) for a, v in zip(f.args, args, strict=True)}
        self.block(env, f.body, mask, [self.column(F.lit(False))])
        self.depth -= 1
        return [env[r] for r in f.rets]


def run(df: DataFrame, functions: dict[str, Function], name: str, **args: Column) -> DataFrame:
    """df with a tensor column for each result of the function, and status: ok, rejected or unmapped."""
    f = functions[name]
    status = "rejected" if f.reject else "unmapped" if f.unmapped else "ok"
    if status != "ok":
        none = F.lit(None).cast("struct<rows:bigint,cols:bigint,data:array<double>>")
        return df.withColumns({**dict.fromkeys(f.rets, none), "status": F.lit(status)})
    r = _Run(df, functions)
    out = r.call(name, [args[a] for a in f.args], None)
    named = [F.col(v).alias(x) for x, v in zip(f.rets, out, strict=True)]
    return r.df.select(*df.columns, *named, F.lit("ok").alias("status"))


def census(functions: dict[str, Function]) -> dict[str, int]:
    """How often each operator and each kind of unmapped line occurs."""
    n: dict[str, int] = {}

    def walk(body: list[tuple]) -> None:
        for s in body:
            if s[0] == "op":
                n[s[1][0]] = n.get(s[1][0], 0) + 1
            for inner in s[2:]:
                walk(inner)

    for f in functions.values():
        walk(f.body)
        for u in f.unmapped:
            n[f"unmapped {u.split(':')[0]}"] = n.get(f"unmapped {u.split(':')[0]}", 0) + 1
    return n
