"""Tables read as sheets: column i of the table is column i of the sheet, row 1 is the header, blank is null.

Formulas over ranges of such sheets compile to one aggregate per table; formulas over one row,
written as for row 2 of the sheet, compile to columns. Nothing is collected. Ranges of all rows
(``range_of`` writes them) need no row numbers. Others, single cells, criteria whose targets lie
in other rows or tables, and rows that look at rows beside them need the order of the table's
rows: columns that are unique together. Rows are numbered within ranges of sampled bounds then, and rows
of two places meet in an equi-join of row numbers. Cells right of or below a table are blank.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import formula as f
from gridloom.functions.cells import ROWS, column_letters
from gridloom.functions.criteria import criterion
from gridloom.functions.values import CellError
from gridloom.operators.windowing import row_index
from gridloom.plans.evaluate import AGGREGATES, ARITY, Evaluator, made

NUM, STR, BOOL, BLANK = "n", "s", "b", "blank"


@dataclass(frozen=True)
class Value:
    """A compiled expression: its static type, the value (null: blank) and the error code (null: none)."""

    kind: str
    value: Column
    error: Column


def none() -> Column:
    return F.lit(None).cast("string")


def range_of(df: DataFrame, column: str) -> str:
    """The range of all rows of a column, in the notation of formulas."""
    letters = column_letters(df.columns.index(column))
    return f"{letters}2:{letters}{ROWS}"


def kind_of(data_type: T.DataType) -> str:
    return BOOL if isinstance(data_type, T.BooleanType) else NUM if isinstance(data_type, T.NumericType) else STR


def literal(value) -> Value:
    if isinstance(value, bool):
        return Value(BOOL, F.lit(value), none())
    if isinstance(value, (int, float)):
        return Value(NUM, F.lit(float(value)), none())
    return Value(STR, F.lit(value), none()) if value is not None else Value(BLANK, none(), none())


def parsed(text: Column) -> Column:
    """The number that a text spells; null where it spells none."""
    trimmed = F.trim(text)
    return F.when(trimmed == "", F.lit(0.0)).when(trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), trimmed.try_cast("double"))


def as_number(x: Value) -> Value:
    if x.kind == NUM:
        return Value(NUM, F.coalesce(x.value, F.lit(0.0)), x.error)
    if x.kind == BOOL:
        return Value(NUM, F.coalesce(x.value.cast("double"), F.lit(0.0)), x.error)
    if x.kind == BLANK:
        return Value(NUM, F.lit(0.0), x.error)
    value = F.when(x.value.isNull(), F.lit(0.0)).otherwise(parsed(x.value))
    return Value(NUM, value, F.coalesce(x.error, F.when(value.isNull(), F.lit("#VALUE!"))))


def number_text(x: Column) -> Column:
    """Shortest digits without a needless point; exponents from 1e21 and below 1e-6."""
    # bound to names, as what stands for x and its digits is used many times over
    named = lambda value, make: F.element_at(F.transform(F.array(value), make), 1)
    return named(x, lambda v: named(F.lower(F.abs(v).cast("string")), lambda shown: _number_text(v, shown)))


def _number_text(x: Column, shown: Column) -> Column:
    whole = F.regexp_replace(shown, r"\.0$", "")
    parts = F.split(shown, "e")
    power = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.replace(F.element_at(parts, 1), F.lit("."), F.lit("")), "0+$", "")
    padded = F.rpad(digits, F.greatest(F.length(digits), power + 1), "0")
    large = F.concat(F.substring(padded, F.lit(1), power + 1), F.when(F.length(padded) > power + 1, F.concat(F.lit("."), F.substring(padded, power + 2, F.length(padded)))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
    spelled = F.when(~shown.contains("e"), whole).when(power > 0, large).otherwise(small)
    powers = F.regexp_replace(F.regexp_replace(shown, r"\.0e", "e"), r"e([0-9])", "e+$1")
    size = F.abs(x)
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.when((size < 1e21) & (size >= 1e-6), spelled).otherwise(powers)))


def as_text(x: Value) -> Value:
    shown = {NUM: lambda: number_text(x.value), BOOL: lambda: F.upper(x.value.cast("string")), STR: lambda: x.value, BLANK: none}[x.kind]()
    return Value(STR, F.coalesce(shown, F.lit("")), x.error)


def compared(x: Value, y: Value, operator: str) -> Value:
    error = F.coalesce(x.error, y.error)
    pick = lambda a, b: {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[operator]
    if x.kind == STR and y.kind == STR:
        return Value(BOOL, pick(F.lower(F.coalesce(x.value, F.lit(""))), F.lower(F.coalesce(y.value, F.lit("")))), error)
    if STR in (x.kind, y.kind):
        text, other = (x, y) if x.kind == STR else (y, x)
        if other.kind == BLANK:
            return compared(Value(STR, x.value, x.error), Value(STR, y.value, y.error), operator)
        if operator in ("=", "<>"):  # never equal across types, but for blanks
            same = (text.value.isNull() & (as_number(other).value == 0)) | (other.value.isNull() & (F.coalesce(text.value, F.lit("")) == ""))
            return Value(BOOL, same if operator == "=" else ~same, error)
        number = lambda v: F.coalesce(parsed(v.value), F.when(v.value.isNull(), F.lit(0.0)), F.lit(float("nan"))) if v.kind == STR else as_number(v).value
        a, b = number(x), number(y)
        return Value(BOOL, pick(a, b) & ~F.isnan(a) & ~F.isnan(b), error)
    if operator in ("=", "<>") and {x.kind, y.kind} == {NUM, BOOL}:
        same = (x.value.isNull() | y.value.isNull()) & (as_number(x).value == as_number(y).value)
        return Value(BOOL, same if operator == "=" else ~same, error)
    return Value(BOOL, pick(as_number(x).value, as_number(y).value), error)


def truth(x: Value) -> Column:
    if x.kind == STR:
        return F.coalesce(x.value != "", F.lit(False))
    return F.coalesce(x.value if x.kind == BOOL else as_number(x).value != 0, F.lit(False))


def unified(parts: list[Value]) -> list[Value]:
    """Branches of one type: as they are, or as texts where types differ."""
    kinds = {p.kind for p in parts} - {BLANK}
    if len(kinds) <= 1:
        kind = kinds.pop() if kinds else BLANK
        to = {NUM: "double", BOOL: "boolean"}.get(kind, "string")
        return [Value(kind, p.value.cast(to), p.error) for p in parts]
    return [as_text(p) for p in parts]


def guarded(value: Column, error: Column, code: str = "#NUM!") -> Value:
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return Value(NUM, F.when(error.isNull() & ~bad, value), F.coalesce(error, F.when(bad, F.lit(code))))


def calculated(operator: str, x: Value, y: Value) -> Value:
    x, y = as_number(x), as_number(y)
    error = F.coalesce(x.error, y.error)
    if operator == "/":
        return guarded(F.try_divide(x.value, y.value), F.coalesce(error, F.when(y.value == 0, F.lit("#DIV/0!"))))
    return guarded({"+": x.value + y.value, "-": x.value - y.value, "*": x.value * y.value, "^": F.pow(x.value, y.value)}[operator], error)


def _floor(x: Column) -> Column:
    return F.when(F.abs(x) >= 2.0**53, x).otherwise(F.floor(x).cast("double"))


def _rounded(x: Value, n: Value) -> Value:
    scale = F.pow(F.lit(10.0), n.value.cast("long").cast("double"))
    size = F.abs(x.value) * scale
    return guarded(F.signum(x.value) * _floor(size + size * 4 * 2.0**-52 + 0.5) / scale, F.coalesce(x.error, n.error, F.when(F.abs(n.value) >= 309, F.lit("#NUM!"))))


def _modulo(x: Value, y: Value) -> Value:
    error = F.coalesce(x.error, y.error, F.when(y.value == 0, F.lit("#DIV/0!")))
    return Value(NUM, F.when(error.isNull(), x.value - y.value * _floor(F.try_divide(x.value, y.value))), error)


def _trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^[\\s\\x{FEFF}\\p{Z}]+|[\\s\\x{FEFF}\\p{Z}]+\\z", ""), " +", " ")


def _numeric(make):
    return lambda *xs: make(*map(as_number, xs))


def _textual(make, kind=STR):
    return lambda x: Value(kind, make(as_text(x).value), x.error)


FUNCTIONS = {
    "NOT": lambda x: Value(BOOL, ~truth(x), x.error),
    "LEN": _textual(lambda t: (F.octet_length(F.encode(t, "UTF-16LE")) / 2).cast("double"), NUM),
    "LOWER": _textual(F.lower),
    "UPPER": _textual(F.upper),
    "TRIM": _textual(_trim),
    "ABS": _numeric(lambda x: Value(NUM, F.abs(x.value), x.error)),
    "INT": _numeric(lambda x: Value(NUM, _floor(x.value), x.error)),
    "SQRT": _numeric(lambda x: guarded(F.sqrt(x.value), x.error)),
    "ROUND": _numeric(_rounded),
    "MOD": _numeric(_modulo),
    "POWER": _numeric(lambda x, y: guarded(F.pow(x.value, y.value), F.coalesce(x.error, y.error))),
}


def failed(code: str) -> Value:
    return Value(BLANK, none(), F.lit(code))


@dataclass
class _Work:
    """What one compilation asks of the tables: aggregates by table, tables whose rows are numbered, and rows of other places beside a table's own."""

    slots: dict[str, dict[str, Column]] = field(default_factory=dict)
    numbered: set[str] = field(default_factory=set)
    beside: dict[str, dict[tuple[str, int], str]] = field(default_factory=dict)

    def slot(self, table: str, column: Column) -> Column:
        name = f"a{sum(map(len, self.slots.values()))}"
        self.slots.setdefault(table, {})[name] = column
        return F.col(name)


class Sheets:
    """Tables by sheet name, the order of their rows, defined names, and the compilation of formulas over them."""

    def __init__(self, tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None, names: dict[str, str] | None = None):
        self.tables = {name.lower(): df for name, df in tables.items()}
        self.order = {name.lower(): columns for name, columns in (order or {}).items()}
        self.names = {name.lower(): text for name, text in (names or {}).items()}

    # -- places ---------------------------------------------------------------

    def table(self, node: f.Reference, home: str) -> str:
        name = (node.sheet or home).lower()
        if name not in self.tables:
            raise CellError("#REF!")
        return name

    def columns(self, node: f.Reference, table: str) -> list[T.StructField]:
        return self.tables[table].schema.fields[node.start[1] : node.end[1] + 1]

    def named(self, node):
        """A defined name's formula; other nodes as they are."""
        seen = 0
        while isinstance(node, f.Name):
            seen += 1
            if node.name.lower() not in self.names or seen > f.MAX_DEPTH:
                raise CellError("#NAME?")
            node = f.parse(self.names[node.name.lower()])
        return node

    def number(self, table: str, work: _Work) -> None:
        if table not in self.order:
            raise ValueError(f"the order of the rows of {table} is not known; ranges of all rows need none")
        work.numbered.add(table)

    def within(self, node: f.Reference, table: str, work: _Work) -> Column:
        """Whether a row lies in the range; the header, row 0, is no row of the table."""
        if node.start[0] <= 1 and node.end[0] == ROWS - 1:
            return F.lit(True)
        self.number(table, work)
        return F.col(_ROW).between(node.start[0], node.end[0])

    def aside(self, table: str, other: str, rows: int, work: _Work) -> str:
        """The prefix of the columns of ``other``, ``rows`` further down, beside the rows of ``table``; empty for the rows themselves."""
        if other == table and rows == 0:
            return ""
        self.number(table, work)
        self.number(other, work)
        known = work.beside.setdefault(table, {})
        return known.setdefault((other, rows), f"_{len(known)}_")

    def frame(self, table: str, work: _Work) -> DataFrame:
        """The table with what was asked for."""
        df = self.tables[table]
        if table not in work.numbered:
            return df
        df = row_index(df, *self.order[table], name=_ROW).withColumn(_ROW, F.col(_ROW) + 1)
        for (other, rows), prefix in work.beside.get(table, {}).items():
            there = row_index(self.tables[other], *self.order[other], name=_ROW)
            df = df.join(there.select((F.col(_ROW) + 1 - rows).alias(_ROW), *(F.col(f"`{c}`").alias(prefix + c) for c in self.tables[other].columns)), _ROW, "left")
        return df

    # -- expressions ----------------------------------------------------------

    def compiled(self, node, leaf) -> Value:
        """An expression; ``leaf`` compiles references and aggregates, and gives None for other calls."""
        again = lambda x: self.compiled(x, leaf)
        try:
            node = self.named(node)
            done = leaf(node)
        except CellError as error:
            return failed(error.code)
        if done is not None:
            return done
        match node:
            case f.Literal(value):
                return literal(value)
            case f.Error(code):
                return failed(code)
            case f.Unary(operator, operand):
                x = as_number(again(operand))
                return Value(NUM, -x.value if operator == "-" else x.value, x.error)
            case f.Percent(operand):
                x = as_number(again(operand))
                return Value(NUM, x.value / 100, x.error)
            case f.Binary("&", left, right):
                x, y = as_text(again(left)), as_text(again(right))
                return Value(STR, F.concat(x.value, y.value), F.coalesce(x.error, y.error))
            case f.Binary(operator, left, right):
                x, y = again(left), again(right)
                return compared(x, y, operator) if f.PRECEDENCE[operator] == 1 else calculated(operator, x, y)
        low, high = ARITY.get(node.name, (0, -1))
        if not low <= len(node.arguments) <= high:
            return failed("#VALUE!" if node.name in ARITY else "#NAME?")
        parts = list(map(again, node.arguments))
        if node.name == "IF":
            test, (yes, no) = parts[0], unified([parts[1], parts[2] if len(parts) == 3 else literal(False)])
            return Value(yes.kind, F.when(truth(test), yes.value).otherwise(no.value), F.coalesce(test.error, F.when(truth(test), yes.error).otherwise(no.error)))
        if node.name == "IFERROR":
            x, y = unified(parts)
            return Value(x.kind, F.when(x.error.isNull(), x.value).otherwise(y.value), F.when(x.error.isNotNull(), y.error))
        if node.name in ("TRUE", "FALSE"):
            return literal(node.name == "TRUE")
        return FUNCTIONS[node.name](*parts)

    def rows(self, home: str, keep: list[str], **formulas: str) -> DataFrame:
        """For each formula, written as for row 2, a column of its value and ``<name>_error``, the code of its error."""
        home, work = home.lower(), _Work()

        def leaf(node):
            if isinstance(node, f.Reference):
                if node.start[0] < 1:
                    raise ValueError("a row's formula can't look at the header")
                table = self.table(node, home)
                return cell_value(self.columns(node, table)[:1], self.aside(home, table, node.start[0] - 1, work))
            if isinstance(node, f.Call) and (node.name in AGGREGATES or node.name.endswith("IF") and node.name != "IF"):
                raise ValueError("aggregates are for total()")
            return None

        made_ = {name: self.compiled(_parsed(text), leaf) for name, text in formulas.items()}
        values = [c for n, x in made_.items() for c in (F.when(x.error.isNull(), x.value).alias(n), x.error.alias(f"{n}_error"))]
        return self.frame(home, work).select(*keep, *values)

    def total(self, formula: str, name: str = "value", home: str = "") -> DataFrame:
        """A formula of aggregates: one row, ``name`` and ``error``. Each table is read once for all its aggregates."""
        work = _Work()

        def leaf(node):
            match node:
                case f.Reference():
                    return self._cell(node, home, work)
                case f.Call("SUMIF" | "COUNTIF" | "AVERAGEIF" as function, arguments) if 2 <= len(arguments) <= 3:
                    return self._filtered(function, arguments, home, work)
                case f.Call(function, arguments) if function in AGGREGATES:
                    return self._aggregate(function, arguments, home, work, lambda x: self.compiled(x, leaf))
            return None

        result = self.compiled(_parsed(formula), leaf)
        ones = [self.frame(table, work).agg(*(c.alias(k) for k, c in slots.items())) for table, slots in work.slots.items()]
        if not ones:
            one = next(iter(self.tables.values())).sparkSession.range(1)
        elif len(ones) == 1:
            one = ones[0]
        else:  # a row of each table, put side by side without a join
            every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), ones)
            one = every.agg(*(F.max(c).alias(c) for c in every.columns))
        return one.select(F.when(result.error.isNull(), result.value).alias(name), result.error.alias("error"))

    # -- aggregates -----------------------------------------------------------

    def _cell(self, node: f.Reference, home: str, work: _Work) -> Value:
        """The first cell of a range."""
        table, (row, _) = self.table(node, home), node.start
        found = self.columns(node, table)[:1]
        if found and row == 0:
            return literal(found[0].name)
        x = cell_value(found, "")
        if not found:
            return x
        self.number(table, work)
        return Value(x.kind, work.slot(table, F.max(F.when(F.col(_ROW) == row, x.value))), none())

    def _filtered(self, name: str, arguments: tuple, home: str, work: _Work) -> Value:
        area, target = arguments[0], arguments[2] if len(arguments) == 3 else arguments[0]
        if not isinstance(area, f.Reference) or not isinstance(target, f.Reference):
            return failed("#VALUE!")
        wanted = criterion(made(arguments[1])(Evaluator(lambda *a: None), 0, 0))
        table, other = self.table(area, home), self.table(target, home)
        inside, header = self.within(area, table, work), area.start[0] == 0
        prefix = self.aside(table, other, target.start[0] - area.start[0], work) if name != "COUNTIF" else ""
        fields = self.columns(area, table)
        counts, totals, numbers = [F.lit(self._outside(wanted, area, table)) if name == "COUNTIF" else F.lit(0)], [F.lit(0.0)], [F.lit(0)]
        for i, c in enumerate(fields):
            hit = inside & self._criterion(wanted, cell_value([c], ""))
            if name == "COUNTIF":
                counts.append(work.slot(table, F.count_if(hit)) + F.lit(int(header and wanted.holds(c.name))))
                continue
            place = target.start[1] + i
            there = self.tables[other].schema.fields[place : place + 1]
            if not there or kind_of(there[0].dataType) != NUM:
                continue
            number = F.when(hit, cell_value(there, prefix).value)
            totals.append(F.coalesce(work.slot(table, F.sum(number)), F.lit(0.0)))
            numbers.append(work.slot(table, F.count(number)))
        added = lambda xs: reduce(lambda x, y: x + y, xs)
        if name == "COUNTIF":
            return Value(NUM, added(counts).cast("double"), none())
        if name == "SUMIF":
            return guarded(added(totals), none())
        return guarded(F.try_divide(added(totals), added(numbers)), F.when(added(numbers) == 0, F.lit("#DIV/0!")))

    def _outside(self, wanted, area: f.Reference, table: str) -> int:
        """Blank cells right of the table that meet a criterion, where rows are bounded."""
        right = area.end[1] + 1 - max(area.start[1], len(self.tables[table].columns))
        if right > 0 and wanted.holds(None):
            return right * (area.end[0] + 1 - area.start[0])
        return 0

    def _criterion(self, wanted, x: Value) -> Column:
        if wanted.pattern is not None:
            found = F.lower(as_text(x).value).rlike(rf"(?s)^(?:{wanted.pattern})\z")
            return found if wanted.operator == "=" else ~found
        return F.coalesce(compared(as_text(x) if wanted.as_text else x, literal(wanted.operand), wanted.operator).value, F.lit(False))

    def _aggregate(self, name: str, arguments: tuple, home: str, work: _Work, again) -> Value:
        """Each column of a range gives partial results; these and the arguments written in place are put together."""
        numbers, counts, filled, tests, errors = [], [], [], [], [none()]
        for node in arguments:
            node = self.named(node)
            if isinstance(node, f.Reference):
                table = self.table(node, home)
                inside = self.within(node, table, work)
                for c in self.columns(node, table):
                    x, kind = F.when(inside, F.col(f"`{c.name}`")), kind_of(c.dataType)
                    filled.append(work.slot(table, F.count(x)) + F.lit(int(node.start[0] == 0)))
                    number = x.cast("double") if kind == NUM else F.lit(None).cast("double")
                    counts.append(work.slot(table, F.count(number)))
                    make = {"MIN": F.min, "MAX": F.max, "PRODUCT": F.product}.get(name, F.sum)
                    numbers.append(work.slot(table, make(number)))
                    if name in ("AND", "OR") and kind != STR:
                        tests.append(work.slot(table, (F.bool_and if name == "AND" else F.bool_or)(x if kind == BOOL else number != 0)))
                continue
            x = again(node)
            filled.append(F.when(x.error.isNotNull(), 1).otherwise(0 if x.kind == BLANK else 1))
            y = as_number(x)
            # an error written in place is no number, and no failure, to COUNT
            counts.append(F.when(x.error.isNotNull(), 0).otherwise(0 if x.kind == BLANK else 1))
            numbers.append(F.lit(None).cast("double") if x.kind == BLANK else y.value)
            if name == "COUNT":
                errors.append(F.when(x.error.isNull(), y.error))
            elif name != "COUNTA":
                errors.append(x.error if name in ("AND", "OR") else y.error)
            if x.kind in (NUM, BOOL):
                tests.append(truth(x))
        error = F.coalesce(*errors)
        added = lambda xs: reduce(lambda x, y: x + y, xs, F.lit(0))
        if name in ("COUNT", "COUNTA"):
            return Value(NUM, added(counts if name == "COUNT" else filled).cast("double"), error)
        if name in ("AND", "OR"):
            some = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<boolean>")
            value = F.forall(some, lambda x: x) if name == "AND" else F.exists(some, lambda x: x)
            return Value(BOOL, value, F.coalesce(error, F.when(F.size(some) == 0, F.lit("#VALUE!"))))
        if name in ("MIN", "MAX"):
            some = F.array_compact(F.array(*numbers)) if numbers else F.array().cast("array<double>")
            return Value(NUM, F.coalesce(F.array_min(some) if name == "MIN" else F.array_max(some), F.lit(0.0)), error)
        if name == "PRODUCT":
            value = reduce(lambda x, y: x * y, [F.coalesce(x, F.lit(1.0)) for x in numbers], F.lit(1.0))
            return guarded(F.when(added(counts) == 0, F.lit(0.0)).otherwise(value), error)
        total = added([F.coalesce(x, F.lit(0.0)) for x in numbers])
        if name == "AVERAGE":
            return guarded(F.try_divide(total, added(counts)), F.coalesce(error, F.when(added(counts) == 0, F.lit("#DIV/0!"))))
        return guarded(total.cast("double"), error)


_ROW = "_sheet_row"


def _parsed(formula: str):
    try:
        return f.parse(formula)
    except CellError as error:
        return f.Error(error.code)


def cell_value(found: list[T.StructField], prefix: str) -> Value:
    """The cells of a column, the only field of ``found``; blanks without one."""
    if not found:
        return Value(BLANK, none(), none())
    kind, value = kind_of(found[0].dataType), F.col(f"`{prefix}{found[0].name}`")
    return Value(kind, value.cast("double") if kind == NUM else value if kind == BOOL else value.cast("string"), none())
