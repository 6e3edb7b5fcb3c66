"""Canonical JSON of any column, built from its type: keys in code-point order, ``", "`` and ``": "`` between parts, nulls told.

The text is that of Python's ``json.dumps(value, sort_keys=True)``, with ``ascii=False`` that of ``ensure_ascii=False`` too, so that hashes
over it agree with those of other programs. Structs, arrays and maps with string keys nest to any depth; numbers are whole or
double; dates, decimals and binary have no JSON form and are refused. Everything stays in the JVM; texts without a character
to escape are only searched for one. Of random doubles about one in 50,000, whole numbers of some 1e18, gets another last digit
than Python writes (as many digits, read back as the same number).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructType

from .text import let

_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def _hex4(number: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(number), 4, "0")))


def json_string(text: Column, ascii: bool) -> Column:
    """The quoted form of a text that is not null."""
    needs = r"[\x00-\x1f\"\\]" if not ascii else r"[^ !#-\[\]-~]"

    def one(char: Column) -> Column:
        code = F.ascii(char)
        out = None
        for plain, written in _SHORT.items():
            out = F.when(char == plain, F.lit(written)) if out is None else out.when(char == plain, F.lit(written))
        out = out.when(code < 0x20, _hex4(code))
        if ascii:
            pair = F.concat(_hex4(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), _hex4(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)))
            out = out.when(code > 0xFFFF, pair).when(code > 0x7E, _hex4(code))
        return out.otherwise(char)

    escaped = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.concat(F.lit('"'), F.when(text.rlike(needs), escaped).otherwise(text), F.lit('"'))


def _shortest(value: Column) -> Column:
    """struct(digits, exponent): the fewest digits that read back as the value, which is digits * 10 ** exponent; the value is over 0.

    The JVM's own text may hold digits more than it takes, so digits are dropped while the rest still reads back.
    """
    text = value.cast("string")  # digits.digits[Eexponent]
    mantissa, power = F.regexp_extract(text, r"^([0-9.]+)", 1), F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    part = F.split_part(mantissa, F.lit("."), F.lit(2))
    pair = lambda v, e, done: F.struct(v.alias("v"), e.alias("e"), done.alias("done"))
    start = pair(F.concat(F.split_part(mantissa, F.lit("."), F.lit(1)), part).cast("long"), power - F.length(part), F.lit(False))
    reads_back = lambda v, e: F.concat(v.cast("string"), F.lit("E"), e.cast("string")).cast("double") == value

    def shorter(now: Column, _: Column) -> Column:
        low, e = F.floor(now["v"] / F.lit(10).cast("decimal(2,0)")).cast("long"), now["e"] + 1
        down = (now["v"] % 10 < 5) | ((now["v"] % 10 == 5) & (low % 2 == 0))
        near, far = F.when(down, low).otherwise(low + 1), F.when(down, low + 1).otherwise(low)
        tried = F.when(reads_back(near, e), pair(near, e, F.lit(False))).when(reads_back(far, e), pair(far, e, F.lit(False)))
        return F.when(now["done"], now).otherwise(F.coalesce(tried, now.withField("done", F.lit(True))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, shorter, lambda x: F.struct(x["v"].cast("string").alias("digits"), x["e"].alias("exponent")))


def json_double(value: Column) -> Column:
    """The shortest digits that read back as the value; an exponent from 1e16 and below 1e-4, as Python writes it."""
    sign = F.when(value.cast("string").startswith("-"), F.lit("-")).otherwise("")

    def written(x: Column) -> Column:
        digits, n = x["digits"], F.length(x["digits"])
        scale = x["exponent"] + n  # the value is 0.digits * 10 ** scale
        exponent = scale - 1
        fixed = (
            F.when(scale <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -scale), digits))
            .when(scale >= n, F.concat(F.rpad(digits, scale, "0"), F.lit(".0")))
            .otherwise(F.concat(F.left(digits, scale), F.lit("."), F.substr(digits, scale + 1)))
        )
        size = F.abs(exponent).cast("string")
        shown = F.concat(F.when(exponent < 0, F.lit("-")).otherwise("+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
        scientific = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), shown)
        return F.when((exponent >= 16) | (exponent < -4), scientific).otherwise(fixed)

    number = F.when(value == 0, F.lit("0.0")).otherwise(let(_shortest(F.abs(value)), written))
    return F.when(F.isnan(value), F.lit("NaN")).when(F.abs(value) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, number))


def canonical_json(value: Column, kind: DataType, ascii: bool = True) -> Column:
    """JSON text of ``value`` of type ``kind``; a null is ``null``."""
    if isinstance(kind, StringType):
        out = json_string(value, ascii)
    elif isinstance(kind, BooleanType):
        out = F.when(value, F.lit("true")).otherwise("false")
    elif isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        out = value.cast("string")
    elif isinstance(kind, (DoubleType, FloatType)):
        out = json_double(value.cast("double"))
    elif isinstance(kind, NullType):
        return F.lit("null")
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType, ascii)), ", "), F.lit("]"))
    elif isinstance(kind, StructType):
        parts: list[Column] = []
        for field in sorted(kind.fields, key=lambda f: f.name):
            parts += [F.lit(", ")] if parts else []
            parts += [json_string(F.lit(field.name), ascii), F.lit(": "), canonical_json(value[field.name], field.dataType, ascii)]
        out = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entry = lambda k: F.concat(json_string(k, ascii), F.lit(": "), canonical_json(F.element_at(value, k), kind.valueType, ascii))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), entry), ", "), F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no JSON form")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def canonical_hash(value: Column, kind: DataType, ascii: bool = True) -> Column:
    """First 16 hex digits of SHA-256 over the canonical JSON in UTF-8."""
    return F.left(F.sha2(canonical_json(value, kind, ascii), 256), F.lit(16))


def payload_hashes(cases_schema: StructType, hash_at: str = "content_hash") -> dict[str, Column]:
    """The hashes by which records of cases are told apart, over the columns of a table of cases.

    ``case_hash`` is over the whole case without its own hash (in ``metadata``), ``example_hash`` over task type and input, both
    with texts as they are; ``input_hash`` is over the input alone and ``record_hash`` over the whole record, both in ASCII.
    """
    types = {f.name: f.dataType for f in cases_schema.fields}

    def bundle(names: list[str], without: bool) -> tuple[Column, StructType]:
        columns, fields = [], StructType()
        for name in names:
            column, kind = F.col(f"`{name}`"), types[name]
            if without and name == "metadata" and isinstance(kind, StructType) and hash_at in kind.names:
                kept = [f for f in kind.fields if f.name != hash_at]
                column, kind = F.when(column.isNotNull(), F.struct(*[column[f.name].alias(f.name) for f in kept])), StructType(kept)
            columns.append(column.alias(name))
            fields = fields.add(name, kind)
        return F.struct(*columns), fields

    whole = [name for name in types if name != hash_at]
    return {
        "case_hash": canonical_hash(*bundle(whole, True), ascii=False),
        "example_hash": canonical_hash(*bundle(["task_type", "input"], False), ascii=False),
        "input_hash": canonical_hash(F.col("input"), types["input"]),
        "record_hash": canonical_hash(*bundle(list(types), False)),
    }
