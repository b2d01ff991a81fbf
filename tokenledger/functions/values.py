"""Values of events, metadata and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

LIMBS = ("low", "mid", "high")
LIMB, WIDE = 26, 78  # decimal digits of a limb, and of a 256-bit number


def mint_number(name: Column, identifier: Column) -> Column:
    """The number after # in a name, else the identifier if it is an integer."""
    return F.coalesce(F.regexp_extract(name, r"#(\d+)", 1).try_cast("bigint"), identifier.try_cast("bigint"))


def project_mint(number: Column, per_project: int = 1_000_000) -> Column:
    """Project and index of a token number that packs both, by a million or another number of mints a project."""
    wide = number.try_cast("decimal(38,0)")
    return F.struct(((wide - wide % F.lit(per_project)) / F.lit(per_project)).cast("bigint").alias("project"), (wide % F.lit(per_project)).cast("bigint").alias("index"))


def spam_status(is_disabled: Column, flag: Column) -> Column:
    return F.when(F.coalesce(is_disabled, F.lit(False)) | F.coalesce(flag.isin("banned", "removed"), F.lit(False)), "spam").otherwise("none")


def severity(status: Column) -> Column:
    """none is 0, spam 1; a status that isn't known ranks above both."""
    return F.when(status == "none", 0).when(status == "spam", 1).otherwise(2)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def parse_fingerprint(hex_: Column, max_distance: Column) -> Column:
    """The 64 bits of up to 16 hex digits and the distance (0 to 64); null for anything else."""
    ok = hex_.rlike("^[0-9a-fA-F]{1,16}$") & max_distance.between(0, 64)
    bits = F.when(ok, F.conv(F.when(ok, hex_).otherwise("0"), 16, -10).cast("bigint"))
    return F.when(ok, F.struct(bits.alias("bits"), max_distance.cast("int").alias("max_distance")))


def raw_field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def changed_fields(old: str, new: str, fields: list[str], existed: Column) -> Column:
    """Names of the fields that differ between columns old.f and new.f, null-safe; all where there was no old row."""
    each = F.array(*(F.when(~existed | ~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in fields))
    return F.array_compact(each)


# --- 256-bit numbers as three limbs of 26 digits -----------------------------------------------------


def limbs(number: Column, sign: Column | None = None) -> Column:
    """low, mid and high limbs of a decimal number text of 78 digits at most; null if it isn't one."""
    ok = number.rlike(r"^[0-9]{1,78}$")
    wide = F.lpad(F.when(ok, number).otherwise("0"), WIDE, "0")
    part = lambda k: F.substring(wide, k * LIMB + 1, LIMB).cast("decimal(38,0)") * (F.lit(1) if sign is None else sign).cast("decimal(1,0)")
    return F.when(ok, F.struct(part(2).cast("decimal(38,0)").alias("low"), part(1).cast("decimal(38,0)").alias("mid"), part(0).cast("decimal(38,0)").alias("high")))


def sum_limbs(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Exact signed sums per key of a limbs column, as decimal text; partial sums combine before the shuffle."""
    return with_text(carried(df.groupBy(*keys).agg(limb_sums(column).alias(out)), out), out)


def limb_sums(column: str, over: WindowSpec | None = None, where: Column | None = None) -> Column:
    """The sum of each limb of a limbs column, in a group or over a window; `carried` makes a number of it."""
    each = []
    for k in LIMBS:
        part = F.col(f"{column}.{k}") if where is None else F.when(where, F.col(f"{column}.{k}"))
        each.append((F.sum(part) if over is None else F.sum(part).over(over)).cast("decimal(38,0)").alias(k))
    return F.struct(*each)


def carried(df: DataFrame, column: str) -> DataFrame:
    """df with the limb sums in `column` as a number: low and mid of 26 digits, not negative, and high with the sign. Of nines
    likewise, the last has the sign."""
    if kind_of(df, column) == "nines":
        # made by a projection, which makes what its columns share once; the generator keeps conditions from making it again
        made = df.withColumn("__carried", _carried_nines([f"{column}.{k}" for k in NINES]))
        return once(made, **{column: F.col("__carried")}).drop("__carried")
    base = f"cast('1{'0' * LIMB}' as decimal(38,0))"
    c = column
    df = df.withColumn("__l", F.expr(f"cast(pmod({c}.low, {base}) as decimal(38,0))"))
    df = df.withColumn("__m2", F.expr(f"cast({c}.mid + cast(({c}.low - __l) div {base} as decimal(20,0)) as decimal(38,0))"))
    df = df.withColumn("__m", F.expr(f"cast(pmod(__m2, {base}) as decimal(38,0))"))
    df = df.withColumn("__h", F.expr(f"cast({c}.high + cast((__m2 - __m) div {base} as decimal(20,0)) as decimal(38,0))"))
    return df.withColumn(c, F.struct(F.col("__l").alias("low"), F.col("__m").alias("mid"), F.col("__h").alias("high"))).drop("__l", "__m2", "__m", "__h")


def with_text(df: DataFrame, column: str) -> DataFrame:
    """df with a carried number as decimal text."""
    if kind_of(df, column) == "nines":
        df = once(df, __minus=F.col(f"{column}.{NINES[-1]}") < 0)
        turned = F.struct(*(F.when(F.col("__minus"), -F.col(f"{column}.{k}")).otherwise(F.col(f"{column}.{k}")).alias(k) for k in NINES))
        df = carried(df.withColumn(column, turned), column)
        return df.withColumn(column, F.concat(F.when(F.col("__minus"), "-").otherwise(""), digits(column))).drop("__minus")
    df = df.withColumn("__minus", F.col(f"{column}.high") < 0)
    turned = F.struct(*(F.when(F.col("__minus"), -F.col(f"{column}.{k}")).otherwise(F.col(f"{column}.{k}")).cast("decimal(38,0)").alias(k) for k in LIMBS))
    df = carried(df.withColumn(column, turned), column)
    part = lambda k: F.lpad(F.col(f"{column}.{k}").cast("string"), LIMB, "0")
    text = F.regexp_replace(F.concat(F.col(f"{column}.high").cast("string"), part("mid"), part("low")), "^0+(?=.)", "")
    return df.withColumn(column, F.when(F.col("__minus"), F.concat(F.lit("-"), text)).otherwise(text)).drop("__minus")


# --- 256-bit numbers as nine bigints of 9 digits, lowest first: no decimals where there are very many ----

NINES, NINE = tuple(f"n{k}" for k in range(9)), 10**9
FIVE, UP = 5**9, 10**10  # NINE is FIVE times 2^9; no bigint over 2^9 is below -UP times FIVE


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns (in place of those of the same names) by a generator of one row: each is made once a row, and not
    again wherever it is named."""
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def nines_of_hex(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the number of a column of 64 hex digits as nines; null where it isn't that."""
    c, bits = F.col(column), 26
    # 13 digits at a time from the right, 52 bits each
    piece = lambda k: F.coalesce(F.conv(F.substring(c, max(52 - 13 * k, 1), 13 if k < 4 else 12), 16, 10).cast("bigint"), F.lit(0).cast("bigint")).alias(f"p{k}")
    none = [F.lit(0).cast("bigint").alias(f"p{k}") for k in range(1, 5)]
    small = F.startswith(c, F.lit("0" * 51))
    ok = F.coalesce((F.length(c) == 64) & F.unhex(c).isNotNull(), F.lit(False))
    df = df.withColumns({"__ok": ok, "__p": F.when(small, F.struct(piece(0), *none)).otherwise(F.struct(*(piece(k) for k in range(5))))})
    # each half of a piece has 26 bits, and a product with 9 digits 56
    half = lambda i: f"__p.p{i // 2} & {(1 << bits) - 1}L" if i % 2 == 0 else f"shiftright(__p.p{i // 2}, {bits})"
    part = lambda j, i: (1 << bits * i) // NINE**j % NINE
    sums = {f"__s{j}": F.expr(" + ".join(f"({half(i)}) * {part(j, i)}L" for i in range(10) if part(j, i)) or "0L") for j in range(9)}  # the last is what the others carry
    df = df.withColumns(sums)
    return df.withColumn(out, F.when(F.col("__ok"), _carried_nines(list(sums)))).drop("__ok", "__p", *sums)


def _carried_nines(names: list[str]) -> Column:
    """Sums of each of nines as nines: of 0 to 10^9 - 1 but for the last, which has the rest and the sign."""
    each, t = [], ""
    for k, name in zip(NINES, names, strict=True):
        # rounded down, of what may be negative: by a shift, which leaves room to make it positive, and a division
        t = f"({name} + ((shiftright({t}, 9) + {UP * FIVE}L) div {FIVE}L - {UP}L))" if t else name
        each.append(F.expr(f"pmod({t}, {NINE}L)" if k != NINES[-1] else t).alias(k))
    return F.struct(*each)


def digits(column: str) -> Column:
    """Carried nines that aren't negative as decimal text."""
    two = [F.expr(f"{column}.n{k} + {column}.n{k + 1} * {NINE}L") for k in range(0, 8, 2)] + [F.col(f"{column}.n8")]
    above = two[1].bitwiseOR(two[2]).bitwiseOR(two[3]).bitwiseOR(two[4])
    text = F.concat(two[4].cast("string"), *(F.lpad(two[k].cast("string"), 18, "0") for k in (3, 2, 1, 0)))
    return F.when(above == 0, two[0].cast("string")).otherwise(F.ltrim(text, F.lit("0")))


# --- quantities: whole numbers as bigint, or of any size up to 256 bits as decimal text or nines --------


def kind_of(df: DataFrame, column: str) -> str:
    """bigint, text, limbs or nines: how a column of df holds quantities."""
    kind = dict(df.dtypes)[column]
    return "nines" if kind.startswith(f"struct<{NINES[0]}:") else "limbs" if kind.startswith("struct") else "text" if kind == "string" else "bigint"


def signed(df: DataFrame, column: str, sign: int = 1) -> Column:
    """A quantity as an addend of `totalled`: text becomes limbs; what isn't a number adds nothing."""
    kind = kind_of(df, column)
    if kind == "bigint":
        return F.col(column) if sign > 0 else -F.col(column)
    if kind == "nines":
        return F.col(column) if sign > 0 else F.struct(*((-F.col(f"{column}.{k}")).alias(k) for k in NINES))
    minus = F.startswith(F.col(column), F.lit("-"))
    return limbs(F.ltrim(F.col(column), F.lit("-")), F.when(minus, -sign).otherwise(sign))


def one(df: DataFrame, column: str) -> Column:
    """The number 1 as a column of df holds quantities."""
    kind = kind_of(df, column)
    return F.struct(*(F.lit(int(k == NINES[0])).cast("bigint").alias(k) for k in NINES)) if kind == "nines" else F.lit("1") if kind == "text" else F.lit(1)


def totalled(df: DataFrame, keys: list[str], column: str, out: str, *more: Column, where: Column | None = None) -> DataFrame:
    """Exact sums per key, partial before the shuffle, of bigints (as bigint), limbs or nines (carried), with other aggregates."""
    kind = kind_of(df, column)
    if kind == "bigint":
        part = F.col(column) if where is None else F.when(where, F.col(column))
        return df.groupBy(*keys).agg(F.sum(part).alias(out), *more)
    if kind == "nines":
        part = lambda k: F.col(f"{column}.{k}") if where is None else F.when(where, F.col(f"{column}.{k}"))
        sums = F.struct(*(F.coalesce(F.sum(part(k)), F.lit(0).cast("bigint")).alias(k) for k in NINES))
        return carried(df.groupBy(*keys).agg(sums.alias(out), *more), out)
    return carried(df.groupBy(*keys).agg(limb_sums(column, where=where).alias(out), *more), out)


def running(df: DataFrame, column: str, out: str, over: WindowSpec) -> DataFrame:
    """df with the exact sum of a bigint or limbs column over a window."""
    if kind_of(df, column) == "bigint":
        return df.withColumn(out, F.sum(column).over(over))
    return carried(df.withColumn(out, limb_sums(column, over)), out)


def above_zero(df: DataFrame, column: str) -> Column:
    """Whether a quantity, a bigint, text or carried number, is above zero."""
    kind, c = kind_of(df, column), F.col(column)
    if kind == "bigint":
        return c > 0
    if kind == "text":
        return c.rlike("^[0-9]*[1-9][0-9]*$")
    if kind == "nines":
        rest = F.expr(" | ".join(f"{column}.{k}" for k in NINES[:-1]))
        return (F.col(f"{column}.{NINES[-1]}") > 0) | ((F.col(f"{column}.{NINES[-1]}") == 0) & (rest != 0))
    high, rest = F.col(f"{column}.high"), (F.col(f"{column}.mid") != 0) | (F.col(f"{column}.low") != 0)
    return (high > 0) | ((high == 0) & rest)


def shown(df: DataFrame, column: str, above: bool = False) -> DataFrame:
    """df with carried numbers (with `above`, of which none is negative) as text; bigints stay."""
    if above and kind_of(df, column) == "nines":
        return df.withColumn(column, digits(column))
    return with_text(df, column) if kind_of(df, column) in ("limbs", "nines") else df


def size_order(df: DataFrame, column: str) -> Column:
    """What orders quantities, none negative, by size."""
    return F.lpad(F.col(column), WIDE, "0") if kind_of(df, column) == "text" else F.col(column)
