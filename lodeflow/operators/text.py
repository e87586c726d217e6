"""Lines, slices and pattern scores of code and prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), code: one row per line; an empty text has one empty line, null has none."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "code")).select(key, (F.col("pos") + 1).alias("line"), "code")


def slice_around(df: DataFrame, key: str, text: str, pattern: str, radius: int, most: int | None = None) -> DataFrame:
    """The lines within ``radius`` of the first line that matches: key, line, code, is_hit.

    With ``most`` the hit stays and then the first lines up to that number. Row-local: the lines
    of a text never leave its task, so the range join needs no shuffle.
    """
    lines = F.split(F.col(text), "\n")
    first = F.expr(f"array_position(transform(split({text}, '\\n'), l -> l rlike '{pattern}'), true)")
    cut = df.select(key, lines.alias("_l"), first.alias("_at")).where("_at > 0")
    low, high = F.greatest(F.lit(1), F.col("_at") - radius), F.least(F.size("_l"), F.col("_at") + radius)
    rows = cut.select(key, "_at", "_l", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("line"))
    out = rows.select(key, "line", F.expr("_l[line - 1]").alias("code"), (F.col("line") == F.col("_at")).alias("is_hit"))
    if most is None:
        return out
    ranked = out.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("is_hit"), "line")))
    return ranked.where(F.col("is_hit") | (F.col("_rn") <= most)).drop("_rn")


def rendered(df: DataFrame, keys: list[str], order: str, text: Column, out: str = "rendered") -> DataFrame:
    """The parts of each key in order, joined by line breaks."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]), "\n").alias(out))


def best_pattern(text: Column, rules: list[tuple[str, float]]) -> Column:
    """The greatest score of the rules whose regex occurs, 0 if none does or the text is null."""
    return F.greatest(F.lit(0.0), *(F.when(F.coalesce(text.rlike(p), F.lit(False)), F.lit(s)).otherwise(F.lit(0.0)) for p, s in rules))


def term_score(text: Column, terms: list[str], each: float = 0.2, most: float = 0.5) -> Column:
    """``each`` per term that occurs (as a substring, in lower case), at most ``most``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.lit(0)
    for t in terms:
        n = n + F.contains(low, F.lit(t)).cast("int")
    return F.least(n * F.lit(each), F.lit(most))


def called_names(text: Column, stop: tuple[str, ...]) -> Column:
    """Names before an opening bracket, in order, without the stop words; null gives an empty array."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\w+)\s*\("), F.lit(1))
    return F.filter(names, lambda n: ~n.isin(*stop))


def numbered(line: Column, code: Column) -> Column:
    """A line as it stands in a context: its number in four places, a bar, its text."""
    return F.concat(F.lpad(line.cast("string"), 4, " "), F.lit("| "), code)


def function_source(df: DataFrame, key: str, code: str, most: int = 50) -> DataFrame:
    """key, source, n_lines: the first function of a text.

    From its header line up to the next line that is indented no more and begins a definition, class
    or decorator, at most ``most`` lines. Row-local; texts without a header give no row.
    """
    head = r"^\\s*(?:async +)?(?:def|class|function)\\b"
    stop = r"^\\s*(?:async +)?(?:def |class |@|function )"
    rows = df.withColumn("_l", F.split(F.col(code), "\n")).withColumn("_from", F.expr(f"array_position(transform(_l, l -> l rlike '{head}'), true)")).where("_from > 0")
    indent = "length(regexp_extract({l}, '^( *)', 1))"
    rest = rows.withColumn("_tail", F.expr(f"slice(_l, cast(_from as int), {most})"))
    ends = F.expr(f"array_position(transform(_tail, (l, i) -> i > 0 and {indent.format(l='l')} <= {indent.format(l='_tail[0]')} and l rlike '{stop}'), true)")
    taken = rest.withColumn("_to", ends).withColumn("_own", F.expr("if(_to > 0, slice(_tail, 1, cast(_to - 1 as int)), _tail)"))
    return taken.select(key, F.array_join("_own", "\n").alias("source"), F.size("_own").alias("n_lines"))
