"""The number rules: dates, percentages, prices, distances, weights, ranges, fractions, plain numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import lexicon as L
from quillspan.functions.plan import pinned
from quillspan.functions.text import numeric_contexts


def lookup(table: dict, key: str) -> str:
    """SQL for the table's value of the column ``key``, or null."""
    values = [f"'{v}'" if isinstance(v, str) else f"{v!r}D" for v in table.values()]
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in zip(table, values)) + f")[{key}]"


def _among(column: str, words: tuple[str, ...]) -> str:
    return f"{column} in (" + ", ".join(f"'{w}'" for w in words) + ")"


def _number(text: str) -> str:
    return f"({text}) rlike r'{L.IS_NUMBER}'"


def number_string(v: Column) -> Column:
    """Plain decimal with at most three decimals, cut off and without trailing zeros; infinite: empty."""
    exact = v.try_cast("decimal(38,12)").cast("string")
    cut = F.regexp_extract(exact, r"^(\d+\.\d{3})", 1)
    text = F.rtrim(F.rtrim(cut, F.lit("0")), F.lit("."))
    return F.when(v == float("inf"), "").otherwise(F.coalesce(text, F.format_string("%.0f", v)))


def matches(sections: DataFrame, *keep: str) -> DataFrame:
    """Every numeric match with its context: ``keep..., at, nth, num, prev, next, next2, next3``.

    Within its token a match has a prefix and a suffix; where they are empty the neighbouring tokens take
    their place. What follows an expression that lost stop characters is empty.
    """
    found = sections.select(*keep, pinned(numeric_contexts(F.col("tokens"))).alias("c"))
    ctx = found.select(*keep, F.explode("c").alias("c")).select(*keep, "c.*")
    nums, gaps = f"regexp_extract_all(tok, r'{L.NUMERIC}', 0)", f"split(tok, r'{L.NUMERIC}', -1)"
    each = ctx.selectExpr("*", f"{gaps} as _gaps", f"posexplode({nums}) as (nth, num)")
    size = lambda xs: f"length(array_join({xs}, ''))"
    each = each.selectExpr("*", f"{size('slice(_gaps, 1, nth + 1)')} + {size(f'slice({nums}, 1, nth)')} as _start")
    each = each.selectExpr("*", "substr(tok, 1, _start) as _prefix", "substr(tok, _start + length(num) + 1, length(tok)) as _suffix")
    cut = lambda x: f"regexp_replace({x}, r'{L.STOP_CHARS}', '')"
    each = each.selectExpr(
        *keep, "at", "nth", "num", "if(_prefix <> '', _prefix, before) as prev", "if(_suffix <> '', _suffix, t1) as _1",
        "if(_suffix <> '', t1, t2) as _2", "if(_suffix <> '', t2, t3) as _3",
    ).selectExpr("*", f"{cut('_1')} as next", f"{cut('_2')} as _next2")
    return each.selectExpr(
        *keep, "at", "nth", "num", "prev", "next", "if(next <> _1, '', _next2) as next2",
        f"if(next <> _1 or _next2 <> _2, '', {cut('_3')}) as next3",
    )


def classified(found: DataFrame) -> DataFrame:
    """Adds ``rule``, ``kind`` and ``key`` to :func:`matches`; all null for parts of a fraction that give nothing.

    A numerator speaks for its fraction, whose whole part is always 0: the expression after the
    fraction takes the place of the next one. Every step is a column of its own, so that generated code stays small.
    """
    value = lambda text: f"cast(replace({text}, ',', '') as double)"
    df = found.selectExpr("*", "instr(next, '/') as _slash").selectExpr(
        "*",
        f"_slash = 1 and {_number('substr(next, 2)')} as _part",
        f"(length(prev) > 0 and instr(prev, '/') = length(prev) and {_number('substr(prev, 1, length(prev) - 1)')})"
        f" or (_slash > 1 and {_number('substr(next, 1, _slash - 1)')} and {_number('substr(next, _slash + 1)')}) as _swallowed",
    ).selectExpr(
        "*", "if(_part, next2, next) as _follow", "if(_part, next3, next2) as _beyond", "if(_part, concat('0 ', num, next), num) as _text",
        f"{value('num')} as _above", f"if(_part, {value('substr(next, 2)')}, 1.0D) as _below",
    ).selectExpr(
        "*", f"{lookup(L.POSTFIXES, '_follow')} as _times",
        "case when _below <> 0 then try_divide(_above, _below) when _above = 0 then double('nan') else double('infinity') end as _ratio",
    ).selectExpr(
        "*", "_ratio * coalesce(_times, 1.0D) as _value", "if(_times is not null, _beyond, _follow) as _after",
        f"{lookup(L.DISTANCES, '_follow')} as _distance", f"{lookup(L.WEIGHTS, '_follow')} as _weight",
        f"case when not _part and (length(num) <= 2 or length(num) = 4) then coalesce({lookup(L.MONTHS, 'prev')}, {lookup(L.MONTHS, 'next')}) end as _month",
    )
    dollars = f"({_among('_after', L.DOLLARS)} or {_among('prev', L.DOLLARS)})"
    between = f"not _part and {_among('prev', L.BETWEEN)} and {_among('next', L.AND)} and {_number('next2')}"
    # Prices go before percentages for fractions, after them else.
    rule = F.expr(
        f"""case when not _part and _swallowed then null when _month is not null then 'date' when _part and {dollars} then 'dollars'
          when {_among('_after', L.PERCENTS)} then 'percent' when {dollars} then 'dollars' when _distance is not null then 'distance'
          when _weight is not null then 'weight' when {between} then 'between' when _part then 'fraction' else 'plain' end"""
    )
    df = df.withColumn("rule", pinned(rule)).selectExpr(
        "*",
        """case when rule = 'dollars' and _value > 1e6 then 1e6D when rule not in ('plain', 'fraction') or isnan(_value) then 1.0D
          when _value >= 1e9D then 1e9D when _value >= 1e6D then 1e6D when _value >= 1e3D then 1e3D else 1.0D end as _scale""",
    )
    df = df.withColumn("_shown", number_string(F.expr("_value / _scale")))
    key = """case
      when rule = 'date' then if(length(num) <= 2, concat_ws('-', _month, lpad(num, 2, '0')), concat_ws('-', num, _month))
      when rule = 'percent' then concat(_shown, '%') when rule = 'dollars' and _scale > 1 then concat(_shown, ' M Dollars')
      when rule = 'dollars' then concat(_text, ' Dollars') when rule in ('distance', 'weight') then concat_ws(' ', _shown, coalesce(_distance, _weight))
      when rule = 'between' then concat_ws('-', num, next2) when _scale = 1e9D then concat(_shown, 'B') when _scale = 1e6D then concat(_shown, 'M')
      when _scale = 1e3D then concat(_shown, 'K') when rule = 'fraction' then _text when rule = 'plain' then _shown end as key"""
    kind = "case when rule = 'between' then 'term' when rule is not null then 'number' end as kind"
    return df.selectExpr(*(f"`{c}`" for c in found.columns), "rule", kind, key)
