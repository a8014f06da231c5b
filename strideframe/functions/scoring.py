"""Classification, walkability and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.config import CAPS, CATEGORIES, CATEGORY_COLORS, EXCLUDED_HIGHWAYS, FORBIDDEN_ACCESS, OTHER_COLOR, POINTS, SCORE_COLORS, TAG_RULES


def feature_category(tags: Column, rules: list[tuple[str, str, list | None]] = TAG_RULES) -> Column:
    """The category of the first rule that a tag map meets, else null.  A rule without values takes any value, "no" too."""
    fits = lambda key, values: tags[key].isNotNull() if values is None else tags[key].isin(values)
    return F.coalesce(*(F.when(fits(key, values), F.lit(name)) for name, key, values in rules))


def is_walkable(tags: Column) -> Column:
    """A highway that isn't excluded (case matters), with neither access nor foot forbidden (case doesn't)."""
    allowed = lambda key: ~F.lower(F.coalesce(tags[key], F.lit(""))).isin(FORBIDDEN_ACCESS)
    return tags["highway"].isNotNull() & ~F.coalesce(tags["highway"], F.lit("")).isin(EXCLUDED_HIGHWAYS) & allowed("access") & allowed("foot")


def category_score(n: Column, cap: int) -> Column:
    return F.least(F.coalesce(n, F.lit(0)) / F.lit(float(cap)), F.lit(1.0)) * POINTS


def scores(counts: dict[str, Column], caps: dict[str, int] = CAPS) -> dict[str, Column]:
    """``score_<category>`` for every capped category and ``total_score``, their sum."""
    found = {f"score_{c}": category_score(counts.get(c, F.lit(0)), cap) for c, cap in caps.items()}
    total = F.lit(0.0)
    for score in found.values():
        total = total + score
    return found | {"total_score": total}


def counts_map(counts: dict[str, Column]) -> Column:
    """A map without the categories of count 0."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*(F.coalesce(c, F.lit(0)).cast("int") for c in counts.values()))), lambda _, n: n > 0)


def score_color(score: Column, stops: list[tuple[int, str]] = SCORE_COLORS) -> Column:
    """The colour between stops, linear in red, green and blue; a null score counts as 0."""
    score = F.greatest(F.least(F.coalesce(score, F.lit(0.0)), F.lit(float(stops[-1][0]))), F.lit(float(stops[0][0])))
    part = lambda color, k: int(color[1 + 2 * k : 3 + 2 * k], 16)
    out = F.lit(stops[-1][1])
    for (low, a), (high, b) in reversed(list(zip(stops, stops[1:]))):  # noqa: B905
        channels = [F.lpad(F.lower(F.hex(F.round(part(a, k) + (score - low) / (high - low) * (part(b, k) - part(a, k))).cast("long"))), 2, "0") for k in range(3)]
        out = F.when(score < high, F.concat(F.lit("#"), *channels)).otherwise(out)
    return out


def category_color(category: Column, colors: dict[str, str] = CATEGORY_COLORS, other: str = OTHER_COLOR) -> Column:
    """A category's colour; that of others for null and unknown ones."""
    return F.coalesce(*(F.when(category == c, F.lit(v)) for c, v in colors.items()), F.lit(other))


def popup(category: str) -> Column:
    """A category's line in a cell's popup, from the columns ``score_`` and ``count_`` of it; what is null counts as 0."""
    points = F.format_string("%.1f", F.coalesce(F.col(f"score_{category}").cast("double"), F.lit(0.0)))
    found = F.coalesce(F.col(f"count_{category}"), F.lit(0)).cast("string")
    return F.concat(F.lit(f"{category.capitalize()}: "), points, F.lit(" points, "), found, F.lit(" found"))


def cell_popup(rows: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """cell_id, title, resolution and a line for each category, as a map shows them."""
    title = F.concat(F.lit("Walk score "), F.format_string("%.1f", F.coalesce(F.col("total_score").cast("double"), F.lit(0.0))), F.lit(" / 100"))
    size = F.concat(F.lit("Resolution: "), F.coalesce(F.col("resolution_m").cast("string"), F.lit("?")), F.lit("m"))
    return rows.select(F.coalesce("cell_id", F.lit("unknown")).alias("cell_id"), title.alias("title"), size.alias("resolution"), *(popup(c).alias(f"line_{c}") for c in categories))
