"""Roles of the colours of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text


def roles(colors: DataFrame, site: str) -> DataFrame:
    """(``site``, color, uses, role) of a row for each use of a colour, (``site``, color): by its
    luminance, its saturation and its share of the site's uses. Null colours have no role;
    the window holds the distinct colours of a site, not their uses."""
    uses = colors.filter("color is not null").groupBy(site, "color").agg(F.count(F.lit(1)).alias("uses"))
    share = F.col("uses") / F.sum("uses").over(Window.partitionBy(site))
    rgb = uses.withColumn("share", share).withColumn("c", text.rgb(F.col("color")))
    r, g, b = (F.col(f"c.{k}") for k in "rgb")
    both = rgb.withColumns({"lum": text.luminance(r, g, b), "saturation": text.hsl(r, g, b)["s"]})
    return both.select(site, "color", "uses", text.color_role(F.col("lum"), F.col("saturation"), F.col("share")).alias("role"))
