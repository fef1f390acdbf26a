"""Figures of a company page: ratios, holdings, pledge, order book and remarks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.scoring import quality_points, tags
from barloom.sources.parsing import number

#: Remarks kept of a page and their length; flags kept of either kind.
REMARKS, REMARK_CHARS, FLAGS = 8, 200, 5


def plain(html: Column) -> Column:
    """Text of a piece of markup: tags out, common entities in, white space collapsed."""
    x = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("\u00a0", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def section(html: Column, name: str, end: str) -> Column:
    """Markup from the tag whose id is ``name`` to the next ``end``; empty if there is none."""
    return F.regexp_extract(html, rf'(?s)<[^>]*\bid="{name}"[^>]*>(.*?){end}', 1)


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), group)


def labelled(items: Column) -> Column:
    """(label, value) of list items whose parts are marked by class: the name, and the first number."""
    def pair(li: Column) -> Column:
        label = F.regexp_extract(li, r'(?s)<(\w+)[^>]*class="[^"]*\bname\b[^"]*"[^>]*>(.*?)</\1>', 2)
        value = F.regexp_extract(li, r'(?s)<(\w+)[^>]*class="[^"]*\b(?:number|nowrap)\b[^"]*"[^>]*>(.*?)</\1>', 2)
        return F.struct(F.lower(plain(label)).alias("label"), plain(value).alias("value"))

    return F.filter(F.transform(items, pair), lambda p: (p["label"] != "") & (p["value"] != ""))


def grid(table: Column) -> Column:
    """Rows of a table as arrays of cell texts; a cell that spans columns is repeated, so that columns line up."""
    def cells(row: Column) -> Column:
        whole = _all(row, r"(?s)(<t[dh]\b[^>]*>.*?)(?=<t[dh]\b|</tr|$)")
        wide = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r'(?i)colspan="?(\d+)', 1), F.lit("")).cast("int"), F.lit(1))
        return F.flatten(F.transform(whole, lambda c: F.array_repeat(plain(c), wide(c))))

    return F.transform(_all(table, r"(?s)(<tr\b[^>]*>.*?)(?=<tr\b|</table|$)"), cells)


def _last(pairs: Column, *words: str, without: tuple[str, ...] = ()) -> Column:
    """Value of the last label with any of the words and none of those that an earlier rule takes."""
    def fits(p: Column) -> Column:
        has = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(p["label"], w))
        return has(words) & ~has(without) if without else has(words)

    return F.try_element_at(F.filter(pairs, fits), F.lit(-1))["value"]


def company_figures(html: Column) -> dict[str, Column]:
    """Named figures of one page; null where the page does not have them."""
    ratios = labelled(_all(section(html, "top-ratios", "</ul>"), r"(?s)<li\b[^>]*>(.*?)</li>"))
    holding = section(html, "shareholding", "</section>")
    first_table = F.regexp_extract(holding, r"(?s)(<table\b.*?</table>)", 1)

    def row(cells: Column) -> Column:
        label = F.trim(F.replace(F.lower(F.get(cells, 0)), F.lit("+"), F.lit("")))
        values = F.transform(F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda x: x != ""), number)
        latest, before = F.try_element_at(values, F.lit(-1)), F.try_element_at(values, F.lit(-2))
        return F.struct(label.alias("label"), F.size(values).alias("n"), latest.alias("latest"), F.coalesce(before, latest).alias("before"))

    all_rows = F.transform(F.filter(grid(holding), lambda r: F.size(r) > 0), row)
    rows = F.filter(F.transform(F.slice(grid(first_table), 2, 1000), row), lambda r: r["n"] > 0)

    def held(*words: str, without: tuple[str, ...] = ()) -> Column:
        has = lambda r, ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(r["label"], w))
        return F.try_element_at(F.filter(rows, lambda r: has(r, words) & (~has(r, without) if without else F.lit(True))), F.lit(-1))

    change = lambda r: F.when(r["before"] != 0, F.round(r["latest"] - r["before"], 2))
    promoter, fii, dii = held("promoter"), held("fii", "fpi", without=("promoter",)), held("dii", without=("promoter", "fii", "fpi"))
    pledge = F.try_element_at(F.filter(all_rows, lambda r: F.contains(r["label"], F.lit("pledge")) & (r["n"] > 0)), F.lit(-1))["latest"]
    remarks = F.transform(F.concat(_all(section(html, "analysis", "</section>"), r"(?s)<li\b[^>]*>(.*?)</li>")), plain)
    remarks = F.slice(F.transform(F.filter(remarks, lambda x: F.char_length(x) > 10), lambda x: F.substring(x, 1, REMARK_CHARS)), 1, REMARKS)
    taken = ("p/e", "book value")
    return {
        "pe": number(_last(ratios, "p/e")),
        "book_value": number(_last(ratios, "book value", without=taken[:1])),
        "roce": number(_last(ratios, "roce", without=taken)),
        "roe": number(_last(ratios, "roe", without=(*taken, "roce"))),
        "debt_to_equity": number(_last(ratios, "debt", without=(*taken, "roce", "roe"))),
        "dividend_yield": number(_last(ratios, "dividend yield", without=(*taken, "roce", "roe", "debt"))),
        "market_cap": _last(ratios, "market cap", without=(*taken, "roce", "roe", "debt", "dividend yield")),
        "promoter_holding": promoter["latest"], "promoter_change": change(promoter),
        "fii_holding": fii["latest"], "fii_change": change(fii), "dii_holding": dii["latest"], "dii_change": change(dii),
        "promoter_pledged": pledge, "remarks": remarks,
        "order_book": F.nullif(F.regexp_extract(html, r"[Oo]rder [Bb]ook.*?([\d,]+\.?\d*\s*(?:Cr|cr|lakh|Lakh))", 1), F.lit("")),
        "revenue": F.nullif(F.replace(F.regexp_extract(html, r"Sales.*?(\d[\d,]+)", 1), F.lit(","), F.lit("")), F.lit("")),
        "net_profit": F.nullif(F.replace(F.regexp_extract(html, r"Net Profit.*?(\d[\d,]+)", 1), F.lit(","), F.lit("")), F.lit("")),
    }


def with_company_figures(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their figures, quality points and flags.

    A page without these sections has nulls, no remarks, and the points of a
    company of which nothing but the absence of a pledge is known.
    """
    c = F.col
    df = pages.select("*", *[v.alias(k) for k, v in company_figures(c(html)).items()])
    pledged = F.coalesce("promoter_pledged", F.lit(0.0))
    worry = F.exists("remarks", lambda x: F.lower(x).rlike("decrease|low roe|high debt|negative"))
    red = tags(("high_pledge", pledged > 50), ("pledge", pledged > 20), ("promoter_sold", c("promoter_change") < -2), ("fii_sold", c("fii_change") < -3), ("high_debt", c("debt_to_equity") > 3), ("remark", worry))
    green = tags(("fii_buying", c("fii_change") > 1), ("dii_buying", c("dii_change") > 1), ("promoter_bought", c("promoter_change") > 0.5), ("high_roce", c("roce") > 20), ("no_pledge", pledged == 0))
    return df.withColumns({
        "quality_score": quality_points(c("roce"), c("roe"), c("debt_to_equity"), c("fii_change"), c("dii_change"), pledged),
        "red_flags": F.slice(red, 1, FLAGS), "green_flags": F.slice(green, 1, FLAGS),
    })
