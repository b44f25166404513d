"""Small results as texts for people: cards, statement tables and a page that shows a graph; all driver-side and escaped."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

#: A report shows so many rows at most and says how many it leaves out.
SHOWN = 400

_PAGE = """<!doctype html>
<meta charset="utf-8">
<title>{title}</title>
<style>body{{font:14px sans-serif}} td,th{{padding:2px 8px;text-align:left}} .n{{fill:#eef;stroke:#447}} .e{{stroke:#99a}}</style>
<h1>{title}</h1>
<svg id="g" width="900" height="{height}"></svg>
<table>{rows}</table>
<script type="application/json" id="data">{data}</script>
<script>
const d = JSON.parse(document.getElementById("data").textContent), s = document.getElementById("g"), at = {{}};
const make = (k, a, t) => {{ const x = document.createElementNS("http://www.w3.org/2000/svg", k); for (const i in a) x.setAttribute(i, a[i]); if (t) x.textContent = t; s.append(x); }};
d.nodes.forEach((n) => {{ at[n.name] = [20 + 180 * n.layer, 20 + 26 * n.place]; }});
d.links.forEach(([a, b]) => make("line", {{x1: at[a][0] + 150, y1: at[a][1] + 9, x2: at[b][0], y2: at[b][1] + 9, class: "e"}}));
d.nodes.forEach((n) => {{ make("rect", {{x: at[n.name][0], y: at[n.name][1], width: 150, height: 18, class: "n"}}); make("text", {{x: at[n.name][0] + 4, y: at[n.name][1] + 13}}, n.name.slice(0, 22)); }});
</script>
"""


def _rows(df: DataFrame) -> tuple[list, int]:
    """The first rows in their order, and how many more there are."""
    total = df.count()
    return df.limit(SHOWN).collect(), max(0, total - SHOWN)


def figure(x: object) -> str:
    """A value as shown: thousands parted, four significant decimals at most, a dash for nothing."""
    if x is None:
        return "–"
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return f"{x:,.0f}" if float(x).is_integer() else f"{x:,.4g}" if abs(x) < 1000 else f"{x:,.0f}"


def card(df: DataFrame, title: str) -> str:
    """A result as lines of text in columns as wide as they need to be."""
    rows, more = _rows(df)
    table = [df.columns, *[[figure(v) for v in r] for r in rows]]
    wide = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    lines = [title, "=" * len(title), *["  ".join(v.ljust(n) for v, n in zip(r, wide)).rstrip() for r in table]]
    return "\n".join([*lines, *([f"... and {more} more"] if more else [])])


def _script_safe(data: object) -> str:
    """JSON that can stand inside a script element whatever its texts hold."""
    return json.dumps(data, ensure_ascii=False).replace("</", "<\\/").replace("<!--", "<\\!--")


def graph_page(layers: DataFrame, links: DataFrame, title: str) -> str:
    """A page of its own with one graph: ``layers`` (node, layer) and ``links`` (src, dst) of one model.

    Texts are escaped where they are shown and data is neutralised where it stands in a script, so no name of a sheet can
    close an element. Every place of the page is filled once, from the template, not from what was filled in.
    """
    found, more = _rows(layers.orderBy("layer", "node"))
    names = {r.node for r in found}
    pairs = [[r.src, r.dst] for r in _rows(links.orderBy("src", "dst"))[0] if r.src in names and r.dst in names]
    place: dict[int, int] = {}
    nodes = []
    for r in found:
        nodes.append({"name": r.node, "layer": r.layer, "place": place.setdefault(r.layer, 0)})
        place[r.layer] += 1
    body = "".join(f"<tr><td>{r.layer}<td>{html.escape(r.node)}</tr>" for r in found) + (f"<tr><td colspan=2>{more} more</tr>" if more else "")
    return _PAGE.format(title=html.escape(title), height=60 + 26 * max(place.values(), default=0), rows=body, data=_script_safe({"nodes": nodes, "links": pairs}))


def statement_text(periods: Sequence[object], lines: Iterable[tuple[str, Sequence[object]]]) -> str:
    """A statement as text: periods across, a line a row, unknown figures as a dash."""
    table = [["", *map(str, periods)], *[[name, *map(figure, values)] for name, values in lines]]
    wide = [max(len(r[i]) for r in table) for i in range(len(table[0]))]
    return "\n".join("  ".join(v.ljust(n) if i == 0 else v.rjust(n) for i, (v, n) in enumerate(zip(r, wide))).rstrip() for r in table)
