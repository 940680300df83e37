"""The graph as JSON and as a page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession

MAX_ELEMENTS = 200_000

_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title>
<style>body {{ margin: 0; font: 13px sans-serif }} svg {{ width: 100vw; height: 100vh }} rect {{ fill: #e8eef7; stroke: #47729f }}</style></head>
<body><svg id="graph"></svg>
<script>
const elements = {elements};
const svg = document.getElementById("graph"), place = new Map();
const add = (tag, at) => {{
  const e = document.createElementNS("http://www.w3.org/2000/svg", tag);
  for (const k in at) e.setAttribute(k, at[k]);
  return svg.appendChild(e);
}};
const nodes = elements.filter(e => !e.data.source), edges = elements.filter(e => e.data.source);
const radius = Math.max(200, 40 * nodes.length);
nodes.forEach((e, k) => {{
  const turn = 2 * Math.PI * k / nodes.length;
  place.set(e.data.id, [radius * Math.cos(turn), radius * Math.sin(turn)]);
}});
svg.setAttribute("viewBox", [-radius - 200, -radius - 100, 2 * radius + 400, 2 * radius + 200].join(" "));
for (const e of edges) {{
  const [a, b] = [place.get(e.data.source), place.get(e.data.target)];
  const line = add("line", {{x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: e.data.colour, "stroke-width": e.data.width, opacity: e.data.opacity}});
  line.appendChild(document.createElementNS("http://www.w3.org/2000/svg", "title")).textContent = String(e.data.relation_count);
}}
for (const e of nodes) {{
  const [x, y] = place.get(e.data.id), {{width, height}} = e.data;
  add("rect", {{x: x - width / 2, y: y - height / 2, width, height, rx: 6}});
  add("text", {{x, y, "text-anchor": "middle", "dominant-baseline": "middle"}}).textContent = e.data.label;
}}
</script></body></html>
"""


def elements_json(elements: DataFrame) -> str:
    """A JSON list of ``{"data": {...}}``, nodes first. ``<`` is escaped, so that no text can close the script.

    A page is for the eye: more elements than MAX_ELEMENTS raise an error rather than being cut.
    """
    rows = elements.limit(MAX_ELEMENTS + 1).collect()
    if len(rows) > MAX_ELEMENTS:
        raise ValueError("the graph is too large for a page; filter it first")
    rows.sort(key=lambda r: (r["element"] != "node", r["id"]))
    data = [{"data": {k: v for k, v in r.asDict().items() if v is not None and k != "element"}} for r in rows]
    return json.dumps(data, ensure_ascii=False).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def page(title: str, elements: DataFrame) -> str:
    return _PAGE.format(title=html.escape(title), elements=elements_json(elements))


def write_page(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` to a file of any file system that Hadoop knows, in place of an older one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    f = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        f.write(bytearray(text.encode()))
    finally:
        f.close()
