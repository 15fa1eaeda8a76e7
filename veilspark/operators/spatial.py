"""Joins of boxes: nearest words, best spans, containment, cuts at rules, cells, hit tests.

Boxes meet in equi-joins on the page and on bands of BAND points of its height, so that a page with very many boxes is
many tasks' work and a box is held only against those near it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import iou, overlap_area


BAND = 48


def _in_bands(rows: DataFrame, top: Column, bottom: Column, first: str) -> DataFrame:
    """rows once for each band between top and bottom; `first` is the first of these."""
    lo = F.floor(top / BAND)
    return rows.withColumn(first, lo).withColumn("_band", F.explode(F.sequence(lo, F.greatest(lo, F.floor(bottom / BAND)))))


def near(a: DataFrame, a_top: Column, a_bottom: Column, b: DataFrame, b_top: Column, b_bottom: Column) -> DataFrame:
    """Pairs of rows of one page whose heights share a band, each pair once: in the first band that both have."""
    pairs = _in_bands(a, a_top, a_bottom, "_first_a").join(_in_bands(b, b_top, b_bottom, "_first_b"), ["page", "_band"])
    return pairs.where(F.col("_band") == F.greatest("_first_a", "_first_b")).drop("_band", "_first_a", "_first_b")


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def nearest_words(words: DataFrame, others: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Each word with the box of the nearest other word of equal text within the tolerance in height; nulls where there is none."""
    o = others.select("page", "text", F.col("ord").alias("o_ord"), F.col("left").alias("o_left"), F.col("right").alias("o_right"), F.col("top").alias("o_top"))
    near = words.join(o, ["page", "text"]).where(F.abs(F.col("top") - F.col("o_top")) <= tolerance)
    near = first_by(near, ["id"], [F.abs(F.col("top") - F.col("o_top")) + F.abs(F.col("left") - F.col("o_left")), "o_ord"])
    return words.join(near.select("id", "o_left", "o_right"), "id", "left")


def rescaled(x, old_left, old_right, new_left, new_right):
    """A coordinate of one extent in another."""
    return F.when(old_right > old_left, new_left + (x - old_left) * (new_right - new_left) / (old_right - old_left)).otherwise(new_left)


def best_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Each line with the span that it shares the largest part of the union with; the first of equals; none without overlap."""
    s = spans.select("page", F.col("ord").alias("span"), *(F.col(c).alias(f"s_{c}") for c in ("left", "top", "right", "bottom")))
    box = [F.col(c) for c in ("left", "top", "right", "bottom")]
    rows = near(lines, F.col("top"), F.col("bottom"), s, F.col("s_top"), F.col("s_bottom")).withColumn("iou", iou(box, [F.col(f"s_{c}") for c in ("left", "top", "right", "bottom")])).where("iou > 0")
    best = first_by(rows, ["line_id"], [F.col("iou").desc(), "span"]).select("line_id", "span", "iou")
    return lines.select("line_id").join(best, "line_id", "left")


def contained_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(line_id, word_id) where a word lies in a line, with a tolerance by font size; a word may be in several lines."""
    w = words.select("page", F.col("id").alias("word_id"), *(F.col(c).alias(f"w_{c}") for c in ("left", "top", "right", "bottom")))
    tol = F.greatest(F.lit(2.0), F.col("font_size") * 0.1)
    inside = (F.col("w_left") >= F.col("left") - tol) & (F.col("w_right") <= F.col("right") + tol) & (F.col("w_top") >= F.col("top") - tol) & (F.col("w_bottom") <= F.col("bottom") + tol)
    return near(lines, F.col("top") - tol, F.col("bottom") + tol, w, F.col("w_top"), F.col("w_bottom")).where(inside).select("line_id", "word_id")


def _segments(cut: DataFrame) -> DataFrame:
    """line_id, part, content, box from rows (line_id, line_right, edge, char_left, ...): characters between two edges, read from left to right, blank parts left out."""
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_left", "char_ord", "char"))), lambda x: x["char"]), ""))
    rows = cut.groupBy("page", "line_id", "part").agg(text.alias("content"), F.min("char_left").alias("left"), F.min("char_top").alias("top"), F.max("char_right").alias("right"), F.max("char_bottom").alias("bottom"))
    return rows.where("content != ''")


def _chars(chars: DataFrame) -> DataFrame:
    return chars.where("char != ''").select("page", "char", F.col("ord").alias("char_ord"), *(F.col(c).alias(f"char_{c}") for c in ("left", "top", "right", "bottom")))


def cut_at_rules(lines: DataFrame, rules: DataFrame, chars: DataFrame) -> DataFrame:
    """page, line_id, part, content, box: lines cut at vertical rules longer than 5 that cross them at mid-height; a rule may run either way.

    A part holds the page's characters (char, ord, box) that lie in the line's box (3 points more above and below, 2 on
    the sides) and begin between its edges, with 1 point of grace on the left; blank parts are dropped. A line
    that no rule crosses, or of which nothing is left, stays whole as part 0.
    """
    r = rules.where("abs(y1 - y0) > 5").select("page", F.col("x").cast("double").alias("x"), F.least("y0", "y1").alias("y0"), F.greatest("y0", "y1").alias("y1"))
    mid = (F.col("top") + F.col("bottom")) / 2
    crossing = near(lines, mid, mid, r, F.col("y0"), F.col("y1")).where((F.col("x") > F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y0") <= mid) & (F.col("y1") >= mid))
    cuts = crossing.groupBy("page", "line_id", "left", "top", "right", "bottom").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    edges = cuts.withColumn("e", F.concat(F.array(F.col("left").cast("double")), "xs", F.array((F.col("right") + 1).cast("double"))))
    parts = edges.select("page", "line_id", "left", "top", "right", "bottom", F.posexplode(F.expr("transform(slice(e, 1, size(e) - 1), (a, i) -> struct(a as a, e[i + 1] as b))")).alias("part", "p"))
    close = (F.col("char_top") >= F.col("top") - 3) & (F.col("char_top") <= F.col("bottom") + 3) & (F.col("char_left") >= F.col("left") - 2) & (F.col("char_left") <= F.col("right") + 2)
    here = close & (F.col("char_left") >= F.col("p.a") - 1) & (F.col("char_left") < F.col("p.b"))
    cut = _segments(near(parts, F.col("top") - 3, F.col("bottom") + 3, _chars(chars), F.col("char_top"), F.col("char_top")).where(here).drop("left", "top", "right", "bottom"))
    whole = lines.join(cut.select("page", "line_id").distinct(), ["page", "line_id"], "left_anti").select("page", "line_id", F.lit(0).alias("part"), "content", "left", "top", "right", "bottom")
    return whole.unionByName(cut)


def cut_pages(pages: DataFrame) -> DataFrame:
    """cut_at_rules for pages that come as one row each: page, lines (line_id, content, box), rules (x, y0, y1) and strips
    (text, box), arrays; a strip is a row of characters of even widths, counted from 0. Nothing is shuffled, and a character is no row."""
    rows = pages.select("page", "lines", "rules", "strips")
    return rows.mapInArrow(_cut_pages, f"page {rows.schema['page'].dataType.simpleString()}, line_id int, part int, content string, left double, top double, right double, bottom double")


def _cut_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 4]
    names = ["line_id", "part", "content", "left", "top", "right", "bottom"]
    for batch in batches:
        columns = {c: batch.column(c) for c in ("lines", "rules", "strips")}
        bounds = {c: x.offsets.to_pylist() for c, x in columns.items()}
        flat = {c: pa.RecordBatch.from_struct_array(x.values) for c, x in columns.items()}
        at = size = 0
        found: list[tuple] = []
        row: list[int] = []
        for i in range(batch.num_rows):
            part = {c: flat[c].slice(bounds[c][i], bounds[c][i + 1] - bounds[c][i]) for c in flat}
            value = lambda c, *fields: list(zip(*(part[c].column(f).to_pylist() for f in fields)))  # noqa: B023, E731
            new = list(_cut_page(value("lines", *names[:1], *names[2:]), value("rules", "x", "y0", "y1"), value("strips", "text", *names[3:])))
            found += new
            row += [i] * len(new)
            size += sum(len(x[2]) for x in new)
            if found and (size > 1 << 20 or i + 1 == batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(row)), *(pa.array(x, k) for x, k in zip(zip(*found), kinds))], ["page", *names])
                found, row, size = [], [], 0


def _cut_page(lines: list[tuple], rules: list[tuple], strips: list[tuple]) -> Iterator[tuple]:
    """line_id, part, content, box of a page's lines, as cut_at_rules has them."""
    high = [(float(x), min(y0, y1), max(y0, y1)) for x, y0, y1 in rules if abs(y1 - y0) > 5]
    strips = sorted((s for s in strips if s[0]), key=lambda s: s[2])
    tops = [s[2] for s in strips]
    for line_id, content, left, top, right, bottom in lines:
        mid = (top + bottom) / 2
        xs = sorted(x for x, y0, y1 in high if left < x < right and y0 <= mid <= y1)
        edges = [left, *xs, right + 1]
        cut = []
        for part in range(len(xs) + 1 if xs else 0):
            chars = []
            for text, s_left, s_top, s_right, s_bottom in strips[bisect_left(tops, top - 3) : bisect_right(tops, bottom + 3)]:
                # one place more on either side, as the width may be rounded
                width = (s_right - s_left) / len(text)
                lo, hi = max(left - 2, edges[part] - 1), min(right + 2, edges[part + 1])
                a, b = (int(min(max((x - s_left) / width, -2), len(text))) if width > 0 else y for x, y in ((lo, 0), (hi, len(text))))
                for k in range(max(a - 1, 0), min(b + 2, len(text))):
                    x = s_left + width * k
                    if lo <= x <= right + 2 and x < edges[part + 1]:
                        chars.append((x, k, text[k], s_top, x + width, s_bottom))
            text = "".join(x[2] for x in sorted(chars)).strip(" ")
            if text:
                cut.append((line_id, part, text, min(x[0] for x in chars), min(x[3] for x in chars), max(x[4] for x in chars), max(x[5] for x in chars)))
        yield from cut or [(line_id, 0, content, left, top, right, bottom)]


def cut_at_cells(lines: DataFrame, cell_table: DataFrame, chars: DataFrame) -> DataFrame:
    """page, line_id, part, content, box: lines cut at the left edges of cells that they cross at mid-height, where characters stand on both sides.

    Characters are those that begin within 4 points of the line's top, and of its width with 2 points more.
    """
    c = cell_table.select("page", F.col("left").cast("double").alias("x"), F.col("top").alias("c_top"), F.col("bottom").alias("c_bottom"))
    mid = (F.col("top") + F.col("bottom")) / 2
    crossing = near(lines.where("trim(content) != ''"), mid, mid, c, F.col("c_top"), F.col("c_bottom")).where((F.col("left") < F.col("x")) & (F.col("x") < F.col("right")) & (F.col("c_top") <= mid) & (mid <= F.col("c_bottom")))
    cuts = crossing.groupBy("page", "line_id", "left", "top", "right").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    close = (F.abs(F.col("char_top") - F.col("top")) < 4) & (F.col("char_left") >= F.col("left") - 2) & (F.col("char_left") <= F.col("right") + 2)
    cut = near(cuts, F.col("top") - 4, F.col("top") + 4, _chars(chars), F.col("char_top"), F.col("char_top")).where(close).drop("left", "top", "right").withColumn("part", F.size(F.filter("xs", lambda x: x <= F.col("char_left"))))
    cut = _segments(cut)
    cut = cut.withColumn("n", F.count("*").over(Window.partitionBy("page", "line_id"))).where("n > 1").drop("n")
    whole = lines.join(cut.select("page", "line_id").distinct(), ["page", "line_id"], "left_anti").select("page", "line_id", F.lit(0).alias("part"), "content", "left", "top", "right", "bottom")
    numbered = cut.withColumn("part", (F.row_number().over(Window.partitionBy("page", "line_id").orderBy("part")) - 1).cast("int"))
    return whole.unionByName(numbered)


def filled(lines: DataFrame, spans: DataFrame, words: DataFrame) -> DataFrame:
    """page, line_id, content: blank lines wider than 3 get the text of the first span within 5 points (width within 10), else of
    the first word within 5, else of the first span within 10; all other lines keep theirs."""
    s = spans.where("trim(text) != ''").select("page", "ord", F.col("left").alias("s_left"), F.col("top").alias("s_top"), (F.col("right") - F.col("left")).alias("s_width"), "text", F.lit("s").alias("kind"))
    w = words.where("trim(text) != ''").select("page", "ord", F.col("left").alias("s_left"), F.col("top").alias("s_top"), F.lit(None).cast("double").alias("s_width"), "text", F.lit("w").alias("kind"))
    bare = lines.where((F.trim("content") == "") & (F.col("right") - F.col("left") > 3)).select("page", "line_id", "left", "top", "right")
    within = lambda d: (F.abs(F.col("top") - F.col("s_top")) < d) & (F.abs(F.col("left") - F.col("s_left")) < d)
    span, width = F.col("kind") == "s", F.col("right") - F.col("left")
    rank = F.when(span & within(5) & (F.abs(width - F.col("s_width")) < 10), 0).when(~span & within(5), 1).when(span & within(10), 2)
    found = near(bare, F.col("top") - 10, F.col("top") + 10, s.unionByName(w), F.col("s_top"), F.col("s_top")).withColumn("rank", rank).where("rank is not null")
    best = first_by(found, ["page", "line_id"], ["rank", "ord"]).select("page", "line_id", "text")
    return lines.join(best, ["page", "line_id"], "left").select("page", "line_id", F.coalesce("text", "content").alias("content"))


def cells(rects: DataFrame) -> DataFrame:
    """Rectangles wider and higher than 15 without near duplicates (all sides within 2 of one kept before)."""
    rows = rects.where("right - left > 15 and bottom - top > 15").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "left", "top", "right", "bottom"))).alias("r"))
    kind = "array<struct<ord:int,left:double,top:double,right:double,bottom:double>>"
    near = "exists(k, c -> abs(c.left - x.left) < 2 and abs(c.top - x.top) < 2 and abs(c.right - x.right) < 2 and abs(c.bottom - x.bottom) < 2)"
    return rows.select("page", F.explode(F.expr(f"aggregate(cast(r as {kind}), cast(array() as {kind}), (k, x) -> if({near}, k, concat(k, array(x))))")).alias("c")).select("page", "c.*")


def merged_cells(lines: DataFrame, cell_table: DataFrame) -> DataFrame:
    """Lines of cells that hold two or more lines at least 6 apart: line_id, cell_group, cell_merged_value; later cells win.

    A line is in a cell with its whole width (2 points may stick out on the right) and its middle height; blank lines
    and ghosts aren't. Groups are numbered in the order of their cells.
    """
    c = cell_table.select("page", F.col("ord").alias("cell"), *(F.col(x).alias(f"c_{x}") for x in ("left", "top", "right", "bottom")))
    mid_y = (F.col("top") + F.col("bottom")) / 2
    inside = (F.col("c_left") <= F.col("left")) & (F.col("right") <= F.col("c_right") + 2) & (F.col("c_top") <= mid_y) & (mid_y <= F.col("c_bottom"))
    rows = near(lines.where(~F.coalesce("is_ghost", F.lit(False)) & (F.trim("content") != "")), mid_y, mid_y, c, F.col("c_top"), F.col("c_bottom")).where(inside).withColumn("mid_y", mid_y)
    groups = rows.groupBy("page", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mid_y", "left", "line_id", "content"))), lambda x: F.trim(x["content"])), " ").alias("cell_merged_value"), F.count("*").alias("n"), (F.max("mid_y") - F.min("mid_y")).alias("span")).where("n >= 2 and span >= 6")
    groups = groups.withColumn("cell_group", F.row_number().over(Window.partitionBy("page").orderBy("cell")) - 1)
    found = rows.join(groups.select("page", "cell", "cell_group", "cell_merged_value"), ["page", "cell"])
    return first_by(found, ["page", "line_id"], [F.col("cell").desc()]).select("line_id", "cell_group", "cell_merged_value")


def font_ratio(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """page, ratio: mean of line size to span size over lines and the first span of equal text, or that holds or is held by 5 letters and more; 1 when within 0.01."""
    s = spans.select("page", F.col("ord").alias("span"), F.trim("text").alias("s_text"), F.col("size").alias("s_size")).where("s_text != '' and s_size > 0")
    l = lines.select("page", "line_id", "font_size", F.trim("content").alias("l_text")).where("l_text != '' and font_size > 0")
    long = lambda c: F.char_length(c) >= 5
    rows = l.join(s, "page").where((F.col("s_text") == F.col("l_text")) | (long("l_text") & F.contains("s_text", "l_text")) | (long("s_text") & F.contains("l_text", "s_text")))
    first = first_by(rows, ["page", "line_id"], ["span"])
    mean = first.groupBy("page").agg(F.avg(F.col("font_size") / F.col("s_size")).alias("ratio"))
    return mean.select("page", F.when(F.abs(F.col("ratio") - 1) > 0.01, F.col("ratio")).otherwise(1.0).alias("ratio"))


def missed_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of which lines cover less than half: their places and whether they stand upright (rotation 90)."""
    l = lines.select("page", *(F.col(c).alias(f"l_{c}") for c in ("left", "top", "right", "bottom")))
    box = [F.col(c) for c in ("left", "top", "right", "bottom")]
    area = overlap_area(box, [F.col(f"l_{c}") for c in ("left", "top", "right", "bottom")])
    covered = near(spans, F.col("top"), F.col("bottom"), l, F.col("l_top"), F.col("l_bottom")).groupBy("page", "ord").agg(F.sum(area).alias("covered"))
    rows = spans.join(covered, ["page", "ord"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    return rows.where(F.col("covered") < 0.5 * w * h).select("page", "ord", "text", F.when((h > 1.5 * w) & (h > 6), 90).otherwise(0).alias("rotation"))


def hit(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """For each point the smallest box that it lies in."""
    b = boxes.select("page", F.col("ord").alias("box"), "left", "top", "right", "bottom")
    rows = near(points, F.col("y"), F.col("y"), b, F.col("top"), F.col("bottom")).where("x >= left and x <= right and y >= top and y <= bottom")
    best = first_by(rows, ["point"], [(F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")), "box"]).select("point", "box")
    return points.select("point").join(best, "point", "left")


def hit_word(points: DataFrame, boxes: DataFrame, words: DataFrame) -> DataFrame:
    """For each point the smallest box that it lies in, and of that box's words (page, box, word, sides) the smallest that holds the point."""
    found = points.join(hit(points, boxes), "point")
    w = words.select("page", "box", "word", *(F.col(c).alias(f"w_{c}") for c in ("left", "top", "right", "bottom")))
    rows = found.join(w, ["page", "box"]).where("x >= w_left and x <= w_right and y >= w_top and y <= w_bottom")
    best = first_by(rows, ["point"], [(F.col("w_right") - F.col("w_left")) * (F.col("w_bottom") - F.col("w_top")), "word"]).select("point", "word")
    return found.select("point", "box").join(best, "point", "left")


def nearest_line(points: DataFrame, lines: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """For each point the line whose corner is nearest, horizontal and vertical distance together at most the tolerance."""
    rows = near(points, F.col("y") - tolerance, F.col("y") + tolerance, lines.select("page", "line_id", "left", "top"), F.col("top"), F.col("top")).withColumn("d", F.abs(F.col("x") - F.col("left")) + F.abs(F.col("y") - F.col("top"))).where(F.col("d") <= tolerance)
    best = first_by(rows, ["point"], ["d", "line_id"]).select("point", "line_id")
    return points.select("point").join(best, "point", "left")


def painted(chars: DataFrame) -> DataFrame:
    """line_id, share, is_ghost from ink probes: chars(line_id, char, max_delta, share_30). A line is a ghost below 0.30 of its letters painted; lines of white space are left out."""
    drawn = (F.col("max_delta") >= 80) | (F.col("share_30") >= 0.06)
    rows = chars.where("trim(char) != ''").groupBy("line_id").agg(F.avg(drawn.cast("double")).alias("share"))
    return rows.withColumn("is_ghost", F.col("share") < 0.30)
