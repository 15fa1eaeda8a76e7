"""Text expressions: normalization, scanning with offsets, identifiers, geometry helpers. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_STRIP = ".,;:!?()[]\"'"  # fixed value: signs that a word loses at its ends before it is compared
MARK = "\x01"

SPANS = "array<struct<start:int,end:int,value:string>>"


def normalized(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(WORD_STRIP)))


def target_words(entity: Column) -> Column:
    """The normalized words of a literal; words of signs alone are left out."""
    words = F.split(F.trim(F.regexp_replace(entity, r"\s+", " ")), " ")
    return F.filter(F.transform(words, normalized), lambda w: w != "")

SCAN_BLOCK = 64


def scan(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern, in order: array of (start, end, value), offsets from 0 in code points.

    Matches are wrapped in marks and the text is split at them, so every second part is a match and the lengths before
    it are its start. Offsets are added up in blocks of SCAN_BLOCK matches, and an array is only ever built for a block,
    so the work grows with the number of matches and not with its square.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, " ")).otherwise(text)
    parts = F.split(F.regexp_replace(marked, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    def spans(p: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 3) / (2 * SCAN_BLOCK)).cast("int"))
        block = lambda b: F.slice(p, b * (2 * SCAN_BLOCK) + 1, 2 * SCAN_BLOCK)
        sizes = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda n, x: n + F.char_length(x)))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))

        def inside(b: Column, begin: Column) -> Column:
            """A block's parts come in pairs: what stands before a match, and the match; the last block may end with a rest."""
            first = F.struct(begin.alias("at"), F.lit(False).alias("match"), F.array().cast(SPANS).alias("out"))

            def step(s: Column, x: Column) -> Column:
                end = s["at"] + F.char_length(x)
                return F.struct(end.alias("at"), (~s["match"]).alias("match"), F.when(s["match"], F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.alias("end"), x.alias("value"))))).otherwise(s["out"]).alias("out"))

            return F.aggregate(b, first, step, lambda s: s["out"])

        found = F.transform(F.array(begins), lambda all_: F.flatten(F.transform(blocks, lambda b: inside(block(b), F.element_at(all_, b + 1)))))
        return F.when(F.size(p) > 1, F.element_at(found, 1)).otherwise(F.array().cast(SPANS))

    return F.element_at(F.transform(F.array(parts), spans), 1)  # the parts are worked out once


CATEGORY_NAMES = {"EMAIL_ADDRESS": "EMAIL", "SG_PHONE": "PHONE_NUMBER"}  # fixed values


def normal_category(category: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CATEGORY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, category), category)


def client_slug(name: Column) -> Column:
    """A client's id from its name: other signs become one underscore, none at the ends, 'UNNAMED' if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_-]+", "_"), r"_+", "_")
    return F.upper(F.coalesce(F.nullif(F.btrim(slug, F.lit("_")), F.lit("")), F.lit("unnamed")))


def valid_client_id(raw: Column) -> Column:
    return F.coalesce(raw.rlike(r"^[A-Za-z0-9_-]+\n?$"), F.lit(False))


def number_or(value: Column, default: float) -> Column:
    return F.coalesce(F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double"), F.lit(default))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "landscape").when(height > width, "portrait").otherwise("square")


def relative(x: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.bround(x / whole, 6)).otherwise(F.lit(0.0))


def font_style(family: Column) -> tuple[Column, Column]:
    """(bold, italic) by the words in a font family's name."""
    name = F.lower(F.coalesce(family, F.lit("")))
    return name.rlike("bold|heavy|black"), name.rlike("italic|oblique")


def span_flags(flags: Column) -> dict[str, Column]:
    bit = lambda n: F.shiftright(flags, n).bitwiseAND(F.lit(1)) == 1
    return {"bold": bit(4), "italic": bit(1), "mono": bit(3), "serif": bit(0)}


def segment_kind(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.when(F.abs(y0 - y1) < 1, "horizontal").when(F.abs(x0 - x1) < 1, "vertical").otherwise("diagonal")


def rotate_point(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """A point of an unrotated page as it lies on the page turned by 0, 90, 180 or 270 degrees."""
    turn = F.pmod(rotation, F.lit(360))
    rx = F.when(turn == 90, height - y).when(turn == 180, width - x).when(turn == 270, y).otherwise(x)
    ry = F.when(turn == 90, x).when(turn == 180, height - y).when(turn == 270, width - x).otherwise(y)
    return rx, ry


def zero_advance(width: Column, content: Column) -> Column:
    """Whether a line is too narrow for its letters to be drawn text."""
    n = F.char_length(F.replace(content, F.lit(" "), F.lit("")))
    return ((width <= 3) & (n == 0)) | ((n >= 3) & (width / n < 2.0))


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    """Area that two boxes (left, top, right, bottom) share."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return w * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: list[Column], b: list[Column]) -> Column:
    common = overlap_area(a, b)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    whole = area(a) + area(b) - common
    return F.when(whole > 0, common / whole).otherwise(F.lit(0.0))


def scaled_box(box: list[Column], page: list[Column], target: list[Column]) -> list[Column]:
    """left, top, right, bottom in the target's units of a box (left, top, width, height) in a page's (width, height)."""
    left, top, width, height = box
    x, y = target[0] / page[0], target[1] / page[1]
    return [left * x, top * y, (left + width) * x, (top + height) * y]


def joined_content(parts: Column) -> Column:
    """The content of a text node: its own text, its children's and what follows each, trimmed and joined without spaces."""
    return F.array_join(F.transform(parts, lambda x: F.trim(F.coalesce(x, F.lit("")))), "")
